"""Chat formatting with typed content parts; DataFrame functions only.

A message holds parts: text, image, audio, document. A visitor, one expression per kind, flattens them in
order: text is escaped, any other part becomes its placeholder. Beside the text go the attachments in
the same order (kind, reference, tokens that the placeholder expands to) and the sum of those tokens.

Template, per turn: ``<|turn|>role<|text|>content<|end|>``. Escaping doubles each backslash in a text
and puts one behind the first character of each control string (of this template or of others), so no
control string is left in it; unescaping takes one backslash away from each run's start, and undoes that.
The loss mask is a list of spans of the formatted text: the contents of assistant turns.

A conversation is one row of output, so its turns meet in one task: that bound is the format's own.
Turns are ordered in a window over the same partitioning that gathers them: one shuffle.

Defined results: turns go by turn, then role, then text (nulls first); a null role or text is empty; a null
or unknown kind of part is text; null parts give an empty turn; missing sizes count as 0; a null conv_id is a
conversation of its own; repeated rows are turns of their own; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandframe.llm import common

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
#: Tokens per image patch side (pixels), per second of audio, per page.
PATCH, AUDIO_RATE, PAGE_TOKENS = 14, 25, 256
#: The first character of a control string, told by what follows. Fixed values.
CONTROL = r"<(?=\||/?s>|</?SYS>>)|\[(?=/?INST\])"
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
_REST = (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))
ASSISTANT = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), CONTROL, "$0\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def _kind(part: Column) -> Column:
    return F.when(part["type"].isin(*PLACEHOLDERS), part["type"]).otherwise("text")


def visit_text(part: Column) -> Column:
    out = escape(part["text"])
    for kind, mark in PLACEHOLDERS.items():
        out = F.when(_kind(part) == kind, F.lit(mark)).otherwise(out)
    return out


def visit_tokens(part: Column) -> Column:
    side = lambda name: F.ceil(F.coalesce(part[name], F.lit(0)) / F.lit(PATCH))
    return (
        F.when(_kind(part) == "image", side("width") * side("height"))
        .when(_kind(part) == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * AUDIO_RATE))
        .when(_kind(part) == "document", F.coalesce(part["pages"], F.lit(0)) * PAGE_TOKENS)
        .otherwise(0)
        .cast("long")
    )


def text_parts(text: str) -> Column:
    """The parts of a message of text alone."""
    return F.array(F.named_struct(F.lit("type"), F.lit("text"), F.lit("text"), F.col(text), *[x for f, t in _REST for x in (F.lit(f), F.lit(None).cast(t))]))


def flatten(parts: Column) -> tuple[Column, Column]:
    """(content, attachments) of a message's parts: array of PART."""
    known = F.filter(F.coalesce(parts, F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull())
    content = F.array_join(F.transform(known, visit_text), "")
    attached = F.transform(F.filter(known, lambda p: _kind(p) != "text"), lambda p: F.struct(_kind(p).alias("kind"), p["ref"].alias("ref"), visit_tokens(p).alias("tokens")))
    return content, attached


def format_conversations(messages: DataFrame) -> DataFrame:
    """messages: conv_id, turn, role, parts. A row per conversation: conv_id, formatted, loss_spans (start, length in code points), attachments, expanded_tokens."""
    rows = common.plain(messages, {"conv_id": "long", "turn": "long", "role": "string", "parts": f"array<{PART}>"})
    content, attached = flatten(F.col("parts"))
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), content.alias("content"), attached.alias("attached"))
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT))
    rows = rows.withColumn("line", F.concat(head, F.col("content"), F.lit(END))).withColumn("ahead", F.length(head))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", unescape(F.col("content")), "content")
    before = F.coalesce(F.sum(F.length("line")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("number", F.row_number().over(order)).withColumn("start", before + F.col("ahead"))
    one = F.struct("number", "line", "attached", F.when(F.col("role") == ASSISTANT, F.struct(F.col("start"), F.length("content").cast("long").alias("length"))).alias("span"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("turns"))
    attachments = F.flatten(F.transform("turns", lambda t: t["attached"]))
    return grouped.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: t["line"]), "").alias("formatted"),
        F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
        attachments.alias("attachments"),
        F.aggregate(attachments, F.lit(0).cast("long"), lambda n, a: n + a["tokens"]).alias("expanded_tokens"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """formatted with its turns (role, text; unescaped) and its loss texts, both from the formatted text alone."""
    lines = F.slice(F.split("formatted", r"<\|turn\|>"), 2, 1 << 30)
    role = lambda x: unescape(F.substring_index(x, TEXT, 1))
    text = lambda x: unescape(F.substring_index(F.substring_index(x, END, 1), TEXT, -1))
    return formatted.withColumn("turns", F.transform(lines, lambda x: F.struct(role(x).alias("role"), text(x).alias("text")))).withColumn(
        "loss_texts", F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"].cast("int") + 1, s["length"].cast("int"))))
    )


def digest(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the output."""
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return read_back(formatted).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (CAST(-7 AS BIGINT), CAST(0 AS BIGINT), 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (
  SELECT *, length(text) + length(text) - length(replace(text, '\', '')) + len(regexp_extract_all(text, '<\||</?s>|<</?SYS>>|\[/?INST\]')) AS text_chars,
         length(role) + length(role) - length(replace(role, '\', '')) + len(regexp_extract_all(role, '<\||</?s>|<</?SYS>>|\[/?INST\]')) AS role_chars
  FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(text_chars + role_chars + 23) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
