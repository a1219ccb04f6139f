"""Sums over CIGAR operations and MD strings, and what derives from them, as column expressions.

An expression is only evaluated where a plan uses it, so a plan that needs no CIGAR reads none.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sum_ops(letters: str, cigar: str = "cigar") -> Column:
    """Sum of the lengths of the named operations; 0 for '*' or null."""
    lengths = F.regexp_extract_all(F.col(cigar), F.lit(rf"(\d+)[{letters}]"), F.lit(1))
    return F.coalesce(F.aggregate(lengths, F.lit(0).cast("bigint"), lambda n, x: n + x.cast("bigint")), F.lit(0).cast("bigint"))


def count_ops(letters: str, cigar: str = "cigar") -> Column:
    return F.coalesce(F.regexp_count(F.col(cigar), F.lit(rf"\d+[{letters}]")), F.lit(0)).cast("bigint")


def alignment_length() -> Column:
    return sum_ops("MID=X")


def query_length() -> Column:
    """Hard clips count."""
    return sum_ops("MISH=X")


def query_clip() -> Column:
    return sum_ops("SH")


def reference_span() -> Column:
    return sum_ops("MDN=X")


def reference_end() -> Column:
    return F.col("pos0") + F.greatest(F.lit(1).cast("bigint"), reference_span())


def md_mismatches() -> Column:
    """Letters of MD that follow a number; deleted bases and leading letters don't count. 0 without MD."""
    md = F.regexp_replace(F.coalesce(F.col("md"), F.lit("")), r"^[^0-9^]+", "")
    return F.length(F.regexp_replace(F.regexp_replace(md, r"\^[^0-9^]+", ""), r"[0-9^]", "")).cast("bigint")


def edit_distance() -> Column:
    """For filters: indel bases and mismatches by MD, else NM, else an error."""
    nothing = F.raise_error(F.concat(F.lit("Alignment of '"), F.coalesce("qname", F.lit("")), F.lit("' has neither MD nor NM"))).cast("bigint")
    return F.when(F.col("md").isNotNull(), sum_ops("ID") + md_mismatches()).when(F.col("nm").isNotNull(), F.col("nm").cast("bigint")).otherwise(nothing)


def summary_match() -> Column:
    """Matched bases; without MD every aligned base counts as matched."""
    return sum_ops("M=X") - md_mismatches()


def summary_edit() -> Column:
    """Mismatches, clipped bases and indel bases."""
    return md_mismatches() + query_clip() + sum_ops("ID")


def gap_open() -> Column:
    return count_ops("ID")


def gap_extend() -> Column:
    return sum_ops("ID") - count_ops("ID")


def glocal_length() -> Column:
    return alignment_length() + query_clip()


def percent_identity() -> Column:
    return F.when(glocal_length() > 0, F.lit(100.0) - F.lit(100.0) * summary_edit() / F.nullif(glocal_length(), F.lit(0))).otherwise(F.lit(float("nan")))


def unmapped_bases() -> Column:
    return query_length() - summary_match()


def summary_score() -> Column:
    return summary_match() - summary_edit()


def rescored() -> Column:
    """+1 for each aligned column without an edit, -1 for each edit."""
    return (alignment_length() - 2 * edit_distance()).cast("int")


def aligned_blocks() -> Column:
    """(start, end) on the reference of each stretch from pos0 that no deletion or skip breaks; maybe empty ones."""
    block = lambda start, end: F.struct(start.cast("bigint").alias("start"), end.cast("bigint").alias("end"))
    ops = F.regexp_extract_all(F.col("cigar"), F.lit(r"\d+[MDN=X]"), F.lit(0))
    pos = F.col("pos0").cast("bigint")
    begin = F.struct(pos.alias("since"), pos.alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("blocks"))

    def step(acc: Column, op: Column) -> Column:
        end = acc["at"] + F.left(op, F.length(op) - 1).cast("bigint")
        on = F.struct(acc["since"].alias("since"), end.alias("at"), acc["blocks"].alias("blocks"))
        broken = F.struct(end.alias("since"), end.alias("at"), F.concat(acc["blocks"], F.array(block(acc["since"], acc["at"]))).alias("blocks"))
        return F.when(F.right(op, F.lit(1)).isin("D", "N"), broken).otherwise(on)

    several = F.aggregate(ops, begin, step, lambda acc: F.concat(acc["blocks"], F.array(block(acc["since"], acc["at"]))))
    # most reads are one stretch
    return F.when(F.col("cigar").rlike("[DN]"), several).otherwise(F.array(block(pos, pos + sum_ops("M=X"))))
