"""I-Match fingerprints over randomised lexicons; DataFrame functions only.

The lexicon is the terms whose document frequency, over all documents, lies in a band: LEAST to MOST of
the documents, that is an inverse document frequency of ln(1 / MOST) to ln(1 / LEAST). It can hold
at most (mean distinct terms of a document) / LEAST terms, whatever the corpus, so it travels as a
constant. A document's terms in the lexicon, distinct and sorted, are cut down to randomised
subsets of the lexicon at each of several rates; the fingerprint is the list of the subsets' hashes. Rates
differ because a subset tells documents apart well if it keeps a term or two of them.

Likeness of two fingerprints: at each rate, equal hashes as a share of the subsets that are not empty in
both; of the rates with two such subsets or more the largest counts (with none, all together).

Neighbours in descending doc_id are found without a global sort and with one shuffle of the texts: rows are
dealt to buckets between quantiles of a bounded sample of (doc_id, hash of the text), found by bisection in a
constant; each bucket also gets the first row of the next bucket. Nothing is computed with ids but
comparisons, so they may lie anywhere.

Defined results: a null text is empty; a text without a term of the lexicon is fingerprinted by all its
terms, and one without terms by none, so equal texts are always alike by 1; rows that share a doc_id (or
have none) go by xxhash64 of the text, descending; a null doc_id comes last; a table of one row has itself
for a neighbour; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandframe.llm import common

LEAST, MOST = 0.01, 0.05
#: For each rate, (bits of a term's hash that a subset looks at: it keeps a term of 2**bits; subsets). Subset k
#: of a rate is the terms whose leading bits are k, so the subsets of a rate are disjoint.
RATES = ((3, 8), (5, 32), (7, 32), (9, 32))
#: Rows of a bucket, buckets (beyond so many buckets they grow), sampled rows of a bucket.
BUCKET_ROWS, MOST_BUCKETS, SAMPLED = 2048, 65_536, 16


def term_hashes(text: Column) -> Column:
    """Hashes of the terms, repeats included: runs without white space, in lower case."""
    words = F.array_remove(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _constant(values, kind: str) -> Column:
    """A constant array, folded once when the plan is made."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>") if len(values) else F.array().cast(f"array<{kind}>")


class Lexicon:
    """Term hashes of the band, sorted.

    Intersecting a constant sorted array with a document's terms gives the distinct ones, sorted, at the cost
    of the constant's length, in generated code.
    """

    def __init__(self, hashes: list[int]):
        self.hashes = sorted(hashes)
        self.size = len(hashes)

    def keep(self, terms: Column) -> Column:
        return F.array_intersect(_constant(self.hashes, "bigint"), terms)


def lexicon(docs: DataFrame, least: float = LEAST, most: float = MOST) -> Lexicon:
    """Counts document frequencies over all rows of docs (doc_id, text) and keeps the band."""
    n = docs.count()
    low = max(2.0, least * n)
    counts = docs.select(F.explode(F.array_distinct(term_hashes(F.col("text")))).alias("h")).groupBy("h").agg(F.count("*").alias("df"))
    return Lexicon([r.h for r in counts.where((F.col("df") >= low) & (F.col("df") <= max(low, most * n))).select("h").collect()])


def with_fingerprint(rows: DataFrame, text: str, words: Lexicon, name: str) -> DataFrame:
    """rows with the column name: array of longs, one for each subset of each rate; 0 where a subset is empty."""

    def code(terms: Column) -> Column:
        h = F.xxhash64(terms).bitwiseAND(F.lit(0xFFFFFFFF))
        return F.when(F.size(terms) == 0, F.lit(0).cast("long")).otherwise(F.greatest(h, F.lit(1).cast("long")))

    def of_rate(bits: int, subsets: int) -> Column:
        return F.filter("_kept", lambda t: F.shiftrightunsigned(t, 64 - bits) < subsets)

    def codes(bits: int, subsets: int) -> Column:
        own = F.sequence(F.lit(0).cast("long"), F.lit(subsets - 1).cast("long"))
        return F.transform(F.transform(own, lambda n: F.filter(f"_of{bits}", lambda t: F.shiftrightunsigned(t, 64 - bits) == n)), code)

    rows = rows.withColumn("_terms", term_hashes(F.col(text)))
    rows = rows.withColumn("_kept", words.keep(F.col("_terms")))
    rows = rows.withColumns({f"_of{bits}": of_rate(bits, subsets) for bits, subsets in RATES})
    every = F.sort_array(F.array_distinct("_terms"))
    without = F.array_repeat(F.greatest(code(every), F.lit(1).cast("long")), sum(n for _, n in RATES))
    made = rows.withColumn(name, F.when(F.size("_kept") == 0, without).otherwise(F.concat(*[codes(*rate) for rate in RATES])))
    return made.drop("_terms", "_kept", *[f"_of{bits}" for bits, _ in RATES])


def shown(codes: Column) -> Column:
    """Eight hexadecimal digits for each code."""
    return F.array_join(F.transform(codes, lambda c: F.lpad(F.lower(F.hex(c)), 8, "0")), "")


def with_likeness(rows: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """rows with the column name: the likeness of the fingerprints a and b."""
    # 0: empty in both, 1: different, 2: equal
    rows = rows.withColumn("_pairs", F.zip_with(a, b, lambda x, y: F.when(x != y, 1).when(x == 0, 0).otherwise(2)))
    begins = [sum(n for _, n in RATES[:k]) for k in range(len(RATES))]
    parts = [F.slice("_pairs", begin + 1, n) for begin, (_, n) in zip(begins, RATES)]
    counts = [F.struct(F.size(F.array_remove(p, 0)).alias("n"), F.size(F.filter(p, lambda x: x == 2)).alias("e")) for p in parts]
    rows = rows.withColumn("_counts", F.array(*counts))
    c = [F.col("_counts")[k] for k in range(len(RATES))]
    n, e = sum((x["n"] for x in c), F.lit(0)), sum((x["e"] for x in c), F.lit(0))
    whole = F.when(n > 0, e / F.nullif(n, F.lit(0))).when(F.col(a) == F.col(b), 1.0).otherwise(0.0)
    best = F.greatest(*[F.when(x["n"] >= 2, x["e"] / F.nullif(x["n"], F.lit(0))) for x in c])
    return rows.withColumn(name, F.coalesce(best, whole).cast("double")).drop("_pairs", "_counts")


def _order(key: str, text: str) -> dict[str, Column]:
    """Columns whose ascending order is that of descending keys (null last), then of descending hashes of the text."""
    return {"_null": F.col(key).isNull().cast("int"), "_key": F.coalesce(F.bitwise_not(F.col(key)), F.lit(0)).cast("long"), "_hash": F.bitwise_not(F.xxhash64(text))}


def _bounds(placed: DataFrame, rows: int) -> list[tuple[int, int, int]]:
    """The least (_null, _key, _hash) of each bucket but the first, quantiles of a sample of at most about SAMPLED * MOST_BUCKETS rows."""
    buckets = min(MOST_BUCKETS, -(-rows // BUCKET_ROWS))
    if buckets < 2:
        return []
    share = min(1.0, SAMPLED * buckets / rows)
    drawn = F.pmod(F.xxhash64("_key", "_hash"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))
    sample = sorted(map(tuple, placed.where(drawn).select("_null", "_key", "_hash").collect()))
    return sorted({sample[k * len(sample) // buckets] for k in range(1, buckets)}) if sample else []


def _bucket(bounds: list[tuple[int, int, int]]) -> Column:
    """How many bounds are at most the row's (_null, _key, _hash), by bisection."""
    if not bounds:
        return F.lit(0)
    null, key, hash_ = (_constant([b[k] for b in bounds], kind) for k, kind in enumerate(("int", "bigint", "bigint")))

    def reached(at: Column) -> Column:
        n, k, h = F.get(null, at), F.get(key, at), F.get(hash_, at)
        return (n < F.col("_null")) | ((n == F.col("_null")) & ((k < F.col("_key")) | ((k == F.col("_key")) & (h <= F.col("_hash")))))

    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= len(bounds)) & reached(at + step - 1), at + step).otherwise(at))


def with_next(rows: DataFrame, columns: list[str], key: str = "doc_id", text: str = "text", add=lambda df: df) -> DataFrame:
    """add(rows) with next_<column> of the row that follows in descending key (after the last: the first)."""
    placed = rows.withColumns(_order(key, text))
    placed = placed.withColumn("_bucket", _bucket(_bounds(placed, rows.count())))
    # the head of each bucket also ends the bucket before; at most MOST_BUCKETS heads
    heads = sorted((r["_bucket"], *r["h"]) for r in placed.groupBy("_bucket").agg(F.min(F.struct("_null", "_key", "_hash")).alias("h")).collect())
    heads = [(*h, heads[k - 1][0]) for k, (_, *h) in enumerate(heads)]
    heads = rows.sparkSession.createDataFrame(heads, "_n int, _k long, _h long, _at int")
    own = [c for c in placed.columns if c != "_bucket"]
    ends = placed.join(F.broadcast(heads), (F.col("_null") == F.col("_n")) & (F.col("_key") == F.col("_k")) & (F.col("_hash") == F.col("_h")))
    ends = ends.groupBy("_at").agg(*[F.any_value(c).alias(c) for c in own]).select(*own, F.col("_at").alias("_bucket"), F.lit(True).alias("_ghost"))
    order = Window.partitionBy("_bucket").orderBy("_ghost", "_null", "_key", "_hash")
    both = add(placed.withColumn("_ghost", F.lit(False)).unionByName(ends)).select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns])
    return both.where(~F.col("_ghost")).drop("_bucket", "_ghost", "_null", "_key", "_hash")


def fingerprint_and_edit(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and likenesses."""
    rows = common.plain(docs, {"doc_id": "long", "text": "string"}).withColumn("text", F.coalesce("text", F.lit("")))
    words = lexicon(rows)
    near = with_next(rows, ["text", "codes"], add=lambda df: with_fingerprint(df, "text", words, "codes"))
    third = F.floor(F.length("text") / F.lit(3)).cast("int")
    edited = F.concat(F.left(F.col("text"), F.length("text") - third), F.left(F.col("next_text"), third))
    near = near.select("doc_id", F.length("text").cast("long").alias("n_chars"), edited.alias("edited"), "codes", "next_codes")
    near = with_fingerprint(near, "edited", words, "edited_codes")
    near = with_likeness(with_likeness(near, "codes", "edited_codes", "near_edited"), "codes", "next_codes", "near_next")
    shas = F.sha2("edited", 256).alias("edited_sha256")
    return near.select("doc_id", "n_chars", shas, shown(F.col("codes")).alias("fingerprint"), shown(F.col("edited_codes")).alias("edited_fingerprint"), "near_edited", "near_next")
