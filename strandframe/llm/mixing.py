"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

A source's target is the smaller of its weight's share and its cap (epochs times its size); what the
caps cut off is shared out again by weight until no target is above its cap. One number, the level
(words per unit of weight), states that: a source is capped just if cap / weight is at most the
level, so each round is one aggregate over the sources.

A source's documents are repeated floor(target / size) times; the rest of the target is filled by whole
documents in a seeded order: hash buckets of about BUCKET_DOCS documents, whole buckets first, then
within one bucket per source each document that still fits. Only bucket sums are ordered within a source,
so a source with a third of all rows is no single task's work. What is taken differs from the target
by part of one document at most; equal input gives equal output.

Defined results: a null text has size 0; a null source is a source and comes last; a source of size
0 has target 0; rows with equal source and doc_id are taken together or not at all; a null doc_id is an
id like any other; an empty table gives an empty result; other columns are ignored by the plan and kept
by repeated().
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandframe.llm import common

#: A word. Fixed value.
WORD = r"[^\x20\x09-\x0D]+"
BUCKET_DOCS = 1000
#: Source tables up to so many rows are broadcast.
BROADCAST_ROWS = 50_000


@dataclass
class Mix:
    """sources: source, source_size, target, whole, buckets, edge (first bucket not wholly taken again). picks: source, doc_id taken once more in the edge bucket."""

    sources: DataFrame
    picks: DataFrame
    n_sources: int
    n_picks: int
    seed: int


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _bucket(doc_id: Column, buckets: Column, seed: int) -> Column:
    u = F.shiftrightunsigned(F.xxhash64(doc_id, F.lit(seed)), 11).cast("double") / F.lit(float(1 << 53))
    return F.floor(u * buckets).cast("long")


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """df with rank (0, 1, ...) in the order, ranges by ranges: one count per range reaches the driver."""
    spark = df.sparkSession
    one = common.stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_at", 33)
    base, offsets = 0, []
    for r in sorted(one.groupBy(part.alias("part")).count().collect()):
        offsets.append((r["part"], base))
        base += r["count"]
    starts = spark.createDataFrame(offsets, "_part long, _base long")
    return one.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn("rank", F.col("_base") + F.col("_at") - F.shiftleft("_part", 33)).drop("_part", "_base", "_at")


def cyclic_weights(sources: DataFrame) -> DataFrame:
    """weight 1, 2, 3, repeating, over the sources by code point, null last."""
    return ranked(sources, F.col("source").asc_nulls_last()).withColumn("weight", (1 + F.col("rank") % 3).cast("double")).drop("rank")


def water_fill(sources: DataFrame, epochs: float, total: float) -> float:
    """The level. sources: source_size, weight."""
    cap = F.col("source_size") * F.lit(float(epochs))
    level, capped = 0.0, -1
    while True:
        full = (cap <= F.lit(level) * F.col("weight")) if capped >= 0 else F.lit(False)
        r = sources.agg(F.sum(F.when(full, cap).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))), F.sum(full.cast("long"))).first()
        if r[1] is None or not r[1] or r[2] == capped:
            return level
        level, capped = max(level, (total - r[0]) / r[1]), r[2]


def plan(sized: DataFrame, weights=cyclic_weights, epochs: float = 3.0, share: float = 1.0, seed: int = 29) -> Mix:
    """sized: doc_id, source, size. weights: a function that adds weight to a table of sources. share: of all words, what the mix takes."""
    sources = common.stored(weights(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))), "mix-sources")
    n_sources, total = sources.agg(F.count("*"), F.sum("source_size")).first()
    level = water_fill(sources, epochs, share * (total or 0))
    target = F.least(F.col("source_size") * F.lit(float(epochs)), F.lit(level) * F.col("weight"))
    epoch = F.when(F.col("source_size") > 0, F.col("target") / F.greatest(F.col("source_size"), F.lit(1))).otherwise(0.0)
    planned = sources.withColumn("target", target).withColumn("whole", F.floor(epoch + F.lit(1e-12)).cast("long"))
    planned = planned.withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size"))).withColumn("buckets", F.ceil(F.col("n") / F.lit(BUCKET_DOCS)).cast("long"))

    same = F.col("d.source").eqNullSafe(F.col("s.source"))
    dealt = sized.alias("d").join(_small(planned, n_sources).alias("s"), same).select("d.doc_id", "d.size", "s.source", "s.rest", _bucket(F.col("d.doc_id"), F.col("s.buckets"), seed).alias("bucket"))
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    sums = dealt.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    sums = sums.withColumn("upto", F.sum("words").over(upto)).where("rest > 0 and upto > rest")
    edges = sums.groupBy("source").agg(F.min_by(F.struct("bucket", (F.col("rest") - F.col("upto") + F.col("words")).alias("room")), "bucket").alias("e"))
    edges = common.stored(edges.select("source", F.col("e.bucket").alias("edge"), F.col("e.room").alias("room")), "mix-edges")
    full = F.when(F.col("rest") > 0, F.col("buckets")).otherwise(0)
    sources = planned.alias("s").join(_small(edges, n_sources).alias("e"), F.col("s.source").eqNullSafe(F.col("e.source")), "left").select("s.source", "source_size", "target", "whole", "buckets", F.coalesce("edge", full).alias("edge"))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        docs = pdf.groupby("doc_id", dropna=False, as_index=False).agg(size=("size", "sum"), turn=("turn", "first")).sort_values(["turn", "doc_id"], na_position="first", ignore_index=True)
        room, taken = float(pdf.room.iloc[0]), []
        for size in docs["size"].tolist():
            taken.append(0 < size <= room)
            room -= size if taken[-1] else 0
        left = docs[[not t for t in taken]]
        left = left[(left["size"] < 2 * room)]
        docs["taken"] = taken
        if len(left):
            docs.loc[(left["size"] - room).abs().idxmin(), "taken"] = True
        got = docs[docs.taken]
        return pd.DataFrame({"source": [pdf.source.iloc[0]] * len(got), "doc_id": got.doc_id.astype("Int64")})

    inside = dealt.alias("d").join(_small(edges, n_sources).alias("e"), F.col("d.source").eqNullSafe(F.col("e.source")) & (F.col("d.bucket") == F.col("e.edge")))
    inside = inside.select("d.source", "d.doc_id", "d.size", "e.room", F.xxhash64("d.doc_id", F.lit(seed + 1)).alias("turn"))
    picks = common.stored(inside.groupBy("source").applyInPandas(fill, "source string, doc_id long"), "mix-picks")
    return Mix(common.stored(sources, "mix-plan"), picks, n_sources, picks.count(), seed)


def with_times(rows: DataFrame, mix: Mix) -> DataFrame:
    """rows (with doc_id and source) with source_size, target and times, how often the mix takes each."""
    r = rows.alias("r").join(_small(mix.sources, mix.n_sources).alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")))
    r = _picked(r, mix)
    again = (_bucket(F.col("r.doc_id"), F.col("s.buckets"), mix.seed) < F.col("s.edge")) | F.col("picked").isNotNull()
    return r.select("r.*", "s.source_size", "s.target", (F.col("s.whole") + again.cast("long")).alias("times"))


def _picked(r: DataFrame, mix: Mix) -> DataFrame:
    picks = mix.picks.select(F.col("source").alias("_s"), F.col("doc_id").alias("_d"), F.lit(True).alias("picked"))
    return r.join(_small(picks, mix.n_picks), F.col("r.source").eqNullSafe(F.col("_s")) & F.col("r.doc_id").eqNullSafe(F.col("_d")), "left")


def sized(docs: DataFrame) -> DataFrame:
    rows = common.plain(docs, {"doc_id": "long", "source": "string", "text": "string"})
    return common.stored(rows.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")


def mixed(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken of each row."""
    rows = sized(docs)
    return with_times(rows, plan(rows, **how)).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def repeated(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs, each as often as the mix takes it."""
    mix = plan(sized(docs), **how)
    keyed = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"))
    counted = with_times(keyed, mix).where("times > 0")
    return counted.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select("row.*")
