"""Depth of coverage: +1/-1 events and running sums over pieces of targets.

Blocks are cut at piece borders, so every piece of PIECE positions is summed by itself: a long or
deeply covered target is many tasks' work, and events of one position are added before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandframe.functions import cigar

PIECE = 1 << 20


def blocks(df: DataFrame, refs: DataFrame, touches: bool = False) -> DataFrame:
    """tid, start, end of each aligned block of each record with a target, clipped to the target.

    With touches each record also has an empty block at 0.
    """
    found = cigar.aligned_blocks()
    if touches:
        zero = F.lit(0).cast("bigint")
        found = F.concat(F.array(F.struct(zero.alias("start"), zero.alias("end"))), F.coalesce(found, F.array().cast("array<struct<start:bigint,end:bigint>>")))
    cut = df.where("tid is not null").select("tid", F.explode(found).alias("b")).join(refs.select("tid", F.col("tlen").alias("_tlen")), "tid")
    start, end = F.greatest(F.col("b.start"), F.lit(0).cast("bigint")), F.least(F.col("b.end"), F.col("_tlen"))
    return cut.select("tid", start.alias("start"), end.alias("end")).where("start < end or end = 0" if touches else "start < end")


def _events(cut: DataFrame) -> DataFrame:
    """tid, piece, at, d: the starts and ends of blocks, by piece."""
    pieces = cut.withColumn("piece", F.explode(F.expr(f"sequence(start div {PIECE}, (end - 1) div {PIECE})")))
    low, high = F.col("piece") * PIECE, (F.col("piece") + 1) * PIECE
    start, end = F.greatest("start", low), F.least("end", high)
    return pieces.select("tid", "piece", F.explode(F.array(F.struct(start.alias("at"), F.lit(1).alias("d")), F.struct(end.alias("at"), F.lit(-1).alias("d")))).alias("e")).select("tid", "piece", "e.at", "e.d")


def _running(events: DataFrame, keep_even: bool = False) -> DataFrame:
    """tid, start, end, depth of each stretch between events of a piece. keep_even: also where as many blocks end as start."""
    summed = events.groupBy("tid", "piece", "at").agg(F.sum("d").alias("d"))
    order = Window.partitionBy("tid", "piece").orderBy("at")
    rows = summed if keep_even else summed.where("d <> 0")
    return rows.select("tid", F.col("at").alias("start"), F.lead("at").over(order).alias("end"), F.sum("d").over(order).alias("depth"))


def segments(df: DataFrame, refs: DataFrame) -> DataFrame:
    """tid, start, end, depth of each covered stretch of equal depth (stretches also end at piece borders)."""
    return _running(_events(blocks(df, refs))).where("depth > 0")


def summary(df: DataFrame, refs: DataFrame, skip_uncovered: bool = False) -> DataFrame:
    """tid, rname, touched (any record at all), breadth, mean_depth of each target. Records are read once."""
    width = F.when(F.col("depth") > 0, F.col("end") - F.col("start")).otherwise(0)
    sums = _running(_events(blocks(df, refs, touches=True)), keep_even=True).groupBy("tid").agg(F.sum(width).alias("covered"), F.sum(width * F.col("depth")).alias("bases"))
    out = refs.join(sums.withColumn("touched", F.lit(True)), "tid", "inner" if skip_uncovered else "left")
    # a target without positions has no share
    share = lambda c: F.when(F.col("tlen") == 0, F.lit(float("nan"))).otherwise(F.coalesce(F.col(c), F.lit(0)).cast("double") / F.nullif("tlen", F.lit(0)))
    return out.select("tid", "rname", F.coalesce("touched", F.lit(False)).alias("touched"), share("covered").alias("breadth"), share("bases").alias("mean_depth"))


def positions(df: DataFrame, refs: DataFrame, skip_uncovered: bool = False) -> DataFrame:
    """tid, pos, depth of every position, zeros too.

    Events without effect at the borders of all pieces make stretches of depth 0 where nothing lies, so
    positions come from stretches of at most PIECE of them, without a join.
    """
    targets = refs.where("tlen > 0")
    if skip_uncovered:
        targets = targets.join(df.where("tid is not null").select("tid").distinct(), "tid", "left_semi")
    pieces = targets.select("tid", "tlen", F.explode(F.expr(f"sequence(0L, (tlen - 1) div {PIECE})")).alias("piece"))
    ends = F.array(F.col("piece") * PIECE, F.least((F.col("piece") + 1) * PIECE, F.col("tlen")))
    borders = pieces.select("tid", "piece", F.explode(ends).alias("at"), F.lit(0).alias("d"))
    stretches = _running(_events(blocks(df, refs)).unionByName(borders), keep_even=True).where("end is not null")
    return stretches.select("tid", F.explode(F.expr("sequence(start, end - 1)")).alias("pos"), F.col("depth").cast("bigint").alias("depth"))
