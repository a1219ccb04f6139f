"""Per-alignment statistics, their histograms and insert counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandframe.functions import cigar
from strandframe.schema import SECONDARY, UNMAPPED, has

LAST_BIN = 4096
MODES = {"mapped": cigar.summary_match, "unmapped": cigar.unmapped_bases, "edit": cigar.summary_edit, "score": cigar.summary_score}


def check_options(edge: int | None = None, stats: str | None = None, count: bool = False) -> None:
    if stats is not None and count:
        raise ValueError("--stats cannot be combined with --count")
    if edge is not None and count:
        raise ValueError("-e cannot be combined with --count")
    if edge is not None and edge < 0:
        raise ValueError("-e must be a positive integer")
    if stats is not None and stats not in MODES:
        raise ValueError(f"Do not understand {stats} as mode")


def primary(df: DataFrame, refs: DataFrame, edge: int = 0) -> DataFrame:
    """Mapped records that aren't secondary and stay edge bases away from both ends of their target."""
    rows = df.where(~has(UNMAPPED) & ~has(SECONDARY))
    joined = rows.join(refs.select(F.col("tid").alias("_tid"), F.col("rname").alias("_rname"), F.col("tlen").alias("_tlen")), F.col("tid") == F.col("_tid"))
    return joined.where((F.col("pos0") >= edge) & (F.col("_tlen") - cigar.reference_end() >= edge))


def rows(df: DataFrame, refs: DataFrame, edge: int = 0) -> DataFrame:
    """ord, qname, qlen, rname, glocal, match, identity (raw double)."""
    return primary(df, refs, edge).select(
        "ord", "qname", cigar.query_length().alias("qlen"), F.col("_rname").alias("rname"), cigar.glocal_length().alias("glocal"), cigar.summary_match().alias("match"), cigar.percent_identity().alias("identity")
    )


def clamped(value: Column) -> Column:
    return F.least(F.greatest(value, F.lit(0).cast("bigint")), F.lit(LAST_BIN).cast("bigint"))


def histogram(df: DataFrame, refs: DataFrame, mode: str, edge: int = 0) -> DataFrame:
    """bin, n; values below 0 are in bin 0 and those above the last bin in it."""
    check_options(stats=mode)
    return primary(df, refs, edge).groupBy(clamped(MODES[mode]()).alias("bin")).agg(F.count("*").alias("n"))


def totals(df: DataFrame, refs: DataFrame, edge: int = 0) -> DataFrame:
    """Sums of the four statistics."""
    return primary(df, refs, edge).agg(*[F.coalesce(F.sum(f()), F.lit(0)).alias(f"total_{name}") for name, f in MODES.items()])


def count_inserts(df: DataFrame, grouped: bool = True) -> DataFrame:
    """n: inserts among mapped records.

    For input grouped by read that is the number of reads. With grouped=False runs of equal qname in
    input order are counted; runs are found by ranges of ord, and only range ends meet in one place.
    """
    mapped = df.where(~has(UNMAPPED))
    if grouped:
        return mapped.agg(F.count_distinct("qname").alias("n"))
    ranged = mapped.select("ord", "qname").repartitionByRange("ord").withColumn("part", F.spark_partition_id())
    order = Window.partitionBy("part").orderBy("ord")
    marked = ranged.withColumn("change", F.coalesce((F.col("qname") != F.lag("qname").over(order)).cast("int"), F.lit(0)))
    ends = marked.groupBy("part").agg(F.min_by("qname", "ord").alias("first"), F.max_by("qname", "ord").alias("last"), F.sum("change").alias("changes"))
    between = F.coalesce((F.col("first") != F.lag("last").over(Window.orderBy("part"))).cast("int"), F.lit(1))
    return ends.select("changes", between.alias("between")).agg(F.coalesce(F.sum(F.col("changes") + F.col("between")), F.lit(0)).alias("n"))
