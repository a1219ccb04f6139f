"""Filtering alignments by length, identity and aligned share of the query; best hits per read."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandframe.functions import cigar
from strandframe.schema import READ1, READ2, UNMAPPED, has, mate_bucket


@dataclass(frozen=True)
class FilterOptions:
    """None means the option wasn't given; 0 switches a threshold off."""

    min_length: int | None = None
    percent_identity: int | None = None
    ppt: int | None = None
    min_query_percent: int | None = None
    invert: bool = False
    keep_unmapped: bool = False
    rescore: bool = False
    besthit: bool = False
    uniqhit: bool = False

    def __post_init__(self):
        if self.invert and (self.besthit or self.uniqhit):
            raise ValueError("--invert cannot be combined with --besthit or --uniqhit")
        if self.besthit and self.uniqhit:
            raise ValueError("--besthit cannot be combined with --uniqhit")
        if self.percent_identity is not None and self.ppt is not None:
            raise ValueError("-p cannot be combined with --ppt")
        if not (self.besthit or self.uniqhit) and all(v is None for v in (self.min_length, self.percent_identity, self.ppt, self.min_query_percent)):
            raise ValueError("--mode filter needs -l, -p, --ppt, -z, --besthit or --uniqhit")
        if self.percent_identity is not None and not 0 <= self.percent_identity <= 100:
            raise ValueError("-p must be in the range [0,100]")
        if self.ppt is not None and not -1000 <= self.ppt <= 1000:
            raise ValueError("--ppt must be in the range [-1000,1000]")
        if self.min_query_percent is not None and not 0 <= self.min_query_percent <= 100:
            raise ValueError("-z must be in the range [0,100]")
        if self.min_length is not None and self.min_length < 0:
            raise ValueError("-l must be a non-negative integer")
        if not (self.besthit or self.uniqhit or self.has_threshold):
            raise ValueError("No active filter: every threshold is zero")

    @property
    def permille(self) -> int:
        return 10 * self.percent_identity if self.percent_identity is not None else self.ppt or 0

    @property
    def has_threshold(self) -> bool:
        return bool(self.min_length or self.permille or self.min_query_percent)

    @property
    def needs_grouping(self) -> bool:
        return self.besthit or self.uniqhit


def passes(options: FilterOptions) -> Column:
    """The conjunction of the thresholds, for a mapped record."""
    conditions = []
    if options.min_length:
        conditions.append(cigar.alignment_length() >= options.min_length)
    if options.permille > 0:
        conditions.append(1000 * (cigar.alignment_length() - cigar.edit_distance()) >= cigar.alignment_length() * options.permille)
    if options.permille < 0:
        conditions.append(1000 * (cigar.alignment_length() - cigar.edit_distance()) <= cigar.alignment_length() * -options.permille)
    if options.min_query_percent:
        conditions.append(100 * cigar.query_clip() <= (100 - options.min_query_percent) * cigar.query_length())
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def keeps(options: FilterOptions) -> Column:
    mapped = ~has(UNMAPPED)
    condition = passes(options)
    kept = mapped & (~condition if options.invert else condition)
    if options.keep_unmapped and options.invert and options.permille >= 0 and options.has_threshold:
        kept = kept | has(UNMAPPED)
    return kept


def rescore(df: DataFrame) -> DataFrame:
    """A new AS for mapped records, as the last tag."""
    score = F.when(~has(UNMAPPED), cigar.rescored()).otherwise(F.col("as_score"))
    out = df.withColumn("as_score", score)
    if "tags" in df.columns:
        others = F.filter(F.coalesce("tags", F.array().cast("array<string>")), lambda t: ~t.startswith("AS:"))
        out = out.withColumn("tags", F.when(~has(UNMAPPED), F.concat(others, F.array(F.concat(F.lit("AS:i:"), F.col("as_score").cast("string"))))).otherwise(F.col("tags")))
    return out


def best_hits(df: DataFrame, unique: bool = False) -> DataFrame:
    """Records with the largest AS of their read and mate; with unique only where one record has it.

    One shuffle by qname serves both windows: the finer one comes first, so its order serves the other.
    """
    mate = Window.partitionBy("qname", "_mate")
    rows = df.repartition("qname").withColumn("_mate", mate_bucket())
    score = F.coalesce(F.col("as_score").cast("bigint"), F.lit(-(1 << 40)))
    rows = rows.withColumn("_best", F.max(score).over(mate)).withColumn("_times", F.sum((score == F.col("_best")).cast("int")).over(mate))
    rows = rows.withColumn("_paired", F.max(F.col("_mate") != 0).over(Window.partitionBy("qname")))
    considered = ~F.col("_paired") | F.col("_mate").isin(READ1, READ2)
    known = F.when(F.col("as_score").isNotNull(), score).otherwise(F.raise_error(F.concat(F.lit("Alignment of '"), F.coalesce("qname", F.lit("")), F.lit("' has no AS"))).cast("bigint"))
    out = rows.where(F.when(considered, known == F.col("_best")).otherwise(False))
    if unique:
        out = out.where("_times = 1")
    return out.drop("_mate", "_best", "_times", "_paired")


def filter_alignments(df: DataFrame, options: FilterOptions) -> DataFrame:
    """Predicates come before best hits: a record that fails can't hide another."""
    if options.rescore:
        df = rescore(df)
    df = df.where(keeps(options))
    return best_hits(df, options.uniqhit) if options.needs_grouping else df


def output_order(df: DataFrame, options: FilterOptions) -> DataFrame:
    """Input order; with best hits by read, mate and input order."""
    if not options.needs_grouping:
        return df.orderBy("ord")
    first = F.min("ord").over(Window.partitionBy("qname"))
    return df.withColumn("_first", first).orderBy("_first", mate_bucket(), "ord").drop("_first")
