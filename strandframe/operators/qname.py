"""Whether input is grouped by read: the header's word, else a look at the first records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandframe.schema import PAIRED, SECONDARY, SUPPLEMENTARY, UNMAPPED, Header, has

GROUP_RECORDS = 10_000
ORDER_RECORDS = 100_000
ORDER_LEAST = 10_000
ADVICE = "Please sort the input by read name."


@dataclass(frozen=True)
class QNameCheck:
    status: str  # not_required, header_confirmed, sample_ok or sample_warning
    qname_records: int = 0
    input_records: int = 0
    mapped_records: int = 0

    @property
    def message(self) -> str:
        head = "QNAME grouping check: "
        if self.status == "not_required":
            return head + "not required for this operation"
        if self.status == "header_confirmed":
            return head + "confirmed by input header SO:queryname"
        if self.status == "sample_ok":
            part = "all" if self.input_records < GROUP_RECORDS else "first"
            return head + f"no QNAME grouping violation detected in {part} {self.qname_records} records"
        return (
            head + f"WARNING - no QNAME grouping violation detected in first {self.qname_records} records; {self.mapped_records} mapped records "
            f"among the first {self.input_records} input records were consistent with coordinate ordering"
        )


NOT_REQUIRED = QNameCheck("not_required")


def runs(df: DataFrame, records: int = GROUP_RECORDS) -> DataFrame:
    """qname, run, first, last (record numbers from 1) of each run of equal qname among the first records."""
    order = Window.orderBy("ord")
    head = df.select("ord", "qname").orderBy("ord").limit(records).withColumn("record", F.row_number().over(order))
    starts = F.coalesce((F.col("qname") != F.lag("qname").over(order)).cast("int"), F.lit(1))
    return head.withColumn("run", F.sum(starts).over(order)).groupBy("run").agg(F.first("qname").alias("qname"), F.min("record").alias("first"), F.max("record").alias("last"))


def reopened(df: DataFrame, records: int = GROUP_RECORDS) -> DataFrame:
    """qname, first (record where it reappears), previous_last, of each run of a qname after its first run."""
    previous = F.lag("last").over(Window.partitionBy("qname").orderBy("run"))
    return runs(df, records).withColumn("previous_last", previous).where("previous_last is not null").select("qname", F.col("first").cast("bigint").alias("first"), F.col("previous_last").cast("bigint").alias("previous_last"))


def order_statistics(df: DataFrame, records: int = ORDER_RECORDS) -> DataFrame:
    """input_records, mapped_records, coordinate_ordered, relevant of the first records: one row."""
    head = df.select("ord", "flag", "tid", "pos0").orderBy("ord").limit(records)
    place = F.when(~has(UNMAPPED) & F.col("tid").isNotNull(), F.struct("tid", "pos0"))
    before = F.last(F.col("place"), ignorenulls=True).over(Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1))
    marked = head.withColumn("place", place).withColumn("before", before)
    return marked.agg(
        F.count("*").alias("input_records"),
        F.count("place").alias("mapped_records"),
        (F.coalesce(F.sum((F.col("place") < F.col("before")).cast("int")), F.lit(0)) == 0).alias("coordinate_ordered"),
        F.coalesce(F.max(has(PAIRED | SECONDARY | SUPPLEMENTARY)), F.lit(False)).alias("relevant"),
    )


def check_grouping(df: DataFrame, header: Header) -> QNameCheck:
    """Raises if the header or the first records say that the input isn't grouped."""
    if header.sort_order == "queryname":
        return QNameCheck("header_confirmed")
    if header.sort_order == "coordinate":
        raise ValueError(f"Input SAM/BAM declares 'SO:coordinate', but this operation requires records to be grouped by QNAME.\n{ADVICE}")
    again = reopened(df).orderBy("first").head(1)
    if again:
        r = again[0]
        raise ValueError(
            f"SAM/BAM file is not grouped by QNAME. Read '{r.qname}' reappears at record {r.first} after its previous group ended at record "
            f"{r.previous_last} ({r.first - r.previous_last - 1} intervening records). {ADVICE}"
        )
    seen = order_statistics(df).first()
    checked = min(seen.input_records, GROUP_RECORDS)
    warn = seen.coordinate_ordered and seen.relevant and seen.mapped_records >= ORDER_LEAST
    return QNameCheck("sample_warning" if warn else "sample_ok", checked, seen.input_records, seen.mapped_records)
