"""Row-wise operators on streams of alignments, and running insert counts with bounded state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.operators import filter as filters
from strandframe.schema import UNMAPPED, has


def filter_stream(df: DataFrame, options: filters.FilterOptions) -> DataFrame:
    """Thresholds and rescoring of a streaming DataFrame; best hits need whole reads and aren't row-wise."""
    if options.needs_grouping:
        raise ValueError("best hits need all records of a read: use best_hits on each batch of whole reads")
    return filters.filter_alignments(df, options)


def best_hits_batches(df: DataFrame, options: filters.FilterOptions, write, checkpoint: str):
    """A query that filters each micro-batch with best hits; reads must not be split over batches. write(df, batch_id) stores one."""
    return df.writeStream.foreachBatch(lambda batch, n: write(filters.filter_alignments(batch, options), n)).option("checkpointLocation", checkpoint)


def target_counts(df: DataFrame) -> DataFrame:
    """Running numbers of mapped records per target; state is one row per target."""
    return df.where(~has(UNMAPPED) & F.col("tid").isNotNull()).groupBy("tid").agg(F.count("*").alias("records"))
