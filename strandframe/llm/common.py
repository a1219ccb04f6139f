"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys with more than total / HEAVY_KEYS rows, and more than HEAVY_ROWS, are joined apart.
HEAVY_KEYS, HEAVY_ROWS = 1000, 64
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Whole texts, or lists for each word, in a batch.
WIDE_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Only where that setting is absent (tests, one machine) a local folder is made and set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    known = spark.sparkContext.getCheckpointDir()
    if known is None:
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="strandframe-"))
        known = spark.sparkContext.getCheckpointDir()
    return known.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Paths of stored tables by open scope, innermost last.
_SCOPES: list[list[str]] = []


def stored(df: DataFrame, name: str, outlives: bool = False, batch: int | None = None) -> DataFrame:
    """df written as Parquet into the shared folder and read again: its lineage ends there.

    Within scratch() the table goes when the scope ends, or with outlives the scope around it. batch: rows
    that travel to and from Python at once, for wide rows.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(ARROW_ROWS, None)
    if batch:
        spark.conf.set(ARROW_ROWS, str(batch))
    try:
        df.write.parquet(path)
    finally:
        if batch:
            spark.conf.set(ARROW_ROWS, before) if before else spark.conf.unset(ARROW_ROWS)
    scopes = _SCOPES[:-1] if outlives else _SCOPES
    if scopes:
        scopes[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(df: DataFrame) -> None:
    """Deletes the table of a DataFrame that stored() returned; of any other nothing."""
    if path := getattr(df, "_stored_at", None):
        delete(df.sparkSession, path)


@contextmanager
def scratch(spark: SparkSession):
    """Tables stored inside are deleted at the end. What is lazily read from them must be stored, to outlive it."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            delete(spark, path)


def join_unique(big: DataFrame, small: DataFrame, on: str, how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """big joined (inner, left or left_semi) with small, which has one row per key; no key of big lands in one task.

    Keys with over a thousandth of big's rows, so a thousand at most, are joined by broadcasting small's
    rows of them; the others by Spark's choice. big is read more than once, so it should be a stored table.
    counts: on and n, how often big has each key (more is harmless), if known.
    """
    if counts is None:
        counts = big.where(F.col(on).isNotNull()).groupBy(on).agg(F.count("*").alias("n"))
    least = max(HEAVY_ROWS, big.count() / HEAVY_KEYS)
    hot = [r[0] for r in counts.where(F.col("n") > least).select(on).collect()]
    if not hot:
        return big.join(small, on, how)
    keys = big.sparkSession.createDataFrame([(k,) for k in hot], big.select(on).schema)
    of_hot = small.join(F.broadcast(keys), on, "left_semi")
    heavy = big.join(F.broadcast(keys), on, "left_semi").join(F.broadcast(of_hot), on, how)
    return heavy.unionByName(big.join(F.broadcast(keys), on, "left_anti").join(small, on, how))


def sliced(batches: Iterator[pa.RecordBatch], rows: int = WIDE_ROWS) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many rows; when there are no more, the worker gives back the memory that it doesn't use."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)
    release()


def release() -> None:
    """Unused memory of this process back to the system, for the workers and the JVM beside it."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # only the GNU C library has it
        ctypes.CDLL(None).malloc_trim(0)


def filesystem(uri: str):
    """(pyarrow file system, path in it) of a file:, hdfs:, s3: or gs: address or a plain path."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def plain(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Only the named columns, cast to the types; what is absent becomes null.

    Other columns, whatever they are called, don't reach the operator.
    """
    have = {c.lower(): c for c in df.columns}
    return df.select(*[(F.col(f"`{have[c.lower()]}`") if c.lower() in have else F.lit(None)).cast(t).alias(c) for c, t in types.items()])
