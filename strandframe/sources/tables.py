"""Genome definitions, profiles, manifests and other text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.sources.sam import input_order


def read_genomes(spark: SparkSession, path: str) -> DataFrame:
    """line_no, genome, rname; ValueError if a line has fewer than two words. line_no rises along the file."""
    lines = spark.read.text(path).select("value", input_order().alias("line_no")).where(F.trim("value") != "")
    words = F.split(F.trim("value"), r"\s+")
    bad = lines.where(F.size(words) < 2).head(1)
    if bad:
        raise ValueError(f"Malformed line in the genome definition: {bad[0].value}")
    return lines.select("line_no", words[0].alias("genome"), words[1].alias("rname"))


def read_profile(spark: SparkSession, path: str) -> DataFrame:
    """feature, value of a written profile (plain or gzip); ValueError on duplicates, negative or non-finite values, or a missing header."""
    lines = spark.read.text(path).select("value", input_order().alias("at")).where(~F.col("value").startswith("#") & (F.col("value") != ""))
    head = lines.orderBy("at").head(1)
    if not head or not head[0].value.startswith("ID\t"):
        raise ValueError("The profile has no ID header")
    f = F.split("value", "\t")
    rows = lines.where(F.col("at") != head[0].at).select(f[0].alias("feature"), f[1].try_cast("double").alias("value"))
    bad = rows.where(F.col("value").isNull() | F.isnan("value") | (F.col("value") < 0) | (F.col("value") == float("inf"))).head(1)
    if bad:
        raise ValueError(f"Bad value of {bad[0].feature}")
    twice = rows.groupBy("feature").count().where("count > 1").head(1)
    if twice:
        raise ValueError(f"{twice[0].feature} occurs twice")
    return rows


def read_tsv(spark: SparkSession, path: str, columns: list[str], status: str | None = None) -> DataFrame:
    """A table with a header that must hold the columns; with status only rows where that column is PASS."""
    df = spark.read.csv(path, sep="\t", header=True, inferSchema=False)
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"{path} lacks the columns {missing}")
    return df.where(F.col(status) == "PASS") if status else df


def fasta_counts(spark: SparkSession, path: str) -> DataFrame:
    """entries, bases: header lines and IUPAC letters of a FASTA file, in one pass."""
    lines = spark.read.text(path)
    header = F.col("value").startswith(">")
    bases = F.length(F.regexp_replace(F.upper("value"), "[^ACGTURYMKSWBDHVN]", ""))
    return lines.agg(F.coalesce(F.sum(header.cast("bigint")), F.lit(0)).alias("entries"), F.coalesce(F.sum(F.when(~header, bases).cast("bigint")), F.lit(0)).alias("bases"))


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """i, j, v of a tab-separated matrix whose first line names its columns."""
    lines = spark.read.text(path).select("value", input_order().alias("at")).where(F.trim("value") != "")
    head = lines.orderBy("at").head(1)
    if not head:
        raise ValueError("The matrix is empty")
    names = [x for x in head[0].value.split("\t") if x != ""]
    f = F.split("value", r"\t")
    cells = F.transform(F.slice(f, 2, len(names)), lambda x: x.cast("double"))
    rows = lines.where(F.col("at") != head[0].at).select(f[0].alias("i"), F.posexplode(cells).alias("k", "v"))
    return rows.select("i", F.get(F.array(*map(F.lit, names)), F.col("k")).alias("j"), "v")


def read_uints(spark: SparkSession, path: str) -> DataFrame:
    """at, value: a file of 32-bit numbers after their count."""
    import struct
    from collections.abc import Iterator

    import pandas as pd

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for raw in pdf.content:
                (n,) = struct.unpack_from("<I", raw)
                yield pd.DataFrame({"at": range(n), "value": list(struct.unpack_from(f"<{n}I", raw, 4))})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(decode, "at bigint, value bigint")
