"""A corpus pipeline of four stages: language, near copies, mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written as
Parquet and read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandframe.llm import common, language_id, mixing, packing, simhash, tokens


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised stay."""
    return language_id.keep_identified(docs, language_id.fit(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest doc_id."""
    return simhash.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for."""
    return mixing.repeated(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens. Workers that served the stages before have less room to remember."""
    return packing.pack(docs, tokens.default_path(), end_id=1, capacity=2048, cache_entries=150_000, slice_chars=1_000_000)


STAGES = [("language", identify_language), ("near_copies", drop_near_copies), ("mixture", mix_sources), ("packing", pack_sequences)]

#: A trained network and sampling by hash aren't SQL; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, common.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        common.discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
