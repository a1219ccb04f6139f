"""Simulated alignments with known truth: inserts drawn from genomes and placed wherever they occur.

An insert aligns to every genome that holds its fragment, on either strand, so genomes that share
stretches get multi-mapped inserts. Everything that is drawn comes from hashes of the insert's number and the
seed, so a run can be repeated and doesn't depend on partitions.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandframe.operators.metrics import reverse_complement
from strandframe.schema import PAIRED, READ1, READ2, SECONDARY

READ_LENGTH, INSERT_LENGTH = 100, 175
PROPER, MATE_UNMAPPED, REVERSE, MATE_REVERSE = 0x2, 0x8, 0x10, 0x20
#: Chances of 0, 1, 2 and 3 mismatches in a read, added up.
MISMATCHES = (0.5, 0.8, 0.9, 1.0)
SINGLE_MATE = 0.05


def random_genomes(names: list[str], length: int, shared: float, seed: int) -> list[tuple[str, str]]:
    """(name, sequence): random letters; all but the first copy a stretch of that share of the length from the one before."""
    rng = np.random.default_rng(seed)
    out: list[tuple[str, str]] = []
    for name in names:
        seq = rng.choice(np.frombuffer(b"ACGT", np.uint8), length)
        if out and shared:
            n = int(length * shared)
            at = int(rng.integers(0, length - n + 1))
            seq[at : at + n] = np.frombuffer(out[-1][1].encode(), np.uint8)[at : at + n]
        out.append((name, seq.tobytes().decode()))
    return out


def draw(key: Column, seed: int, n: int) -> Column:
    """A number in [0, 1) for a key."""
    return F.pmod(F.xxhash64(key, F.lit(seed), F.lit(n)), F.lit(1 << 40)) / F.lit(float(1 << 40))


def windows(genomes: DataFrame, size: int) -> DataFrame:
    """name, at (from 0), fragment of every window; genomes: name, seq."""
    places = genomes.where(F.length("seq") >= size).select("name", "seq", F.explode(F.sequence(F.lit(0), F.length("seq") - size)).alias("at"))
    return places.select("name", "at", F.substring("seq", F.col("at") + 1, F.lit(size)).alias("fragment"))


def occurrences(fragments: DataFrame, genomes: DataFrame, size: int = INSERT_LENGTH) -> DataFrame:
    """fragments (insert, fragment) with name, at, reverse for each place that holds the fragment or its reverse complement; an equi-join on a hash, verified."""
    held = windows(genomes, size).select("name", "at", F.col("fragment").alias("_held"), F.xxhash64("fragment").alias("_hash"))
    both = fragments.select("insert", "fragment", F.explode(F.array(F.lit(False), F.lit(True))).alias("reverse"))
    both = both.withColumn("_want", F.when(F.col("reverse"), reverse_complement("fragment")).otherwise(F.col("fragment"))).withColumn("_hash", F.xxhash64("_want"))
    return both.join(held, "_hash").where("_held = _want").select("insert", "name", "at", "reverse", F.col("_held").alias("fragment"))


def source_inserts(genomes: DataFrame, counts: DataFrame, seed: int) -> DataFrame:
    """insert, name, fragment: so many inserts (counts: name, share) at drawn places of each genome."""
    rows = genomes.join(counts, "name").where("share > 0").select("name", "seq", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("share"))).alias("k"))
    rows = rows.withColumn("insert", F.concat_ws("_", "name", F.lpad(F.col("k").cast("string"), 9, "0")))
    at = F.floor(draw(F.col("insert"), seed, 0) * (F.length("seq") - INSERT_LENGTH + 1)).cast("int")
    return rows.select("insert", "name", F.substring("seq", at + 1, F.lit(INSERT_LENGTH)).alias("fragment"))


def md_string(fragment: Column, places: Column) -> Column:
    """MD of a read whose mismatches are at the places (from 0, rising) of the fragment's letters."""
    n = F.size(places)
    before = F.concat(F.array(F.lit(-1)), places)
    steps = F.zip_with(places, F.slice(before, 1, n), lambda p, b: F.concat((p - b - 1).cast("string"), F.substring(fragment, p + 1, F.lit(1))))
    return F.concat(F.array_join(steps, ""), (F.length(fragment) - 1 - F.element_at(before, -1)).cast("string"))


def alignments(inserts: DataFrame, genomes: DataFrame, refs: DataFrame, seed: int) -> DataFrame:
    """Records of the inserts: ord (insert and number in it), qname, flag, tid, rname, pos0, cigar, as_score, nm, md. refs: tid, rname, tlen."""
    places = occurrences(inserts.select("insert", "fragment"), genomes).join(refs.select("tid", F.col("rname").alias("name")), "name")
    single = draw(F.col("insert"), seed, 1) < SINGLE_MATE
    mates = F.when(single, F.array(F.lit(1))).otherwise(F.array(F.lit(1), F.lit(2)))
    rows = places.select("*", single.alias("single"), F.explode(mates).alias("mate"))
    ahead = (F.col("mate") == 1) != F.col("reverse")  # the mate that lies at the left end
    pos = F.col("at") + F.when(ahead, 0).otherwise(INSERT_LENGTH - READ_LENGTH)
    part = F.when(ahead, F.left("fragment", F.lit(READ_LENGTH))).otherwise(F.right("fragment", F.lit(READ_LENGTH)))
    key = F.concat_ws("/", "insert", F.col("mate").cast("string"), "name", F.col("at").cast("string"))
    x = draw(key, seed, 2)
    nm = sum(((x >= F.lit(c)).cast("int") for c in MISMATCHES[:-1]), F.lit(0))
    first = F.floor(draw(key, seed, 3) * 30).cast("int")
    spots = F.when(nm == 0, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(nm, F.lit(1))), lambda k: first + (k - 1) * 31))
    rows = rows.select("insert", "tid", F.col("name").alias("rname"), "reverse", "single", "mate", ahead.alias("ahead"), pos.cast("bigint").alias("pos0"), part.alias("part"), nm.alias("nm"), spots.alias("spots"))
    turn = F.row_number().over(Window.partitionBy("insert").orderBy("tid", "pos0", "mate"))
    best = F.row_number().over(Window.partitionBy("insert", "mate").orderBy("nm", "tid", "pos0"))
    bits = F.when(F.col("mate") == 1, READ1).otherwise(READ2) + PAIRED + F.when(F.col("single"), MATE_UNMAPPED).otherwise(PROPER) + F.when(F.col("ahead"), F.when(F.col("single"), 0).otherwise(MATE_REVERSE)).otherwise(REVERSE)
    rows = rows.withColumn("turn", turn).withColumn("best", best)
    return rows.select(
        F.struct("insert", "turn").alias("ord"),
        F.col("insert").alias("qname"),
        (bits + F.when(F.col("best") > 1, SECONDARY).otherwise(0)).cast("int").alias("flag"),
        "tid",
        "rname",
        "pos0",
        F.lit(f"{READ_LENGTH}M").alias("cigar"),
        (READ_LENGTH - 2 * F.col("nm")).alias("as_score"),
        "nm",
        md_string(F.col("part"), F.col("spots")).alias("md"),
    )


def genome_frames(spark: SparkSession, genomes: list[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """(name, seq) and the reference dictionary."""
    seqs = spark.createDataFrame(genomes, "name string, seq string")
    refs = spark.createDataFrame([(k, n, len(s)) for k, (n, s) in enumerate(genomes)], "tid int, rname string, tlen bigint")
    return seqs, refs
