"""Abundance profiles: inserts per feature, sharing of multi-mapped inserts, units.

Inserts with the same set of features are interchangeable, so everything after the first shuffle (by
read) works on classes of inserts with their counts, which a second, pre-aggregated shuffle makes.
"""

from __future__ import annotations

import tempfile
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MULTI = ("all", "equal", "proportional", "ignore")
UNITS = ("relative", "fpkm", "tpm", "abundance")
MAX_STEPS = 19
LEAST_DELTA = 1e-10
SNAP = 1e-20
#: Shared classes are iterated in the driver's memory up to so many (class, feature) pairs and features together, else by the executors.
DRIVER_PAIRS = 5_000_000
#: The executors keep packed classes and get the abundances of up to so many features at each step; beyond, classes are joined with features.
DRIVER_FEATURES = 10_000_000
#: Pairs of packed classes for each task, where there are more than for a task on each core; about so many in a row, and so many rows in a batch.
TASK_PAIRS, ROW_PAIRS, PACKED_ROWS = 20_000_000, 50_000, 16
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def by_prefix(value: str, names: tuple[str, ...], option: str) -> str:
    """The first name that begins with value; the empty value is the first name."""
    for name in names:
        if name.startswith(value):
            return name
    raise ValueError(f"Unknown value for {option}: {value}")


@dataclass
class Profile:
    """values: feature_ord (-1: Unknown), feature, value. The counts are in inserts."""

    values: DataFrame
    total: int
    mapped: int
    multi: int
    unique: int
    purged: float
    effective: float
    unknown_length: int | None
    classes: DataFrame

    def release(self) -> None:
        """Gives back the memory of what the values are made of; to be called when they are written."""
        self.classes.unpersist()


def identity_features(refs: DataFrame) -> tuple[DataFrame, None]:
    return refs.select(F.col("tid").cast("bigint").alias("fid"), F.col("rname").alias("feature"), F.col("tlen").alias("feature_len")), None


def genome_features(refs: DataFrame, genomes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Features by genome (fid: line of the genome's first appearance) and the map from tid to fid.

    A sequence named twice belongs to the genome named last. Every sequence must be a target and
    every target must have a genome.
    """
    last = genomes.groupBy("rname").agg(F.max_by("genome", "line_no").alias("genome"))
    first = genomes.groupBy("genome").agg(F.min("line_no").alias("fid"))
    both = last.join(refs.select("rname", F.lit(True).alias("_target")), "rname", "full")
    unknown, missing = both.agg(F.min(F.when(F.col("_target").isNull(), F.col("rname"))), F.min(F.when(F.col("genome").isNull(), F.col("rname")))).first()
    if unknown is not None:
        raise ValueError(f"Sequence '{unknown}' of the genome definition is not in the alignment header")
    if missing is not None:
        raise ValueError(f"Target '{missing}' has no genome in the genome definition")
    placed = refs.join(last, "rname").join(first, "genome").select("tid", "fid", "genome", "tlen")
    features = first.join(placed.groupBy("fid").agg(F.sum("tlen").alias("feature_len")), "fid", "left")
    return features.select("fid", F.col("genome").alias("feature"), F.coalesce("feature_len", F.lit(0)).alias("feature_len")), placed.select("tid", "fid")


def insert_classes(df: DataFrame, feature_map: DataFrame | None = None) -> DataFrame:
    """fids (sorted, distinct features of an insert) and n (inserts that have them). A record counts if it has a target."""
    rows = df.where("tid is not null").select("qname", F.col("tid"))
    rows = rows.select("qname", F.col("tid").cast("bigint").alias("fid")) if feature_map is None else rows.join(feature_map, "tid").select("qname", "fid")
    inserts = rows.groupBy("qname").agg(F.sort_array(F.collect_set("fid")).alias("fids"))
    return inserts.groupBy("fids").agg(F.count("*").alias("n"))


def counts(classes: DataFrame, *more: Column) -> DataFrame:
    """mapped, multi, unique and more aggregates: one row."""
    size = F.size("fids")
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return classes.agg(total(size >= 1).alias("mapped"), total(size > 1).alias("multi"), total(size == 1).alias("unique"), *more)


def unique_counts(classes: DataFrame) -> DataFrame:
    return classes.where(F.size("fids") == 1).groupBy(F.col("fids")[0].alias("fid")).agg(F.sum("n").cast("double").alias("value"))


def simple_shares(classes: DataFrame, multi: str) -> DataFrame:
    """fid, value for the modes that need no iteration."""
    if multi == "ignore":
        return unique_counts(classes)
    share = F.col("n").cast("double") if multi == "all" else F.col("n") / F.size("fids")
    return classes.select(F.explode("fids").alias("fid"), share.alias("share")).groupBy("fid").agg(F.sum("share").alias("value"))


def share_in_memory(class_of: np.ndarray, fid: np.ndarray, n: np.ndarray, unique: np.ndarray, features: int) -> tuple[np.ndarray, float, int]:
    """Abundances, purged inserts and steps. class_of, fid: the pairs; n: inserts per class; unique: per feature."""
    a = unique.astype(np.float64)
    classes = len(n)
    for step in range(1, MAX_STEPS + 1):
        s = np.bincount(class_of, a[fid], classes)
        rate = np.divide(n, s, out=np.zeros(classes), where=s > 0)
        new = unique + np.bincount(fid, rate[class_of] * a[fid], len(unique))
        new[new < SNAP] = 0
        delta = float(((new - a) ** 2).sum()) / features
        a = new
        if delta < LEAST_DELTA:
            break
    purged = float(n[np.bincount(class_of, a[fid], classes) <= 0].sum())
    return a, purged, step


def _checkpoint_folder(spark) -> None:
    """Uses the folder of spark.checkpoint.dir; where there is none (one machine), sets one."""
    if spark.conf.get("spark.checkpoint.dir", None) is None and spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="strandframe-"))


def _abundances(spark, names: np.ndarray, a: np.ndarray) -> DataFrame:
    return spark.createDataFrame(pa.table({"fid": pa.array(names, pa.int64()), "value": pa.array(a, pa.float64())}), "fid bigint, value double")


def _numbers(column: pa.Array, dtype) -> np.ndarray:
    """The numbers in the rows of a binary column, one after the other."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(memoryview(column.buffers()[2])[ends[0] : ends[-1]], dtype)


def share_packed(classes: DataFrame, features: int, pairs: int) -> tuple[DataFrame, float, int]:
    """As proportional_shares: the shared classes stay where they are, packed; features alone travel.

    At each step a task gets all abundances and returns the gains of its classes' features, added per feature and cut
    by ranges of features; a second task adds those of a range. So a step shuffles 8 bytes for each task and feature at most,
    whatever the pairs.
    """
    spark = classes.sparkSession
    sc = spark.sparkContext
    parts = max(sc.defaultParallelism, -(-pairs // TASK_PAIRS))
    few = classes.coalesce(parts)
    own = F.sum(F.when(F.size("fids") == 1, F.col("n")).otherwise(0)).cast("double")
    of_feature = few.select(F.explode("fids").alias("fid"), "fids", "n").groupBy("fid").agg(own.alias("own")).toArrow()
    names, unique = np.asarray(of_feature.column("fid"), dtype=np.int64), np.asarray(of_feature.column("own"))
    order = np.argsort(names)
    names, unique = names[order], unique[order]
    many = len(names)
    cuts = np.linspace(0, many, parts + 1).astype(np.int64)
    sent_names = sc.broadcast(names)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                lists = batch.column(0)
                at = np.searchsorted(sent_names.value, np.asarray(lists.flatten())).astype(np.int32)
                size, n = np.diff(np.asarray(lists.offsets)).astype(np.int32), np.asarray(batch.column(1), dtype=np.float64)
                ends = np.cumsum(size, dtype=np.int64)
                rows = np.flatnonzero(np.diff(ends // ROW_PAIRS, append=-1)) + 1
                for i, k in zip((0, *rows[:-1]), rows):
                    yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (at[ends[i] - size[i] : ends[k - 1]], size[i:k], n[i:k])], ["at", "size", "n"])

    def sums(batch: pa.RecordBatch, a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places and abundances of the pairs, sizes of the classes, and inserts and sums of the classes."""
        at, size, n = (_numbers(batch.column(k), t) for k, t in enumerate((np.int32, np.int32, np.float64)))
        met = a[at]
        return at, met, size, n, np.add.reduceat(met, np.cumsum(size, dtype=np.int64) - size)

    def gains_of(sent):
        def gains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            gain = None
            for batch in batches:
                if batch.num_rows:
                    at, met, size, n, s = sums(batch, sent.value)
                    if gain is None:
                        gain = np.zeros(many)
                    rate = np.divide(n, s, out=np.zeros(len(n)), where=s > 0)
                    np.add.at(gain, at, np.repeat(rate, size) * met)
            for k in range(parts if gain is not None else 0):
                of_range = gain[cuts[k] : cuts[k + 1]]
                some = np.flatnonzero(of_range)
                if len(some):
                    if 12 * len(some) < 8 * len(of_range):
                        row = [some.astype(np.int32).tobytes(), of_range[some].tobytes()]
                    else:
                        row = [None, of_range.tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *(pa.array([x], pa.binary()) for x in row)], ["part", "at", "gain"])

        return gains

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The gains of each range, from all tasks."""
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, at, gain in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                of_range = total.setdefault(k, np.zeros(cuts[k + 1] - cuts[k]))
                of_range[np.frombuffer(at.as_buffer(), np.int32) if at.is_valid else slice(None)] += np.frombuffer(gain.as_buffer())
        for k, of_range in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([of_range.tobytes()], pa.binary())], ["part", "gain"])

    def lost_of(sent):
        def lost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    *_, n, s = sums(batch, sent.value)
                    yield pa.RecordBatch.from_arrays([pa.array([n[s <= 0].sum()], pa.float64())], ["lost"])

        return lost

    packed = few.where(F.size("fids") > 1).select("fids", "n").mapInArrow(pack, "at binary, size binary, n binary").persist()
    before = spark.conf.get(ARROW_ROWS, None)
    try:
        packed.count()
        spark.conf.set(ARROW_ROWS, str(PACKED_ROWS))  # for the long rows
        a = unique
        for step in range(1, MAX_STEPS + 1):
            sent = sc.broadcast(a)
            made = packed.mapInArrow(gains_of(sent), "part int, at binary, gain binary").repartition(parts, "part").mapInArrow(added, "part int, gain binary").toArrow()
            new = unique.copy()
            for k, gain in zip(made.column("part").to_pylist(), made.column("gain")):
                new[cuts[k] : cuts[k + 1]] += np.frombuffer(gain.as_buffer())
            sent.destroy()
            new[new < SNAP] = 0
            delta = float(((new - a) ** 2).sum()) / features
            a = new
            if delta < LEAST_DELTA:
                break
        sent = sc.broadcast(a)
        purged = packed.mapInArrow(lost_of(sent), "lost double").agg(F.coalesce(F.sum("lost"), F.lit(0.0))).first()[0]
        sent.destroy()
    finally:
        spark.conf.set(ARROW_ROWS, before) if before else spark.conf.unset(ARROW_ROWS)
        packed.unpersist()
        sent_names.destroy()
    return _abundances(spark, names, a), purged, step


def proportional_shares(classes: DataFrame, features: int, driver_pairs: int = DRIVER_PAIRS, pairs: int | None = None, driver_features: int = DRIVER_FEATURES) -> tuple[DataFrame, float, int]:
    """fid, value; purged inserts; steps. Iterates until the mean squared change is small or MAX_STEPS are done.

    pairs: (class, feature) pairs of the shared classes, if known.
    """
    spark = classes.sparkSession
    unique = unique_counts(classes)
    shared = classes.where(F.size("fids") > 1)
    if pairs is None:
        pairs = shared.agg(F.coalesce(F.sum(F.size("fids")), F.lit(0))).first()[0]
    if pairs + features <= driver_pairs:
        t = shared.toArrow()
        lists = t.column("fids").combine_chunks()
        sizes = np.diff(np.asarray(lists.offsets)) if t.num_rows else np.empty(0, np.int64)
        u = unique.toArrow()
        names, fid = np.unique(np.concatenate([np.asarray(lists.flatten()) if t.num_rows else np.empty(0, np.int64), np.asarray(u.column("fid"), dtype=np.int64)]), return_inverse=True)
        many = int(sizes.sum())
        own = np.zeros(len(names))
        own[fid[many:]] = np.asarray(u.column("value"))
        a, purged, steps = share_in_memory(np.repeat(np.arange(t.num_rows), sizes), fid[:many], np.asarray(t.column("n"), dtype=np.float64), own, features)
        return _abundances(spark, names, a), purged, steps
    if features <= driver_features:
        return share_packed(classes, features, pairs)
    return share_joined(shared, unique, features)


def share_joined(shared: DataFrame, unique: DataFrame, features: int) -> tuple[DataFrame, float, int]:
    """As proportional_shares, for any number of features; every step shuffles all pairs."""
    spark = shared.sparkSession
    _checkpoint_folder(spark)
    exploded = shared.withColumn("cid", F.xxhash64("fids", F.lit(1))).withColumn("cid2", F.xxhash64("fids", F.lit(2))).select("cid", "cid2", "n", F.explode("fids").alias("fid")).checkpoint()
    base = unique.checkpoint()
    a = base
    of_class = Window.partitionBy("cid", "cid2")
    for step in range(1, MAX_STEPS + 1):
        met = exploded.join(a, "fid", "left").withColumn("value", F.coalesce("value", F.lit(0.0))).withColumn("s", F.sum("value").over(of_class))
        gain = met.where("s > 0").groupBy("fid").agg(F.sum(F.col("n") * F.col("value") / F.col("s")).alias("gain"))
        new = base.withColumnRenamed("value", "own").join(gain, "fid", "full").select("fid", (F.coalesce("own", F.lit(0.0)) + F.coalesce("gain", F.lit(0.0))).alias("value"))
        new = new.withColumn("value", F.when(F.col("value") < SNAP, 0.0).otherwise(F.col("value"))).checkpoint()
        change = F.coalesce("after", F.lit(0.0)) - F.coalesce("before", F.lit(0.0))
        both = new.withColumnRenamed("value", "after").join(a.withColumnRenamed("value", "before"), "fid", "full")
        delta = (both.agg(F.sum(change * change)).first()[0] or 0.0) / features
        a = new
        if delta < LEAST_DELTA:
            break
    left = exploded.join(a, "fid", "left").groupBy("cid", "cid2").agg(F.first("n").alias("n"), F.sum(F.coalesce("value", F.lit(0.0))).alias("s"))
    purged = float(left.where("s <= 0").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    return a, purged, step


def profile(
    df: DataFrame,
    refs: DataFrame,
    genomes: DataFrame | None = None,
    multi: str = "proportional",
    unit: str = "relative",
    total: int | None = None,
    mincount: int | None = None,
    nolen: bool = False,
) -> Profile:
    multi, unit = by_prefix(multi, MULTI, "--multi"), by_prefix(unit, UNITS, "--unit")
    if total is not None and total <= 0:
        raise ValueError("--total must be a positive integer")
    if mincount is not None and mincount < 0:
        raise ValueError("--mincount must be a non-negative integer")
    features, feature_map = identity_features(refs) if genomes is None else genome_features(refs, genomes)
    n_features, total_length = features.agg(F.count("*"), F.coalesce(F.sum("feature_len"), F.lit(0))).first()
    classes = insert_classes(df, feature_map).persist()
    mapped, many, unique, pairs = counts(classes, F.coalesce(F.sum(F.when(F.size("fids") > 1, F.size("fids"))), F.lit(0))).first()
    purged = 0.0
    if multi == "proportional":
        shares, purged, _ = proportional_shares(classes, max(1, n_features), pairs=pairs)
        classes.unpersist()  # the shares are a table of their own
    else:
        shares = simple_shares(classes, multi)
    values = features.join(shares, "fid", "left").select("fid", "feature", "feature_len", F.coalesce("value", F.lit(0.0)).alias("value"))
    if mincount:
        low = F.col("value") < mincount
        purged += values.agg(F.coalesce(F.sum(F.when(low, F.col("value"))), F.lit(0.0))).first()[0]
        values = values.withColumn("value", F.when(low, 0.0).otherwise(F.col("value")))
    if total is not None and total < mapped:
        warnings.warn(f"Ignoring 'unknown' fraction, as total inserts ({total}) < mapped inserts ({mapped})!", stacklevel=2)
        total = None
    by_length = unit in ("fpkm", "tpm") or not nolen
    unknown, unknown_length = 0.0, None
    if total is not None:
        unknown = float(total - mapped + purged + (many if multi == "ignore" else 0))
        if by_length:
            unknown_length = int(total_length) // max(1, n_features)
            unknown /= unknown_length or float("nan")
    if by_length:
        values = values.withColumn("value", F.when(F.col("feature_len") > 0, F.col("value") / F.nullif("feature_len", F.lit(0))).otherwise(F.lit(float("nan"))))
    rows = values.select(F.col("fid").alias("feature_ord"), "feature", "value")
    rows = rows.unionByName(df.sparkSession.range(1).select(F.lit(-1).cast("bigint").alias("feature_ord"), F.lit("Unknown").alias("feature"), F.lit(unknown).alias("value")))
    effective = mapped - purged - (many if multi == "ignore" else 0)
    return Profile(in_unit(rows, unit, total or mapped), -1 if total is None else total, mapped, many, unique, purged, effective, unknown_length, classes)


def in_unit(rows: DataFrame, unit: str, inserts: int) -> DataFrame:
    if unit == "abundance":
        return rows
    if unit == "fpkm":
        return rows.withColumn("value", F.col("value") * F.lit(1e9 / inserts if inserts else float("nan")))
    whole = rows.agg(F.sum("value")).first()[0]
    return rows.withColumn("value", F.col("value") * F.lit(1e6 if unit == "tpm" else 1.0) / F.lit(whole) if whole else F.lit(float("nan")))


def relative(value: Column, whole: Column) -> Column:
    """value / whole; not a number if whole is 0."""
    return F.when(whole == 0, F.lit(float("nan"))).otherwise(value / F.nullif(whole, F.lit(0.0)))
