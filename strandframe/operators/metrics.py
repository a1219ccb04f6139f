"""How close estimated abundances are to the truth, and helpers of simulations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def paired(truth: DataFrame, estimate: DataFrame, by: list[str]) -> DataFrame:
    """by..., t, e: features that one side lacks are 0 there. Inputs: by..., feature, value."""
    met = truth.withColumnRenamed("value", "t").join(estimate.withColumnRenamed("value", "e"), [*by, "feature"], "full")
    return met.select(*by, "feature", F.coalesce("t", F.lit(0.0)).alias("t"), F.coalesce("e", F.lit(0.0)).alias("e"))


def errors(pairs: DataFrame, by: list[str]) -> DataFrame:
    """mae, rmse, tvd, bray_curtis, max_error of each group."""
    d = F.abs(F.col("e") - F.col("t"))
    both = F.sum(F.col("t") + F.col("e"))
    return pairs.groupBy(*by).agg(
        F.avg(d).alias("mae"),
        F.sqrt(F.avg(d * d)).alias("rmse"),
        (0.5 * F.sum(d)).alias("tvd"),
        F.when(both == 0, 0.0).otherwise(F.sum(d) / F.nullif(both, F.lit(0.0))).alias("bray_curtis"),
        F.max(d).alias("max_error"),
    )


def pearson(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Null where a side doesn't vary."""
    spread = F.stddev_pop("t") * F.stddev_pop("e")
    return pairs.groupBy(*by).agg((F.covar_pop("t", "e") / F.nullif(spread, F.lit(0.0))).alias("pearson"))


def average_ranks(pairs: DataFrame, by: list[str], column: str) -> DataFrame:
    """column replaced by its rank in the group; ties share the mean of their ranks."""
    group = Window.partitionBy(*by).orderBy(column)
    ties = F.count("*").over(Window.partitionBy(*by, column))
    return pairs.withColumn(column, F.rank().over(group) + (ties - 1) / 2)


def spearman(pairs: DataFrame, by: list[str]) -> DataFrame:
    ranked = average_ranks(average_ranks(pairs, by, "t"), by, "e")
    return pearson(ranked, by).withColumnRenamed("pearson", "spearman")


def seed_statistics(rows: DataFrame, by: list[str], column: str) -> DataFrame:
    """n, mean, sd (sample; 0 for one) of the finite values of each group."""
    finite = rows.where(F.col(column).isNotNull() & ~F.isnan(column) & (F.abs(column) < float("inf")))
    return finite.groupBy(*by).agg(F.count("*").alias("n"), F.avg(column).alias("mean"), F.coalesce(F.stddev_samp(column), F.lit(0.0)).alias("sd"))


def source_counts(inserts: DataFrame, features: DataFrame) -> DataFrame:
    """feature, value: inserts (source_assembly) of each feature (assembly, feature), 0 too, and of Unknown; an assembly without a feature is an error."""
    drawn = inserts.groupBy(F.trim("source_assembly").alias("assembly")).agg(F.count("*").alias("n"))
    lost = F.raise_error(F.concat(F.lit("Source assembly "), F.col("assembly"), F.lit(" has no feature"))).cast("string")
    both = features.select("assembly", "feature").join(drawn, "assembly", "full")
    named = both.select(F.when(F.col("feature").isNull(), lost).otherwise(F.col("feature")).alias("feature"), F.coalesce("n", F.lit(0)).alias("n"))
    unknown = features.sparkSession.range(1).select(F.lit("Unknown").alias("feature"), F.lit(0).cast("bigint").alias("n"))
    return named.unionByName(unknown).groupBy("feature").agg(F.sum("n").cast("double").alias("value"))


def exact_recovery(truth: DataFrame, estimate: DataFrame) -> bool:
    """Whether both have the same features with the same values."""
    a, b = truth.select("feature", "value"), estimate.select("feature", "value")
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def sums_to_one(estimate: DataFrame, tolerance: float = 5e-6) -> bool:
    whole = estimate.agg(F.sum("value")).first()[0]
    return whole is not None and abs(whole - 1.0) <= tolerance


def largest_remainder(weights: DataFrame, by: list[str], total: str, key: str, weight: str) -> DataFrame:
    """share: whole numbers that add up to the column total in each group, by weight; the largest remainders get one more, ties by key."""
    group = Window.partitionBy(*by)
    exact = F.col(total) * F.col(weight) / F.sum(weight).over(group)
    rows = weights.withColumn("_exact", exact).withColumn("_floor", F.floor("_exact").cast("bigint"))
    left = F.col(total) - F.sum("_floor").over(group)
    turn = F.row_number().over(group.orderBy(F.desc(F.col("_exact") - F.col("_floor")), F.col(key)))
    return rows.withColumn("share", F.col("_floor") + (turn <= left).cast("bigint")).drop("_exact", "_floor")


def pair_counts(classes: DataFrame) -> DataFrame:
    """a, b, n: inserts that have both features, of classes (fids, n)."""
    one = classes.where(F.size("fids") > 1).select("n", "fids", F.posexplode("fids").alias("i", "a"))
    return one.select("n", "a", F.explode(F.slice("fids", F.col("i") + 2, F.size("fids"))).alias("b")).groupBy("a", "b").agg(F.sum("n").alias("n"))


def reverse_complement(column: str):
    return F.reverse(F.translate(F.col(column), "ACGTacgt", "TGCAtgca"))


def shared_kmers(sequences: DataFrame, k: int) -> DataFrame:
    """kmer (the smaller of it and its reverse complement), n places, m sequences. Input: name, seq."""
    length = F.length("seq")
    cut = sequences.where(length >= k).select("name", "seq", F.explode(F.sequence(F.lit(1), length - k + 1)).alias("at"))
    words = cut.select("name", F.substring("seq", F.col("at"), F.lit(k)).alias("kmer"))
    canonical = F.least("kmer", reverse_complement("kmer"))
    return words.select("name", canonical.alias("kmer")).groupBy("kmer").agg(F.count("*").alias("n"), F.count_distinct("name").alias("m"))
