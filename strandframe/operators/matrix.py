"""Labelled matrices in long form (i, j, v), and functions over vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAST_DOUBLE = -1.7976931348623157e308
#: The decimal logarithm of 2 that scores are divided by. Fixed value.
TENTH_OF_TWO = 0.301029995664


def transpose(m: DataFrame) -> DataFrame:
    return m.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def mapped(m: DataFrame, f) -> DataFrame:
    return m.withColumn("v", f(F.col("v")))


def square(m: DataFrame) -> DataFrame:
    return mapped(m, lambda v: v * v)


def scale(m: DataFrame, factor: float) -> DataFrame:
    return mapped(m, lambda v: v * F.lit(factor))


def divide(m: DataFrame, divisor: float) -> DataFrame:
    return mapped(m, lambda v: v / F.lit(divisor))


def fill(m: DataFrame, value: float = 0.0) -> DataFrame:
    return mapped(m, lambda v: F.lit(value))


def ln(x: Column) -> Column:
    """Natural logarithm as floating point has it: -Infinity of 0, not a number below 0."""
    return F.when(x == 0, F.lit(float("-inf"))).when(x < 0, F.lit(float("nan"))).otherwise(F.ln(x))


def log(m: DataFrame) -> DataFrame:
    return mapped(m, ln)


def shape(m: DataFrame) -> tuple[int, int]:
    return tuple(m.agg(F.count_distinct("i"), F.count_distinct("j")).first())


def _paired(a: DataFrame, b: DataFrame, f, check: bool) -> DataFrame:
    if check and shape(a) != shape(b):
        raise ValueError("Matrices have different shapes")
    met = a.withColumnRenamed("v", "va").join(b.withColumnRenamed("v", "vb"), ["i", "j"], "full")
    return met.select("i", "j", f(F.coalesce("va", F.lit(0.0)), F.coalesce("vb", F.lit(0.0))).alias("v"))


def add(a: DataFrame, b: DataFrame, check: bool = True) -> DataFrame:
    return _paired(a, b, lambda x, y: x + y, check)


def subtract(a: DataFrame, b: DataFrame, check: bool = True) -> DataFrame:
    return _paired(a, b, lambda x, y: x - y, check)


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sums over the shared index are made before and after the shuffle."""
    left = a.select("i", F.col("j").alias("k"), F.col("v").alias("x"))
    right = b.select(F.col("i").alias("k"), "j", F.col("v").alias("y"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def _normalised(m: DataFrame, by: str) -> DataFrame:
    whole = F.sum("v").over(Window.partitionBy(by))
    return m.withColumn("v", F.when(whole == 0, F.lit(float("nan"))).otherwise(F.col("v") / F.nullif(whole, F.lit(0.0))))


def row_normalise(m: DataFrame) -> DataFrame:
    return _normalised(m, "i")


def column_normalise(m: DataFrame) -> DataFrame:
    return _normalised(m, "j")


def wide(m: DataFrame, columns: list[str]) -> DataFrame:
    """A row per i with a column per named j."""
    return m.groupBy("i").pivot("j", columns).agg(F.first("v"))


# vectors: array<double> columns


def vector_add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def vector_divide(a: Column, divisor: float) -> Column:
    return F.transform(a, lambda x: x / F.lit(divisor))


def vector_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda n, x: n + x)


def mean(a: Column) -> Column:
    return vector_sum(a) / F.nullif(F.size(a), F.lit(0))


def sample_stdev(a: Column) -> Column:
    """0 for a single value."""
    m = mean(a)
    squares = vector_sum(F.transform(a, lambda x: (x - m) * (x - m)))
    return F.when(F.size(a) == 1, F.lit(0.0)).otherwise(F.sqrt(squares / F.nullif(F.size(a) - 1, F.lit(0))))


def kl_divergence(p: Column, q: Column, skip: int = 0) -> Column:
    """Natural logarithm; the first skip entries are left out. Vectors of different length are an error.

    Zeros count as floating point has them: one in q gives Infinity, one in p (0 times the logarithm of 0) not a number.
    """

    def term(x: Column, y: Column) -> Column:
        value = x * F.ln(x / F.nullif(y, F.lit(0.0)))
        return F.when((x > 0) & (y == 0), F.lit(float("inf"))).when((x > 0) & (y > 0), value).otherwise(F.lit(float("nan")))

    n = F.size(p) - skip
    total = vector_sum(F.zip_with(F.slice(p, skip + 1, n), F.slice(q, skip + 1, n), term))
    wrong = F.raise_error(F.concat(F.lit("Vectors of different lengths: "), F.size(p), F.lit(" and "), F.size(q))).cast("double")
    return F.when(F.size(p) != F.size(q), wrong).otherwise(total)


def js_divergence(p: Column, q: Column, skip: int = 0) -> Column:
    middle = F.zip_with(p, q, lambda x, y: (x + y) / 2)
    return (kl_divergence(p, middle, skip) + kl_divergence(q, middle, skip)) / 2


def js_distance(p: Column, q: Column, skip: int = 0) -> Column:
    d = js_divergence(p, q, skip)
    return F.when(d < 0, 0.0).otherwise(F.sqrt(d))


def safe_log(x: Column) -> Column:
    return F.when(x == 0, F.lit(LEAST_DOUBLE)).otherwise(F.ln(x))


def decibel_score(x: Column) -> Column:
    """10 ln(x) / TENTH_OF_TWO; the least double for 0; an error below 0."""
    return F.when(x == 0, F.lit(LEAST_DOUBLE)).when(x < 0, F.raise_error(F.lit("score of a negative number")).cast("double")).otherwise(10 * F.ln(x) / TENTH_OF_TWO)


def last_not_above(sorted_values: Column, x: Column) -> Column:
    """Index (from 0) of the last value that isn't above x; -1 if all are."""
    return F.size(F.filter(sorted_values, lambda v: v <= x)) - 1


def first_word(text: Column) -> Column:
    """What comes before the first white space; empty if that is the first character."""
    return F.regexp_extract(text, r"^[^ \t\n\x0B\f\r]*", 0)


def group_name(text: Column, length: int) -> Column:
    """The first length characters; of a text with a slash, half of them from its start and the rest from behind the slash."""
    half, slash = length // 2, F.instr(text, "/")
    return F.when(slash == 0, F.left(text, F.lit(length))).otherwise(F.concat(F.left(text, F.lit(half)), F.substring(text, slash + 1, F.lit(length - half))))


def power(x: Column, y: Column, kind: str = "double") -> Column:
    """x to the y; kind int or bigint cuts off the fraction."""
    return F.pow(x, y).cast(kind)
