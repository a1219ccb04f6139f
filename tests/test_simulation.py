import pytest
from pyspark.sql import functions as F

from strandframe.functions import cigar
from strandframe.operators import filter as filters, metrics, profile as profiles, simulate


def plain_md(fragment, read):
    out, run = "", 0
    for a, b in zip(fragment, read):
        if a == b:
            run += 1
        else:
            out, run = f"{out}{run}{a}", 0
    return out + str(run)


def test_md_string(spark):
    rows = [("ACGTACGTAC", [0, 3, 9]), ("ACGT", []), ("ACGT", [1])]
    got = spark.createDataFrame(rows, "f string, p array<int>").select("f", "p", simulate.md_string(F.col("f"), F.col("p")).alias("md"))
    for r in got.collect():
        assert r.md == plain_md(r.f, "".join("N" if k in r.p else c for k, c in enumerate(r.f)))


def test_occurrences(spark):
    genomes = spark.createDataFrame([("a", "AACCGT"), ("b", "TTACGG"), ("c", "AC")], "name string, seq string")
    found = simulate.occurrences(spark.createDataFrame([("i", "CCGT")], "insert string, fragment string"), genomes, 4)
    assert {(r.name, r["at"], r.reverse, r.fragment) for r in found.collect()} == {("a", 2, False, "CCGT"), ("b", 2, True, "ACGG")}


def truth_and_errors(spark, shared, inserts=3000):
    genomes, refs = simulate.genome_frames(spark, simulate.random_genomes(["g1", "g2", "g3", "g4"], 4000, shared, 13))
    weights = spark.createDataFrame([("g1", 8.0), ("g2", 4.0), ("g3", 1.0), ("g4", 0.0)], "name string, w double").withColumns({"all": F.lit(1), "total": F.lit(inserts).cast("bigint")})
    counts = metrics.largest_remainder(weights, ["all"], "total", "name", "w").select("name", "share")
    drawn = simulate.source_inserts(genomes, counts, 7).persist()
    rows = simulate.alignments(drawn, genomes, refs, 7).persist()
    truth = counts.select(F.col("name").alias("feature"), F.col("share").cast("double").alias("value"))
    errors = {}
    for multi in profiles.MULTI:
        made = profiles.profile(rows, refs, multi=multi, unit="ab", nolen=True)
        estimate = made.values.where("feature <> 'Unknown'").select("feature", "value")
        whole = estimate.agg(F.sum("value")).first()[0]
        pairs = metrics.paired(truth.withColumn("value", F.col("value") / inserts), estimate.withColumn("value", F.col("value") / whole), [])
        errors[multi] = metrics.errors(pairs, []).first().bray_curtis
    return rows, drawn, truth, errors, refs


def test_sharing_is_needed_where_genomes_share(spark):
    rows, drawn, _, errors, _ = truth_and_errors(spark, 0.3)
    assert rows.select("qname").distinct().count() == drawn.count() == 3000
    assert errors["proportional"] < errors["equal"] and errors["proportional"] < errors["ignore"] and errors["proportional"] < errors["all"]
    assert errors["proportional"] < 0.02
    bad = rows.where((cigar.md_mismatches() != F.col("nm")) | (F.col("as_score") != 100 - 2 * F.col("nm")) | (F.col("as_score") != cigar.rescored()))
    assert bad.isEmpty()
    best = filters.best_hits(rows)
    assert best.select("qname").distinct().count() == 3000


def test_without_sharing_counts_are_exact(spark):
    rows, _, truth, errors, refs = truth_and_errors(spark, 0.0, 500)
    assert max(errors.values()) == pytest.approx(0, abs=1e-12)
    made = profiles.profile(rows, refs, multi="proportional", unit="ab", nolen=True)
    assert metrics.exact_recovery(truth, made.values.where("feature <> 'Unknown'"))
    assert metrics.sums_to_one(profiles.profile(rows, refs).values)
