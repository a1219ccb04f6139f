import gzip
import math
import struct

import pytest
from pyspark.sql import functions as F

from strandframe.operators import matrix, metrics, profile as profiles
from strandframe.sinks import text
from strandframe.sources import tables


def test_profile_reader(spark, tmp_path):
    path = tmp_path / "p.tsv.gz"

    def read(body):
        with gzip.open(path, "wt") as f:
            f.write(body)
        return {r.feature: r.value for r in tables.read_profile(spark, str(path)).collect()}

    assert read("# comment\nID\tx\nUnknown\t0.5\nA\t1e-3\n") == {"Unknown": 0.5, "A": 0.001}
    for bad in ("A\t1\n", "ID\tx\nA\t1\nA\t2\n", "ID\tx\nA\t-1\n", "ID\tx\nA\tnan\n", "ID\tx\nA\tinf\n", "ID\tx\nA\tword\n"):
        with pytest.raises(ValueError):
            read(bad)


def test_tables(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("id\tstatus\na\tPASS\nb\tFAIL\n")
    assert [r.id for r in tables.read_tsv(spark, str(tmp_path / "m.tsv"), ["id"], "status").collect()] == ["a"]
    with pytest.raises(ValueError):
        tables.read_tsv(spark, str(tmp_path / "m.tsv"), ["name"])
    (tmp_path / "x.fa").write_text(">one\nACGTN\nac-*\n>two\nRYK9\n")
    assert tuple(tables.fasta_counts(spark, str(tmp_path / "x.fa")).first()) == (2, 10)
    (tmp_path / "r.tsv").write_text("a\tb\nx\t1\t2.5\ny\t3\t4\n")
    assert sorted(tuple(r) for r in tables.read_matrix(spark, str(tmp_path / "r.tsv")).collect()) == [("x", "a", 1.0), ("x", "b", 2.5), ("y", "a", 3.0), ("y", "b", 4.0)]
    (tmp_path / "n.bin").write_bytes(struct.pack("<4I", 3, 7, 0, 2**32 - 1))
    assert [r.value for r in tables.read_uints(spark, str(tmp_path / "n.bin")).orderBy("at").collect()] == [7, 0, 2**32 - 1]


def test_matrix_writers():
    rows = [("x", [1.0, 0.123456789123])]
    assert list(text.matrix_text(rows, ["a", "b"])) == ["a\tb", "x\t1\t0.12345679"]
    assert list(text.matrix_text(rows, ["a", "b"], "pandas"))[0] == "ID\ta\tb"
    assert list(text.matrix_text(rows, ["a", "b"], "plain")) == ["1.00000000 0.12345679"]
    assert text.number(2.125, "%.2f") == "2.12" and text.number(2.675, "%.2f") == "2.67" and text.number(float("nan")) == "nan"


def test_matrices(spark):
    m = spark.createDataFrame([("x", "a", 1.0), ("x", "b", 3.0), ("y", "a", 0.0), ("y", "b", 0.0)], "i string, j string, v double")
    cells = lambda d: {(r.i, r.j): r.v for r in d.collect()}
    assert cells(matrix.row_normalise(m))[("x", "b")] == 0.75 and cells(matrix.row_normalise(m))[("y", "a")] != cells(matrix.row_normalise(m))[("y", "a")]
    with pytest.raises(ValueError):
        matrix.add(m, m.where("i = 'x'"))
    assert cells(matrix.add(m, m))[("x", "b")] == 6.0 and cells(matrix.subtract(m, m))[("x", "b")] == 0.0
    assert [tuple(r) for r in matrix.wide(m, ["a", "b"]).orderBy("i").collect()] == [("x", 1.0, 3.0), ("y", 0.0, 0.0)]


def test_vectors(spark):
    d = spark.createDataFrame([([1.0, 2.0, 4.0], [0.5, 0.5, 0.0], [0.25, 0.75, 0.0], 0.0)], "a array<double>, p array<double>, q array<double>, x double")
    a, p, q, x = (F.col(c) for c in ("a", "p", "q", "x"))
    r = d.select(
        matrix.vector_add(a, p).alias("add"), matrix.vector_divide(a, 2.0).alias("half"), matrix.mean(a).alias("mean"), matrix.sample_stdev(F.slice(a, 1, 1)).alias("one"), matrix.kl_divergence(p, q).alias("kl"),
        matrix.js_distance(p, p).alias("js"), matrix.kl_divergence(p, q, 1).alias("skip"), matrix.safe_log(x).alias("log"), matrix.decibel_score(x + 1).alias("score"), matrix.last_not_above(a, F.lit(3.0)).alias("at"),
        matrix.first_word(F.lit(" two words")).alias("word"),
    ).first()
    assert r["add"] == [1.5, 2.5, 4.0] and r.half == [0.5, 1.0, 2.0] and r.mean == pytest.approx(7 / 3) and r.one == 0.0
    # zeros in both: 0 times the logarithm of 0 / 0
    assert math.isnan(r.kl) and math.isnan(r.js) and math.isnan(r.skip)
    assert r.log == matrix.LEAST_DOUBLE and r.score == 0 and r["at"] == 1 and r.word == ""
    with pytest.raises(Exception, match="negative"):
        d.select(matrix.decibel_score(x - 1)).collect()
    assert d.select(matrix.decibel_score(x + 10)).first()[0] == pytest.approx(10 * math.log(10) / 0.301029995664, abs=1e-12)


def test_divergences_at_zeros(spark):
    d = spark.createDataFrame([(1, [0.5, 0.5], [0.25, 0.75]), (2, [0.5, 0.5], [1.0, 0.0]), (3, [1.0, 0.0], [0.5, 0.5])], "id int, p array<double>, q array<double>")
    p, q = F.col("p"), F.col("q")
    got = {r.id: (r.kl, r.js) for r in d.select("id", matrix.kl_divergence(p, q).alias("kl"), matrix.js_divergence(p, q).alias("js")).collect()}
    assert got[1][0] == pytest.approx(0.5 * math.log(2) + 0.5 * math.log(2 / 3)) and got[1][1] > 0
    assert got[2][0] == math.inf and math.isnan(got[2][1]) and math.isnan(got[3][0])
    with pytest.raises(Exception, match="different lengths"):
        d.select(matrix.kl_divergence(p, F.slice(q, 1, 1))).collect()
    m = spark.createDataFrame([("x", "a", 0.0), ("x", "b", -1.0), ("x", "c", 1.0)], "i string, j string, v double")
    logs = {r.j: r.v for r in matrix.log(m).collect()}
    assert logs["a"] == -math.inf and math.isnan(logs["b"]) and logs["c"] == 0.0


def test_words_and_powers(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert [one(matrix.first_word(F.lit(x))) for x in ("a b", "a\tb c", "word", " lead", "")] == ["a", "a", "word", "", ""]
    assert one(matrix.group_name(F.lit("abcdef"), 4)) == "abcd" and one(matrix.group_name(F.lit("abcd/wxyz"), 5)) == "abwxy"
    assert one(matrix.power(F.lit(2), F.lit(-1))) == 0.5 and one(matrix.power(F.lit(2), F.lit(-1), "int")) == 0 and one(matrix.power(F.lit(3), F.lit(30), "bigint")) == 3**30


def test_kmers_and_pairs(spark):
    s = spark.createDataFrame([("a", "ACGTT"), ("b", "AACGT")], "name string, seq string")
    got = {r.kmer: (r.n, r.m) for r in metrics.shared_kmers(s, 4).collect()}
    assert got == {"ACGT": (2, 2), "AACG": (2, 2)}
    classes = spark.createDataFrame([([1, 2, 3], 2), ([2, 3], 1), ([4], 5)], "fids array<bigint>, n bigint")
    assert {(r.a, r.b): r.n for r in metrics.pair_counts(classes).collect()} == {(1, 2): 2, (1, 3): 2, (2, 3): 3}


def test_source_counts(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("insert\tsource_assembly\n1\tA\n2\t A\n3\tB\n")
    inserts = tables.read_tsv(spark, str(tmp_path / "m.tsv"), ["source_assembly"])
    features = spark.createDataFrame([("A", "f"), ("B", "f"), ("C", "g")], "assembly string, feature string")
    assert {tuple(r) for r in metrics.source_counts(inserts, features).collect()} == {("f", 3.0), ("g", 0.0), ("Unknown", 0.0)}
    with pytest.raises(Exception, match="has no feature"):
        metrics.source_counts(inserts, features.where("assembly <> 'B'")).collect()


def test_without_training_data_operators(tmp_path):
    """The rest imports and registers its queries when the optional folder is gone."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    for name in ("strandframe", "__spark_entry__.py"):
        source = root / name
        (shutil.copytree if source.is_dir() else shutil.copy)(source, tmp_path / name)
    shutil.rmtree(tmp_path / "strandframe" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q) and len(q) > 60 and not any(n.startswith('op') for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
    assert profiles.MULTI
