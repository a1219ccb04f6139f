import gzip
import io
import math

import pytest
import samples
from pyspark.sql import functions as F

from strandframe import cli
from strandframe.operators import coverage, filter as filters, profile as profiles, qname, summary
from strandframe.operators.filter import FilterOptions
from strandframe.plans import commands
from strandframe.sinks import provenance, text
from strandframe.sources import bam, sam, tables


@pytest.fixture(scope="module")
def read(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sam")
    known = {}

    def one(name):
        if name not in known:
            df, header = sam.read_sam(spark, samples.write(folder, name))
            known[name] = (df.persist(), header, sam.refs_frame(spark, header))
        return known[name]

    return one


def names(df, options=None):
    rows = filters.output_order(df, options) if options else df.orderBy("ord")
    return [f"{r.qname}:{r.flag}" for r in rows.collect()]


ALL = "clip80:0 clip90:0 del99:0 id97:0 id98:0 ins99:0 len80:0 md99:0 md_precedence:0 pairX:65 pairX:129 perfect100:0 secondary98:256 supp98:2048".split()


def without(*gone):
    return [x for x in ALL if x not in gone]


def only(*kept):
    return [x for x in ALL if x.split(":")[0] in kept or x in kept]


FILTERS = [
    ({"min_length": 79}, ALL),
    ({"min_length": 80}, ALL),
    ({"percent_identity": 97}, ALL),
    ({"min_query_percent": 80}, ALL),
    ({"min_length": 81}, without("clip80:0", "len80:0")),
    ({"min_length": 100}, without("clip80:0", "clip90:0", "len80:0")),
    ({"percent_identity": 98}, without("id97:0", "pairX:129")),
    ({"ppt": 980}, without("id97:0", "pairX:129")),
    ({"percent_identity": 99}, only("clip80", "clip90", "del99", "ins99", "len80", "md99", "md_precedence", "pairX:65", "perfect100")),
    ({"percent_identity": 100}, only("clip80", "clip90", "len80", "md_precedence", "pairX:65", "perfect100")),
    ({"ppt": -980}, only("id97", "id98", "pairX:129", "secondary98", "supp98")),
    ({"percent_identity": 99, "invert": True}, only("id97", "id98", "pairX:129", "secondary98", "supp98")),
    ({"percent_identity": 99, "invert": True, "keep_unmapped": True}, [*only("id97", "id98", "pairX:129", "secondary98", "supp98"), "unmapped:4"]),
    ({"ppt": -980, "keep_unmapped": True}, only("id97", "id98", "pairX:129", "secondary98", "supp98")),
    ({"min_query_percent": 90}, without("clip80:0")),
    ({"min_query_percent": 91}, without("clip80:0", "clip90:0")),
    ({"min_length": 100, "percent_identity": 99}, only("del99", "ins99", "md99", "md_precedence", "pairX:65", "perfect100")),
    ({"min_length": 100, "percent_identity": 99, "min_query_percent": 91}, only("del99", "ins99", "md99", "md_precedence", "pairX:65", "perfect100")),
    ({"min_length": 90, "min_query_percent": 91}, without("clip80:0", "clip90:0", "len80:0")),
    ({"percent_identity": 99, "min_query_percent": 91}, only("del99", "ins99", "len80", "md99", "md_precedence", "pairX:65", "perfect100")),
]


@pytest.mark.parametrize("options,expected", FILTERS)
def test_filter(read, options, expected):
    df, *_ = read("filter")
    assert names(filters.filter_alignments(df, FilterOptions(**options))) == expected


def test_filter_eqx(read):
    df, *_ = read("cigar_eqx")
    got = lambda **o: [x.split(":")[0] for x in names(filters.filter_alignments(df, FilterOptions(**o)))]
    assert got(percent_identity=98) == got(min_length=100) == ["md_eqx100", "md_eqx98", "md_m100", "md_m98"]
    assert len(got(min_query_percent=90)) == 8


def test_rescore_replaces_the_tag(read):
    df, *_ = read("filter")
    rows = {r.qname: r for r in filters.filter_alignments(df, FilterOptions(min_length=1, rescore=True)).collect()}
    assert rows["id98"].as_score == 96 and rows["md_precedence"].as_score == 100
    assert rows["md_precedence"].tags == ["NM:i:10", "MD:Z:100", "AS:i:100"]


def test_missing_edit_distance_is_an_error(read):
    df, *_ = read("profile")
    with pytest.raises(Exception, match="neither MD nor NM"):
        filters.filter_alignments(df, FilterOptions(percent_identity=90)).collect()
    assert filters.filter_alignments(df, FilterOptions(min_length=1)).count() == 11


BEST = (
    "filterwin:0 interleaved:65 interleaved:385 interleaved_tie:65 interleaved_tie:321 interleaved_tie:129 paired:321 paired:129 same_ref:256 "
    "single:0 tie2:0 tie2:256 tie3:0 tie3:256 unique2:256 unique3:256"
).split()
UNIQUE = "filterwin:0 interleaved:65 interleaved:385 interleaved_tie:129 paired:321 paired:129 same_ref:256 single:0 unique2:256 unique3:256".split()


@pytest.mark.parametrize("options,expected", [({"besthit": True}, BEST), ({"uniqhit": True}, UNIQUE), ({"percent_identity": 95, "besthit": True}, ["filterwin:256", *BEST[1:]])])
def test_best_hits(read, options, expected):
    df, *_ = read("besthit")
    o = FilterOptions(**options)
    assert names(filters.filter_alignments(df, o), o) == expected


def test_best_hits_need_scores(read):
    df, *_ = read("profile")
    with pytest.raises(Exception, match="has no AS"):
        filters.best_hits(df).collect()


def test_best_hits_of_rescored(read):
    df, *_ = read("rescore")
    assert names(filters.filter_alignments(df, FilterOptions(besthit=True))) == ["rescore:0"]
    row = filters.filter_alignments(df, FilterOptions(besthit=True, rescore=True)).first()
    assert (row.flag, row.as_score) == (256, 100)


def test_best_hits_shuffle_once(read):
    df, *_ = read("besthit")
    plan = filters.best_hits(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(qname") == 1


def test_pairs_with_odd_mate_bits_are_left_out(spark):
    df = spark.createDataFrame([("q", 65, 1, 5), ("q", 193, 2, 9), ("q", 0, 3, 9)], "qname string, flag int, ord bigint, as_score int")
    assert [r.flag for r in filters.best_hits(df).collect()] == [65]


@pytest.mark.parametrize(
    "options,message",
    [
        ({"invert": True, "besthit": True, "min_length": 1}, "--invert cannot"),
        ({"besthit": True, "uniqhit": True}, "--besthit cannot be combined with --uniqhit"),
        ({"percent_identity": 95, "ppt": 950}, "-p cannot be combined with --ppt"),
        ({"rescore": True}, "needs -l, -p, --ppt, -z, --besthit or --uniqhit"),
        ({"percent_identity": 101}, r"-p must be in the range \[0,100\]"),
        ({"percent_identity": -1}, r"-p must be in the range \[0,100\]"),
        ({"ppt": 1001}, r"--ppt must be in the range"),
        ({"min_length": -1}, "-l must be a non-negative integer"),
        ({"min_query_percent": 101}, r"-z must be in the range \[0,100\]"),
        ({"min_query_percent": -1}, r"-z must be in the range \[0,100\]"),
        ({"min_length": 0}, "No active filter"),
    ],
)
def test_bad_options(options, message):
    with pytest.raises(ValueError, match=message):
        FilterOptions(**options)


def values(profile):
    return {r.feature: r.value for r in profile.values.collect()}


@pytest.mark.parametrize("multi,expected", [("all", (0, 6, 2)), ("equal", (0, 5.5, 1.5)), ("ignore", (1, 5, 1)), ("proportional", (0, 5 + 5 / 6, 1 + 1 / 6))])
def test_profile(read, multi, expected):
    df, _, refs = read("profile")
    p = profiles.profile(df, refs, multi=multi, unit="ab", nolen=True, total=7)
    got = values(p)
    assert [got[k] for k in ("Unknown", "A", "B")] == pytest.approx(list(expected), abs=1e-4)
    assert (p.total, p.mapped, p.multi, p.unique) == (7, 7, 1, 6)


@pytest.mark.parametrize("name", ["empty", "unmapped"])
def test_profile_of_nothing(read, name):
    df, _, refs = read(name)
    for multi in profiles.MULTI:
        p = profiles.profile(df, refs, multi=multi, unit="ab", nolen=True)
        assert values(p) == {"Unknown": 0, "A": 0, "B": 0} and p.mapped == p.multi == p.unique == 0
    assert all(math.isnan(v) for v in values(profiles.profile(df, refs, multi="equal")).values())


def test_profile_mincount(read):
    df, _, refs = read("fractional")
    got = values(profiles.profile(df, refs, multi="equal", unit="ab", nolen=True, total=3))
    assert got == pytest.approx({"Unknown": 0, "A": 4 / 3, "B": 4 / 3, "C": 1 / 3})
    got = values(profiles.profile(df, refs, multi="equal", unit="ab", nolen=True, total=3, mincount=1))
    assert got == pytest.approx({"Unknown": 1 / 3, "A": 4 / 3, "B": 4 / 3, "C": 0})


def test_long_names_stay_apart(read):
    df, _, refs = read("long_qname")
    p = profiles.profile(df, refs, multi="equal", unit="ab", nolen=True)
    assert (p.mapped, p.multi, p.unique) == (4, 4, 0) and values(p) == {"Unknown": 0, "A": 2, "B": 2}
    assert summary.count_inserts(df).first().n == 4


def test_sharing_agrees_and_stops_early(read, spark):
    df, _, refs = read("profile")
    classes = profiles.insert_classes(df)
    a, purged, steps = profiles.proportional_shares(classes, 2)
    b, purged2, steps2 = profiles.proportional_shares(classes, 2, driver_pairs=-1)
    assert {r.fid: r.value for r in a.collect()} == pytest.approx({r.fid: r.value for r in b.collect()}, abs=1e-12)
    assert purged == purged2 == 0 and steps == steps2 < profiles.MAX_STEPS


def test_inserts_of_features_without_unique_ones_are_purged(spark):
    classes = spark.createDataFrame([([1, 2], 4), ([3], 2), ([2, 3], 1)], "fids array<bigint>, n bigint")
    for pairs in (100, -1):
        a, purged, _ = profiles.proportional_shares(classes, 3, pairs)
        assert purged == 4 and {r.fid: r.value for r in a.collect() if r.value} == pytest.approx({3: 3.0})


def some_classes(spark, n: int, features: int):
    rows = spark.range(n).select(F.array_sort(F.array_distinct(F.array(*[F.xxhash64("id", F.lit(k)) % features for k in range(5)]))).alias("fids"))
    return rows.groupBy("fids").agg(F.count("*").alias("n"))


def test_three_ways_of_sharing_agree(spark, monkeypatch):
    """Classes of one to five features, negative ids among them, some packed in rows of their own; 1001 to 1003 have no unique inserts."""
    monkeypatch.setattr(profiles, "ROW_PAIRS", 3)
    classes = some_classes(spark, 60, 8).unionByName(spark.createDataFrame([([1001, 1002], 5), ([1002, 1003], 2), ([3], 7), ([-4], 1), (list(range(-7, 8)), 2)], "fids array<bigint>, n bigint"))
    made = [profiles.proportional_shares(classes, 20, **how) for how in ({}, {"driver_pairs": -1}, {"driver_pairs": -1, "driver_features": -1})]
    (a, purged, steps), *others = [({r.fid: r.value for r in df.collect() if r.value}, purged, steps) for df, purged, steps in made]
    assert purged >= 7 and a[-4] > 1
    for b, lost, took in others:
        assert b == pytest.approx(a, rel=1e-9) and (lost, took) == (purged, steps)


def test_sharing_without_shared_classes(spark):
    for rows in ([], [([5], 3)]):
        a, purged, _ = profiles.proportional_shares(spark.createDataFrame(rows, "fids array<bigint>, n bigint"), 9, driver_pairs=-1)
        assert {r.fid: r.value for r in a.collect()} == {f[0]: n for f, n in rows} and purged == 0


def test_steps_of_sharing_dont_shuffle_the_pairs(spark):
    """Beyond the driver's memory, too: what all steps shuffle together is less than the pairs are once, in 8 bytes each."""

    def written() -> int:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()

    classes = some_classes(spark, 40_000, 60).unionByName(spark.range(60).select(F.array("id").alias("fids"), (F.col("id") + 1).alias("n"))).persist()
    pairs = classes.agg(F.sum(F.size("fids"))).first()[0]
    before = written()
    _, _, steps = profiles.proportional_shares(classes, 60, driver_pairs=-1)
    assert pairs > 100_000 and steps > 5 and written() - before < 8 * pairs
    classes.unpersist()


def test_profile_sums(read):
    df, _, refs = read("profile")
    for multi in ("equal", "proportional"):
        p = profiles.profile(df, refs, multi=multi, unit="ab", nolen=True)
        assert sum(values(p).values()) == pytest.approx(p.mapped - p.purged)
    assert sum(values(profiles.profile(df, refs, unit="rel")).values()) == pytest.approx(1)
    assert sum(values(profiles.profile(df, refs, unit="tpm")).values()) == pytest.approx(1e6)


def test_profile_options(read):
    df, _, refs = read("profile")
    assert profiles.by_prefix("", profiles.MULTI, "--multi") == "all" and profiles.by_prefix("p", profiles.MULTI, "--multi") == "proportional"
    for bad in ({"multi": "x"}, {"unit": "x"}, {"total": 0}, {"mincount": -1}):
        with pytest.raises(ValueError):
            profiles.profile(df, refs, **bad)
    with pytest.warns(UserWarning, match="Ignoring 'unknown'"):
        assert profiles.profile(df, refs, total=3).total == -1


def test_genomes(read, spark, tmp_path):
    df, _, refs = read("fractional")
    path = tmp_path / "genomes"
    path.write_text("g1 A\n g2\tB\ng1 C\ng1 B\n")
    genomes = tables.read_genomes(spark, str(path))
    p = profiles.profile(df, refs, genomes, multi="equal", unit="ab", nolen=True)
    assert values(p) == {"Unknown": 0, "g1": 3, "g2": 0}
    path.write_text("g1 A\ng2 B\n")
    with pytest.raises(ValueError, match="'C' has no genome"):
        profiles.profile(df, refs, tables.read_genomes(spark, str(path)))
    path.write_text("g1 A\ng2 B\ng1 C\ng1 D\n")
    with pytest.raises(ValueError, match="'D' of the genome definition"):
        profiles.profile(df, refs, tables.read_genomes(spark, str(path)))
    path.write_text("g1 A\ng2\n")
    with pytest.raises(ValueError, match="Malformed"):
        tables.read_genomes(spark, str(path))


def test_integration(read):
    df, _, refs = read("integration")
    before = profiles.profile(df, refs, multi="equal", unit="ab", nolen=True)
    assert (before.multi, before.unique) == (2, 2) and values(before) == {"Unknown": 0, "A": 2, "B": 2}
    after = commands.filtered_profile(df, refs, FilterOptions(percent_identity=95), multi="equal", unit="ab", nolen=True)
    assert (after.multi, after.unique) == (1, 3) and values(after) == {"Unknown": 0, "A": 1.5, "B": 2.5}


def test_coverage_text(read):
    df, _, refs = read("coverage")
    zeros = ["0 0 0 0", "0"]
    expected = [">A", "1 0 1 1", "2 2 1 0", "0 1", ">B", *zeros, ">C", "0 0 0 0", "0 0 0 0", "0 1", ">D", "4 4 2 4", "3 0 0 0"]
    assert list(text.coverage_text(df, refs, words=4)) == expected
    assert ">B" not in list(text.coverage_text(df, refs, words=4, skip_uncovered=True))
    assert list(text.coverage_text(df, refs))[:2] == [">A", "1 0 1 1 2 2 1 0 0 1"]
    with pytest.raises(ValueError, match="-w must be"):
        list(text.coverage_text(df, refs, words=0))


def test_coverage_summary(read):
    df, _, refs = read("coverage")
    lines = list(text.coverage_summary_text(coverage.summary(df, refs)))
    assert lines == ["A\t0.70000000\t0.90", "B\t0\t0", "C\t0.10000000\t0.10", "D\t0.62500000\t2.12"]
    assert len(list(text.coverage_summary_text(coverage.summary(df, refs, skip_uncovered=True)))) == 3


def test_coverage_over_piece_borders(read, monkeypatch):
    df, _, refs = read("coverage")
    whole = {(r.tid, r.pos): r.depth for r in coverage.positions(df, refs).collect()}
    monkeypatch.setattr(coverage, "PIECE", 3)
    assert {(r.tid, r.pos): r.depth for r in coverage.positions(df, refs).collect()} == whole


def test_coverage_of_a_placed_unmapped_record(spark):
    df = spark.createDataFrame([(0, 4, 0, "*")], "tid int, flag int, pos0 bigint, cigar string")
    refs = spark.createDataFrame([(0, "A", 10)], "tid int, rname string, tlen bigint")
    assert list(text.coverage_summary_text(coverage.summary(df, refs))) == ["A\t0.00000000\t0.00"]


def test_summary_rows(read):
    df, _, refs = read("summary")
    lines = [x.split("\t") for x in text.summary_text(summary.rows(df, refs))]
    assert [(x[0], x[4], x[5]) for x in lines] == [
        ("edge", "100", "100.0"), ("ins", "98", "98.0"), ("mismatch", "99", "99.0"), ("perfect", "100", "100.0"), ("soft", "90", "90.0"), ("supplementary", "100", "100.0"),
    ]
    df, _, refs = read("summary_edge")
    assert [r.qname for r in summary.rows(df, refs, 10).orderBy("ord").collect()] == ["left_pass", "right_pass"]


@pytest.mark.parametrize("mode,expected", [("mapped", "90:1 98:1 99:1 100:3"), ("unmapped", "0:3 1:1 2:1 10:1"), ("edit", "0:3 1:1 2:1 10:1"), ("score", "80:1 96:1 98:1 100:3")])
def test_histograms(read, mode, expected):
    df, _, refs = read("summary")
    assert [x.replace("\t", ":") for x in text.histogram_text(summary.histogram(df, refs, mode))] == expected.split()


def test_histogram_ends(spark):
    refs = spark.createDataFrame([(0, "A", 100_000)], "tid int, rname string, tlen bigint")
    df = spark.createDataFrame([(0, 0, 0, "5000M", None), (0, 0, 0, "10S1M", "1")], "tid int, flag int, pos0 bigint, cigar string, md string")
    assert list(text.histogram_text(summary.histogram(df, refs, "mapped"))) == ["1\t1", "4096+\t1"]
    assert list(text.histogram_text(summary.histogram(df, refs, "score"))) == ["0\t1", "4096+\t1"]


def test_count_inserts(read):
    df, *_ = read("summary_count")
    assert summary.count_inserts(df).first().n == summary.count_inserts(df, grouped=False).first().n == 3
    df, *_ = read("reopened")
    assert summary.count_inserts(df).first().n == 2 and summary.count_inserts(df, grouped=False).first().n == 3
    df, *_ = read("unmapped")
    assert summary.count_inserts(df, grouped=False).first().n == 0


def test_qname_check(read, spark):
    assert qname.check_grouping(*read("profile")[:2]).message.endswith("confirmed by input header SO:queryname")
    with pytest.raises(ValueError, match="SO:coordinate"):
        qname.check_grouping(*read("coordinate")[:2])
    with pytest.raises(ValueError, match=r"'readA' reappears at record 3 after its previous group ended at record 1 \(1 intervening"):
        qname.check_grouping(*read("reopened")[:2])
    plain = sam.parse_header(["@SQ\tSN:A\tLN:1000"])
    assert qname.check_grouping(read("profile")[0], plain).message.endswith("in all 11 records")
    many = spark.range(12_000).select(F.col("id").alias("ord"), F.concat(F.lit("q"), "id").alias("qname"), F.lit(1).alias("flag"), F.lit(0).alias("tid"), F.col("id").alias("pos0"))
    check = qname.check_grouping(many, plain)
    assert check.status == "sample_warning" and "in first 10000 records; 12000 mapped records among the first 12000" in check.message
    assert qname.check_grouping(many.withColumn("pos0", -F.col("pos0")), plain).message.endswith("in first 10000 records")


def test_boundary_of_a_long_input(spark, tmp_path):
    path = tmp_path / "long.sam"
    with path.open("w") as f:
        f.write("@HD\tVN:1.6\n@SQ\tSN:A\tLN:1000\n@SQ\tSN:B\tLN:1000\n")
        for k in range(99_999):
            f.write(f"q{k}\t0\tA\t{100 + 100 * (k % 2)}\t60\t10M\t*\t0\t0\t*\t*\tAS:i:10\n")
        f.write("boundary\t0\tA\t300\t60\t10M\t*\t0\t0\t*\t*\tAS:i:10\nboundary\t256\tB\t400\t60\t10M\t*\t0\t0\t*\t*\tAS:i:20\n")
    df, header = sam.read_sam(spark, str(path))
    rows, check = commands.filter_plan(df, header, FilterOptions(besthit=True))
    assert check.message.endswith("in first 10000 records")
    found = rows.where("qname = 'boundary'").collect()
    assert rows.count() == 100_000 and [(r.flag, r.rname, r.pos0 + 1) for r in found] == [(256, "B", 400)]


def test_input_order_over_splits(spark, tmp_path):
    path = tmp_path / "many.sam"
    path.write_text("@SQ\tSN:A\tLN:1000\n" + "".join(f"q{k:06}\t0\tA\t1\t60\t1M\t*\t0\t0\t*\t*\n" for k in range(20_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        df, _ = sam.read_sam(spark, str(path))
        got = [r.qname for r in df.orderBy("ord").select("qname").collect()]
        assert df.select("ord").distinct().count() == 20_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == sorted(got)


def test_sam_round_trip(read):
    df, header, _ = read("filter")
    rows = df.orderBy("ord").collect()
    assert "\n".join(text.sam_text(header, rows)) + "\n" == samples.sam("filter")
    assert [r.value for r in sam.sam_lines(df.orderBy("ord")).collect()] == samples.sam("filter").split("\n")[2:-1]


def test_unknown_sequence_is_an_error(spark, tmp_path):
    path = tmp_path / "bad.sam"
    path.write_text("@SQ\tSN:A\tLN:10\nq\t0\tB\t1\t60\t1M\t*\t0\t0\t*\t*\n")
    with pytest.raises(Exception, match="'B' is not in the header"):
        sam.read_sam(spark, str(path))[0].collect()


@pytest.mark.parametrize("level", [0, 6])
def test_bam_round_trip(read, spark, tmp_path, level):
    df, header, _ = read("filter")
    rows = df.orderBy("ord").collect()
    path = tmp_path / "x.bam"
    with path.open("wb") as f:
        bam.write_bam(f, header, rows, level)
    again, header2 = bam.read_bam(spark, str(path))
    assert header2.refs == header.refs and header2.lines == header.lines
    columns = [c for c in df.columns if c != "ord"]
    assert [tuple(r[c] for c in columns) for r in again.orderBy("ord").collect()] == [tuple(r[c] for c in columns) for r in rows]


def _many(n, seed=3):
    """Records of many lengths, some longer than a block."""
    import random
    from types import SimpleNamespace

    rng = random.Random(seed)
    for k in range(n):
        size = rng.choice([0, 30, 150, 150, 150, 5000, 200_000 if k % 97 == 0 else 40])
        seq = "".join(rng.choices("ACGT", k=size))
        tid = rng.choice([None, 0, 1])
        yield SimpleNamespace(qname=f"r{k}", flag=rng.choice([0, 4, 16]), tid=tid, rname="*" if tid is None else f"t{tid}", pos0=rng.randrange(1000), mapq=7, cigar=f"{size}M" if size else "*", rnext="*", pnext=0, tlen=0, seq=seq or "*", qual="*" if k % 2 else "I" * size or "*", tags=[f"NM:i:{k % 5}", "XZ:Z:x"])


MANY = bam.Header(("@HD\tVN:1.6", "@SQ\tSN:t0\tLN:5000", "@SQ\tSN:t1\tLN:7000"), (("t0", 5000), ("t1", 7000)))


@pytest.mark.parametrize(("split", "level"), [(1, 6), (20_000, 6), (70_000, 0), (1 << 30, 6)])
def test_bam_splits_are_the_whole(tmp_path, split, level):
    rows = list(_many(400))
    path = tmp_path / "x.bam"
    with path.open("wb") as f:
        bam.write_bam(f, MANY, rows, level)
    split = max(split, path.stat().st_size // 40) if split == 1 else split
    reader = bam._Reader(str(path), split)
    parts = reader.partitions()
    assert (len(parts) > 1) == (split < path.stat().st_size)
    got = [row for p in parts for batch in reader.read(p) for row in batch.to_pylist()]
    assert [r["qname"] for r in got] == [r.qname for r in rows] and [r["seq"] for r in got] == [r.seq for r in rows]
    order = [r["ord"] for r in got]
    assert order == sorted(set(order))


def test_damaged_bam(tmp_path):
    packed = io.BytesIO()
    bam.write_bam(packed, MANY, _many(50))
    raw = bytearray(packed.getvalue())
    raw[len(raw) // 2] ^= 255
    (tmp_path / "x.bam").write_bytes(raw)
    reader = bam._Reader(str(tmp_path / "x.bam"), 1 << 20)
    with pytest.raises(Exception):  # noqa: B017
        [list(reader.read(p)) for p in reader.partitions()]
    (tmp_path / "y.bam").write_bytes(packed.getvalue()[:-40])
    reader = bam._Reader(str(tmp_path / "y.bam"), 1 << 20)
    with pytest.raises(ValueError, match="cut off"):
        [list(reader.read(p)) for p in reader.partitions()]


def test_bam_folders(spark, tmp_path):
    rows = list(_many(60))
    with (tmp_path / "x.bam").open("wb") as f:
        bam.write_bam(f, MANY, rows)
    df, header = bam.read_bam(spark, str(tmp_path / "x.bam"), 30_000)
    out = tmp_path / "parts"
    assert bam.write_folder(df.repartitionByRange(3, "ord").sortWithinPartitions("ord"), header, str(out)) == 60
    assert sorted(p.name for p in out.iterdir() if not p.name.startswith(".")) == [f"part-0000{k}.bam" for k in range(3)]
    again, header2 = commands.read(spark, str(out))
    assert header2 == header and [r.qname for r in again.orderBy("ord").collect()] == [r.qname for r in rows]
    with (out / "part-00009.bam").open("wb") as f:
        bam.write_bam(f, bam.Header(("@SQ\tSN:u\tLN:5",), (("u", 5),)), [])
    with pytest.raises(ValueError, match="other sequences"):
        bam.read_bam(spark, str(out))
    tmp_path_of_nothing = tmp_path / "none"
    tmp_path_of_nothing.mkdir()
    with pytest.raises(ValueError, match="no [*].bam"):
        bam.read_bam(spark, str(tmp_path_of_nothing))


def test_bam_tags():
    tags = ["XA:A:c", "XI:i:-5", "XU:i:4000000000", "XF:f:1.5", "XZ:Z:a b", "XH:H:1AFF", "XB:B:c,-1,2", "XE:B:f,0.5"]
    assert bam.decode_tags(b"".join(map(bam.encode_tag, tags))) == tags
    assert bam.bin_of(0, 1) == 4681 and bam.bin_of(0, 1 << 29) == 0
    with pytest.raises(ValueError):
        list(bam.decode(io.BytesIO(b"BAM\x02")))


def test_provenance(read):
    header = read("profile")[1]
    once = provenance.add_program(header, ["filter", "-l", "80"], qname.NOT_REQUIRED)
    twice = provenance.add_program(once, ["filter"], qname.NOT_REQUIRED)
    assert once.lines[:-1] == header.lines and "CL:strandframe filter -l 80" in once.lines[-1] and "PP:" not in once.lines[-1]
    assert "ID:strandframe.1\t" in twice.lines[-1] and "PP:strandframe\t" in twice.lines[-1]


def _lines(path):
    return gzip.open(path, "rt").read().split("\n")[:-1]


def test_command_line(spark, tmp_path, capfdbinary):
    def run(*arguments):
        code = cli.run(list(arguments), spark)
        out, err = capfdbinary.readouterr()
        return code, out.decode(errors="replace"), err.decode(errors="replace")

    path = {name: samples.write(tmp_path, name) for name in ("filter", "profile", "coverage", "summary", "coordinate", "summary_count")}
    assert run()[0] == 1 and run("help")[0] == 0 and run("filter", "--help")[0] == 0
    code, _, err = run("definitely-not-a-command")
    assert code == 1 and "unrecognized command" in err
    code, out, _ = run("filter", "-S", "-h", path["filter"])
    assert code == 1 and "needs -l, -p" in out and "@HD" not in out
    code, out, _ = run("filter", "-S", "-p", "99", "-v", "-k", path["filter"])
    assert code == 0 and [x.split("\t")[0] for x in out.split("\n")[:-1]] == ["id97", "id98", "pairX", "secondary98", "supp98", "unmapped"]
    code, out, _ = run("filter", "-S", "-h", "-p", "100", path["filter"])
    assert out.startswith("@HD") and "@PG\tID:strandframe" in out
    for flag in ("-b", "-u"):
        assert cli.run(["filter", "-S", flag, "-p", "100", path["filter"]], spark) == 0
        packed = capfdbinary.readouterr().out
        assert [r[1] for r in bam.decode(gzip.open(io.BytesIO(packed)))] == ["clip80", "clip90", "len80", "md_precedence", "pairX", "perfect100"]
    out_path = str(tmp_path / "p.gz")
    assert run("profile", "-S", path["profile"])[1].startswith("Use --help")
    assert run("profile", "-S", "--label", "x", "-o", out_path, "--multi", "equal", "--unit", "ab", "--nolen", "--total", "7", path["profile"])[0] == 0
    lines = _lines(out_path)
    assert "# Total inserts       : 7 (100.00%)" in lines
    assert "#   - Multiple mapped : 1 ( 14.29%)" in lines and lines[-4:] == ["ID\tx", "Unknown\t0", "A\t5.5", "B\t1.5"]
    assert run("profile", "-S", "--label", "x", "-o", out_path, "--no-pandas", path["profile"])[0] == 0
    assert "x" in _lines(out_path) and "# Total inserts       :      NA (    NA%)" in _lines(out_path)
    assert "cannot be used together" in run("profile", "-S", "--label", "x", "-o", out_path, "--pandas", "--no-pandas", path["profile"])[1]
    assert "--total must be a positive integer" in run("profile", "-S", "--label", "x", "-o", out_path, "--total", "0", path["profile"])[1]
    missing = tmp_path / "none.gz"
    assert run("profile", "-S", "--label", "x", "-o", str(missing), path["coordinate"])[0] == 1 and not missing.exists()
    assert run("coverage", "-S", "-z", "-o", out_path, "--summary", "-x", path["coverage"])[0] == 0
    assert _lines(out_path) == ["A\t0.70000000\t0.90", "C\t0.10000000\t0.10", "D\t0.62500000\t2.12"]
    assert run("coverage", "-S", "-w", "4", "-o", out_path, path["coverage"])[0] == 0 and _lines(out_path)[:2] == [">A", "1 0 1 1"]
    assert "-w must be" in run("coverage", "-w", "0", "-o", out_path, path["coverage"])[1]
    assert run("summary", "-S", "--count", path["summary_count"])[1] == "3\n"
    assert run("summary", "-S", "--stats", "mapped", path["summary"])[1] == "90\t1\n98\t1\n99\t1\n100\t3\n"
    assert len(run("summary", "-S", path["summary"])[1].split("\n")) == 7
    assert "Do not understand nonsense as mode" in run("summary", "-S", "--stats", "nonsense", path["summary"])[1]
    assert "-e must be a positive" in run("summary", "-e", "-1", path["summary"])[1]
    assert "--stats cannot" in run("summary", "--stats", "mapped", "--count", path["summary"])[1]
    assert "-e cannot" in run("summary", "-e", "10", "--count", path["summary"])[1]


def test_streaming_filter(spark, tmp_path, read):
    from strandframe.streaming import filter as streams

    df, *_ = read("filter")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = streams.filter_stream(stream, FilterOptions(percent_identity=100)).writeStream.format("memory").queryName("kept").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.qname for r in spark.table("kept").collect()) == ["clip80", "clip90", "len80", "md_precedence", "pairX", "perfect100"]
    counts = streams.target_counts(stream).writeStream.outputMode("complete").format("memory").queryName("targets").option("checkpointLocation", str(tmp_path / "c2")).start()
    counts.processAllAvailable()
    counts.stop()
    assert spark.table("targets").collect()[0].records == 14
    batches = []
    q = streams.best_hits_batches(stream.withColumn("as_score", F.lit(1)), FilterOptions(besthit=True), lambda b, n: batches.append(b.count()), str(tmp_path / "c3")).start()
    q.processAllAvailable()
    q.stop()
    assert sum(batches) == 14
    with pytest.raises(ValueError):
        streams.filter_stream(stream, FilterOptions(besthit=True))


def test_standard_input_and_gzipped_text(spark, tmp_path, capfdbinary, monkeypatch):
    """filter -b ... | profile - as through a pipe; a gzipped SAM file; parts in a folder."""
    import sys
    from types import SimpleNamespace

    path = samples.write(tmp_path, "filter")
    assert cli.run(["filter", "-S", "-b", "-p", "90", path], spark) == 0
    packed = capfdbinary.readouterr().out
    direct, piped = str(tmp_path / "a.gz"), str(tmp_path / "b.gz")
    (tmp_path / "f.bam").write_bytes(packed)
    assert cli.run(["profile", "--label", "x", "-o", direct, str(tmp_path / "f.bam")], spark) == 0
    monkeypatch.setattr(sys, "stdin", SimpleNamespace(buffer=io.BytesIO(packed)))
    assert cli.run(["profile", "--label", "x", "-o", piped, "-"], spark) == 0
    values = lambda p: [x for x in _lines(p) if not x.startswith("#")]
    assert values(direct) == values(piped) and len(values(piped)) > 2
    plain = open(path, "rb").read()
    for data in (plain, gzip.compress(plain)):
        capfdbinary.readouterr()
        monkeypatch.setattr(sys, "stdin", SimpleNamespace(buffer=io.BytesIO(data)))
        assert cli.run(["filter", "-S", "-p", "99", "-v", "-k", "-"], spark) == 0
        assert [x.split(b"\t")[0] for x in capfdbinary.readouterr().out.split(b"\n")[:-1]] == [b"id97", b"id98", b"pairX", b"secondary98", b"supp98", b"unmapped"]
    (tmp_path / "z.sam.gz").write_bytes(gzip.compress(plain))
    df, _ = commands.read(spark, str(tmp_path / "z.sam.gz"))
    assert df.count() == commands.read(spark, path)[0].count()
    folder = str(tmp_path / "parts")
    assert cli.run(["filter", "-S", "-b", "-p", "90", "-o", folder, path], spark) == 0
    assert {r.qname for r in commands.read(spark, folder)[0].collect()} == {r[1] for r in bam.decode(gzip.open(io.BytesIO(packed)))}


def test_first_records(spark, tmp_path):
    path = samples.write(tmp_path, "reopened")
    whole, header = commands.read(spark, path)
    first = commands.first_records(spark, path, header)
    assert [tuple(r)[1:] for r in first.orderBy("ord").collect()] == [tuple(r)[1:] for r in whole.orderBy("ord").collect()]
    with pytest.raises(ValueError, match="reappears at record"):
        qname.check_grouping(first, header)


def test_a_chromosome_of_positions(spark):
    """A target of 250 million positions: stretches, none longer than a piece; the sums are right."""
    refs = spark.createDataFrame([(0, "chr", 250_000_000), (1, "none", 3), (2, "empty", 0)], "tid int, rname string, tlen bigint")
    df = spark.createDataFrame([(0, 249_999_990, "20M"), (0, 1_048_570, "10M")], "tid int, pos0 bigint, cigar string")
    got = coverage.positions(df, refs).groupBy("tid").agg(F.count("*").alias("n"), F.sum("depth").alias("d"), F.max("pos").alias("m"), F.sum("pos").alias("s"))
    n = 250_000_000
    assert {tuple(r) for r in got.collect()} == {(0, n, 20, n - 1, n * (n - 1) // 2), (1, 3, 0, 2, 3)}
    assert {r.rname: r.touched for r in coverage.summary(df, refs).collect()} == {"chr": True, "none": False, "empty": False}
