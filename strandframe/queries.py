"""The registered queries over the alignment view, each through its operator, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.functions import cigar
from strandframe.operators import coverage, filter as filters, matrix, metrics, profile as profiles, qname, summary
from strandframe.operators.filter import FilterOptions
from strandframe.plans import commands
from strandframe.sources import testdata

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

#: The view and its statistics, for every SQL text below.
VIEW = f"""WITH refs AS ({testdata.REFS_SQL.format(supplier='supplier')}),
aln AS ({testdata.ALIGNMENTS_SQL.format(lineitem='lineitem')}),
st0 AS (
  SELECT *, flag & 4 <> 0 AS unmapped, flag & 192 AS mate,
    CAST(coalesce(list_sum(list_transform(regexp_extract_all(cigar, '(\\d+)[MID=X]', 1), lambda x: CAST(x AS BIGINT))), 0) AS BIGINT) AS alen,
    CAST(coalesce(list_sum(list_transform(regexp_extract_all(cigar, '(\\d+)[MISH=X]', 1), lambda x: CAST(x AS BIGINT))), 0) AS BIGINT) AS qlen,
    CAST(coalesce(list_sum(list_transform(regexp_extract_all(cigar, '(\\d+)[SH]', 1), lambda x: CAST(x AS BIGINT))), 0) AS BIGINT) AS clip,
    CAST(coalesce(list_sum(list_transform(regexp_extract_all(cigar, '(\\d+)[M=X]', 1), lambda x: CAST(x AS BIGINT))), 0) AS BIGINT) AS matched,
    CAST(coalesce(list_sum(list_transform(regexp_extract_all(cigar, '(\\d+)[ID]', 1), lambda x: CAST(x AS BIGINT))), 0) AS BIGINT) AS indel,
    CAST(len(regexp_extract_all(cigar, '\\d+[ID]')) AS BIGINT) AS gaps,
    CAST(coalesce(list_sum(list_transform(regexp_extract_all(cigar, '(\\d+)[MDN=X]', 1), lambda x: CAST(x AS BIGINT))), 0) AS BIGINT) AS span,
    CAST(length(regexp_replace(regexp_replace(regexp_replace(coalesce(md, ''), '^[^0-9^]+', ''), '\\^[^0-9^]+', '', 'g'), '[0-9^]', '', 'g')) AS BIGINT) AS mm
  FROM aln),
st AS (SELECT *, CASE WHEN md IS NOT NULL THEN indel + mm ELSE CAST(nm AS BIGINT) END AS edit FROM st0)
"""


def query(name: str, sql: str | None, view: bool = True):
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = (VIEW if view else "") + sql
        return f

    return register


def _round(*columns: str) -> dict[str, Column]:
    return {c: F.round(c, 6) for c in columns}


# projections


@query("aln_stats", "SELECT ord, alen, qlen, clip, matched AS aligned, indel, gaps, span, mm, edit, alen - 2 * edit AS rescored, CASE WHEN unmapped THEN -1 ELSE mate END AS mate FROM st")
def aln_stats(spark, sf_dir):
    mate = F.when(F.col("flag").bitwiseAND(4) != 0, F.lit(-1)).otherwise(F.col("flag").bitwiseAND(192))
    return testdata.alignments(spark, sf_dir).select(
        "ord", cigar.alignment_length().alias("alen"), cigar.query_length().alias("qlen"), cigar.query_clip().alias("clip"), cigar.sum_ops("M=X").alias("aligned"), cigar.sum_ops("ID").alias("indel"),
        cigar.gap_open().alias("gaps"), cigar.reference_span().alias("span"), cigar.md_mismatches().alias("mm"), cigar.edit_distance().alias("edit"), cigar.rescored().cast("bigint").alias("rescored"), mate.alias("mate"),
    )


# filters

_L, _P, _Z = "alen >= 80", "1000 * (alen - edit) >= alen * 950", "100 * clip <= 20 * qlen"
_FILTERS = {
    "filter_len": (FilterOptions(min_length=80), _L),
    "filter_pid": (FilterOptions(percent_identity=95), _P),
    "filter_ppt": (FilterOptions(ppt=985), "1000 * (alen - edit) >= alen * 985"),
    "filter_ppt_neg": (FilterOptions(ppt=-950), "1000 * (alen - edit) <= alen * 950"),
    "filter_qfrac": (FilterOptions(min_query_percent=80), _Z),
    "filter_lp": (FilterOptions(min_length=80, percent_identity=95), f"{_L} AND {_P}"),
    "filter_lz": (FilterOptions(min_length=80, min_query_percent=80), f"{_L} AND {_Z}"),
    "filter_pz": (FilterOptions(percent_identity=95, min_query_percent=80), f"{_P} AND {_Z}"),
    "filter_lpz": (FilterOptions(min_length=80, percent_identity=95, min_query_percent=80), f"{_L} AND {_P} AND {_Z}"),
    "filter_invert": (FilterOptions(min_length=80, percent_identity=95, min_query_percent=80, invert=True), f"NOT ({_L} AND {_P} AND {_Z})"),
    "filter_invert_keep_unmapped": (FilterOptions(percent_identity=95, invert=True, keep_unmapped=True), None),
    "filter_neg_keep_unmapped": (FilterOptions(ppt=-950, keep_unmapped=True), "1000 * (alen - edit) <= alen * 950"),
}


def _register_filters() -> None:
    for name, (options, sql) in _FILTERS.items():
        where = f"NOT unmapped AND {sql}" if sql else f"unmapped OR NOT ({_P})"
        query(name, f"SELECT ord, qname, flag, tid, pos0, cigar FROM st WHERE {where}")(
            lambda spark, sf_dir, options=options: filters.filter_alignments(testdata.alignments(spark, sf_dir), options).select("ord", "qname", "flag", "tid", "pos0", "cigar")
        )


_register_filters()


@query("rescore", "SELECT ord, CASE WHEN unmapped THEN as_score ELSE CAST(alen - 2 * edit AS INT) END AS as_score FROM st")
def rescore(spark, sf_dir):
    return filters.rescore(testdata.alignments(spark, sf_dir)).select("ord", "as_score")


def _besthit_sql(source: str, unique: bool) -> str:
    return f""", b1 AS ({source}),
b2 AS (SELECT *, max(score) OVER (PARTITION BY qname, mate) AS best, bool_or(mate <> 0) OVER (PARTITION BY qname) AS paired FROM b1),
b3 AS (SELECT *, count(*) FILTER (WHERE score = best) OVER (PARTITION BY qname, mate) AS times FROM b2)
SELECT ord, qname, flag, score AS as_score FROM b3 WHERE score = best AND (NOT paired OR mate IN (64, 128)){' AND times = 1' if unique else ''}"""


_MAPPED = "SELECT *, as_score AS score FROM st WHERE NOT unmapped"
_BESTHITS = {
    "besthit": (FilterOptions(besthit=True), _MAPPED),
    "uniqhit": (FilterOptions(uniqhit=True), _MAPPED),
    "filter_besthit": (FilterOptions(min_length=80, percent_identity=95, min_query_percent=80, besthit=True), f"{_MAPPED} AND {_L} AND {_P} AND {_Z}"),
    "filter_uniqhit": (FilterOptions(percent_identity=95, uniqhit=True), f"{_MAPPED} AND {_P}"),
    "rescore_besthit": (FilterOptions(rescore=True, besthit=True), "SELECT *, CAST(alen - 2 * edit AS INT) AS score FROM st WHERE NOT unmapped"),
    "rescore_uniqhit": (FilterOptions(rescore=True, uniqhit=True), "SELECT *, CAST(alen - 2 * edit AS INT) AS score FROM st WHERE NOT unmapped"),
}


def _register_besthits() -> None:
    for name, (options, sql) in _BESTHITS.items():
        query(name, _besthit_sql(sql, options.uniqhit))(
            lambda spark, sf_dir, options=options: filters.filter_alignments(testdata.alignments(spark, sf_dir), options).select("ord", "qname", "flag", "as_score")
        )


_register_besthits()


# profiles

_CLASSES = """, cl AS (SELECT fids, count(*) AS n FROM (SELECT qname, list_sort(list(DISTINCT tid)) AS fids FROM aln WHERE tid IS NOT NULL GROUP BY qname) GROUP BY fids),
feat AS (SELECT CAST(tid AS BIGINT) AS fid, rname AS feature, tlen AS flen FROM refs),
"""
_GENOME_CLASSES = """, cl AS (
  SELECT fids, count(*) AS n FROM (
    SELECT qname, list_sort(list(DISTINCT fid)) AS fids
    FROM aln JOIN (SELECT tid, min(CAST(genome_id AS BIGINT) * 1000000 + tid) OVER (PARTITION BY genome_id) AS fid FROM refs) g USING (tid) GROUP BY qname)
  GROUP BY fids),
feat AS (SELECT min(CAST(genome_id AS BIGINT) * 1000000 + tid) AS fid, concat('genome', genome_id) AS feature, CAST(sum(tlen) AS BIGINT) AS flen FROM refs GROUP BY genome_id),
"""
_COUNTS = """cnt AS (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS mapped, CAST(coalesce(sum(n) FILTER (WHERE len(fids) > 1), 0) AS BIGINT) AS multi FROM cl),
"""


def _shares_sql(multi: str) -> str:
    """shares(fid, value) and purge(purged)."""
    if multi == "proportional":
        steps = ["""u AS (SELECT fids[1] AS fid, CAST(sum(n) AS DOUBLE) AS v FROM cl WHERE len(fids) = 1 GROUP BY 1),
m AS MATERIALIZED (SELECT row_number() OVER (ORDER BY fids) AS cid, n, unnest(fids) AS fid FROM cl WHERE len(fids) > 1),
own AS MATERIALIZED (SELECT feat.fid, coalesce(u.v, 0.0) AS v FROM feat LEFT JOIN u USING (fid)),
a0 AS MATERIALIZED (SELECT fid, v, false AS done FROM own)"""]
        for k in range(1, profiles.MAX_STEPS + 1):
            p = f"a{k - 1}"
            steps.append(f"""s{k} AS (SELECT cid, sum(v) AS s FROM m JOIN {p} USING (fid) GROUP BY cid),
g{k} AS (SELECT fid, sum(n * v / s) AS g FROM m JOIN {p} USING (fid) JOIN s{k} USING (cid) WHERE s > 0 GROUP BY fid),
n{k} AS MATERIALIZED (SELECT o.fid, CASE WHEN o.v + coalesce(g, 0) < 1e-20 THEN 0.0 ELSE o.v + coalesce(g, 0) END AS v FROM own o LEFT JOIN g{k} USING (fid)),
d{k} AS MATERIALIZED (SELECT (SELECT bool_or(done) FROM {p}) AS before, sum((x.v - y.v) * (x.v - y.v)) / count(*) < 1e-10 AS small FROM n{k} x JOIN {p} y USING (fid)),
a{k} AS MATERIALIZED (SELECT x.fid, CASE WHEN before THEN y.v ELSE x.v END AS v, before OR small AS done FROM n{k} x JOIN {p} y USING (fid), d{k})""")
        last = f"a{profiles.MAX_STEPS}"
        steps.append(f"""shares AS (SELECT fid, v AS value FROM {last}),
purge AS (SELECT CAST(coalesce(sum(n), 0) AS DOUBLE) AS purged FROM (SELECT cid, any_value(n) AS n FROM m JOIN {last} USING (fid) GROUP BY cid HAVING sum(v) <= 0))""")
        return ",\n".join(steps)
    share = {"all": "CAST(n AS DOUBLE)", "equal": "n / CAST(len(fids) AS DOUBLE)", "ignore": "CAST(n AS DOUBLE)"}[multi]
    where = " WHERE len(fids) = 1" if multi == "ignore" else ""
    return f"shares AS (SELECT fid, sum(w) AS value FROM (SELECT unnest(fids) AS fid, {share} AS w FROM cl{where}) GROUP BY fid),\npurge AS (SELECT 0.0 AS purged)"


def _digits(unit: str) -> int:
    """Decimals to compare: large units have fewer that both engines agree on."""
    return 3 if unit in ("tpm", "fpkm") else 6


def _profile_sql(multi: str, unit: str, total: int | None = None, mincount: int = 0, nolen: bool = False, genome: bool = False) -> str:
    by_length = unit in ("fpkm", "tpm") or not nolen
    known = f"(SELECT mapped <= {total} FROM cnt)" if total else "false"
    unknown = f"CASE WHEN {known} THEN {total or 0} - mapped + purged + gone + {'multi' if multi == 'ignore' else '0'} ELSE 0.0 END"
    if by_length:
        unknown = f"({unknown}) / (SELECT sum(flen) // count(*) FROM feat)"
    value = f"CASE WHEN v < {mincount} THEN 0.0 ELSE v END" + (" / flen" if by_length else "")
    factor = {
        "abundance": "value",
        "relative": "value / sum(value) OVER ()",
        "tpm": "value / sum(value) OVER () * 1e6",
        "fpkm": f"value * 1e9 / (SELECT CASE WHEN {known} THEN {total or 0} ELSE mapped END FROM cnt)",
    }[unit]
    return (_GENOME_CLASSES if genome else _CLASSES) + _COUNTS + _shares_sql(multi) + f""",
val AS (SELECT fid, feature, flen, coalesce(value, 0.0) AS v FROM feat LEFT JOIN shares USING (fid)),
low AS (SELECT coalesce(sum(v) FILTER (WHERE v < {mincount}), 0.0) AS gone FROM val),
made AS (SELECT fid AS feature_ord, feature, {value} AS value FROM val UNION ALL SELECT -1, 'Unknown', {unknown} FROM cnt, purge, low)
SELECT feature_ord, feature, round({factor}, {_digits(unit)}) AS value FROM made"""


_PROFILES: dict[str, dict] = {
    "profile_all_ab_nolen": {"multi": "all", "unit": "abundance", "nolen": True},
    "profile_equal_ab_nolen": {"multi": "equal", "unit": "abundance", "nolen": True},
    "profile_ignore_ab_nolen": {"multi": "ignore", "unit": "abundance", "nolen": True},
    "profile_all_rel": {"multi": "all", "unit": "relative"},
    "profile_equal_rel": {"multi": "equal", "unit": "relative"},
    "profile_equal_rel_nolen": {"multi": "equal", "unit": "relative", "nolen": True},
    "profile_equal_tpm": {"multi": "equal", "unit": "tpm"},
    "profile_equal_fpkm": {"multi": "equal", "unit": "fpkm"},
    "profile_equal_ab": {"multi": "equal", "unit": "abundance"},
    "profile_equal_rel_total": {"multi": "equal", "unit": "relative", "total": 1_000_000},
    "profile_equal_fpkm_total": {"multi": "equal", "unit": "fpkm", "total": 1_000_000},
    "profile_ignore_ab_total": {"multi": "ignore", "unit": "abundance", "nolen": True, "total": 1_000_000},
    "profile_mincount": {"multi": "equal", "unit": "abundance", "nolen": True, "total": 1_000_000, "mincount": 165},
    "profile_total_too_small": {"multi": "equal", "unit": "relative", "total": 10},
    "profile_genome_equal_rel": {"multi": "equal", "unit": "relative", "genome": True},
    "profile_genome_all_ab_nolen": {"multi": "all", "unit": "abundance", "nolen": True, "genome": True},
    "profile_genome_prop_tpm": {"multi": "proportional", "unit": "tpm", "genome": True},
    "profile_prop_ab_nolen": {"multi": "proportional", "unit": "abundance", "nolen": True},
    "profile_prop_rel": {"multi": "proportional", "unit": "relative"},
    "profile_prop_fpkm_total": {"multi": "proportional", "unit": "fpkm", "total": 1_000_000},
    "profile_prop_mincount": {"multi": "proportional", "unit": "abundance", "nolen": True, "total": 1_000_000, "mincount": 165},
}


def _profile(spark, sf_dir, genome: bool = False, **options) -> profiles.Profile:
    import warnings

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return profiles.profile(testdata.alignments(spark, sf_dir), testdata.refs(spark, sf_dir), testdata.genomes(spark, sf_dir) if genome else None, **options)


def _register_profiles() -> None:
    for name, options in _PROFILES.items():
        query(name, _profile_sql(**options))(lambda spark, sf_dir, options=options: _profile(spark, sf_dir, **options).values.withColumn("value", F.round("value", _digits(options["unit"]))))


_register_profiles()


@query("insert_classes", _CLASSES + "x AS (SELECT 1) SELECT array_to_string(fids, ',') AS fids, n FROM cl")
def insert_classes(spark, sf_dir):
    return profiles.insert_classes(testdata.alignments(spark, sf_dir)).select(F.array_join(F.col("fids").cast("array<string>"), ",").alias("fids"), "n")


@query("insert_counts", _CLASSES + _COUNTS + "x AS (SELECT 1) SELECT mapped, multi, mapped - multi AS uniq FROM cnt")
def insert_counts(spark, sf_dir):
    return profiles.counts(profiles.insert_classes(testdata.alignments(spark, sf_dir))).withColumnRenamed("unique", "uniq")


@query("insert_counts_genome", _GENOME_CLASSES + _COUNTS + "x AS (SELECT 1) SELECT mapped, multi, mapped - multi AS uniq FROM cnt")
def insert_counts_genome(spark, sf_dir):
    _, feature_map = profiles.genome_features(testdata.refs(spark, sf_dir), testdata.genomes(spark, sf_dir))
    return profiles.counts(profiles.insert_classes(testdata.alignments(spark, sf_dir), feature_map)).withColumnRenamed("unique", "uniq")


@query("profile_purged", _CLASSES + _COUNTS + _shares_sql("proportional") + " SELECT mapped, multi, mapped - purged AS effective, purged FROM cnt, purge")
def profile_purged(spark, sf_dir):
    p = _profile(spark, sf_dir, multi="proportional", unit="abundance", nolen=True)
    return spark.createDataFrame([(p.mapped, p.multi, float(p.effective), float(p.purged))], "mapped bigint, multi bigint, effective double, purged double")


def _flagship_sql() -> str:
    best = f"""({_MAPPED} AND {_L} AND {_P} AND {_Z})"""
    hits = f""", b1 AS {best},
b2 AS (SELECT *, max(score) OVER (PARTITION BY qname, mate) AS best, bool_or(mate <> 0) OVER (PARTITION BY qname) AS paired FROM b1),
hit AS (SELECT qname, tid FROM b2 WHERE score = best AND (NOT paired OR mate IN (64, 128)))"""
    return hits + _profile_sql("proportional", "relative").replace("FROM aln WHERE tid IS NOT NULL", "FROM hit WHERE tid IS NOT NULL")


@query("filter_besthit_profile", _flagship_sql())
def filter_besthit_profile(spark, sf_dir):
    """filter -l 80 -p 95 -z 80 --besthit, then profile --multi proportional --unit rel."""
    options = FilterOptions(min_length=80, percent_identity=95, min_query_percent=80, besthit=True)
    made = commands.filtered_profile(testdata.alignments(spark, sf_dir), testdata.refs(spark, sf_dir), options, multi="proportional", unit="relative")
    return made.values.withColumns(_round("value"))


@query("ambiguous_pairs", _CLASSES + "x AS (SELECT n, unnest(fids) AS a, fids FROM cl WHERE len(fids) > 1), y AS (SELECT n, a, unnest(fids) AS b FROM x) SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, CAST(sum(n) AS BIGINT) AS n FROM y WHERE a < b GROUP BY ALL")
def ambiguous_pairs(spark, sf_dir):
    return metrics.pair_counts(profiles.insert_classes(testdata.alignments(spark, sf_dir)))


# coverage

_BLOCKS = """, op AS (
  SELECT tid, pos0, k, CAST(regexp_extract(x, '\\d+') AS BIGINT) AS n, right(x, 1) AS op, ord
  FROM (SELECT tid, pos0, ord, unnest(xs) AS x, unnest(range(len(xs))) AS k
        FROM (SELECT tid, pos0, ord, regexp_extract_all(cigar, '\\d+[MDN=X]') AS xs FROM aln WHERE tid IS NOT NULL))),
bl AS (SELECT tid, op, pos0 + sum(n) OVER (PARTITION BY ord ORDER BY k) - n AS b, pos0 + sum(n) OVER (PARTITION BY ord ORDER BY k) AS e FROM op),
cut AS (SELECT tid, greatest(b, 0) AS b, least(e, tlen) AS e FROM bl JOIN refs USING (tid) WHERE op IN ('M', '=', 'X')),
dp AS (SELECT tid, p AS pos, count(*) AS depth FROM (SELECT tid, unnest(range(CAST(b AS BIGINT), CAST(e AS BIGINT))) AS p FROM cut) GROUP BY ALL)
"""
_SUMMARY = """, cv AS (SELECT tid, count(*) AS covered, sum(depth) AS bases FROM dp GROUP BY tid),
tc AS (SELECT DISTINCT tid, true AS touched FROM aln WHERE tid IS NOT NULL)
SELECT r.tid, rname, coalesce(touched, false) AS touched, round(coalesce(covered, 0) / tlen, 6) AS breadth, round(CAST(coalesce(bases, 0) AS DOUBLE) / tlen, 6) AS mean_depth
FROM refs r LEFT JOIN tc ON r.tid = tc.tid LEFT JOIN cv ON r.tid = cv.tid"""


@query("coverage_summary", _BLOCKS + _SUMMARY)
def coverage_summary(spark, sf_dir):
    return coverage.summary(testdata.alignments(spark, sf_dir), testdata.refs(spark, sf_dir)).withColumns(_round("breadth", "mean_depth"))


@query("coverage_summary_skip", _BLOCKS + _SUMMARY + " WHERE touched")
def coverage_summary_skip(spark, sf_dir):
    return coverage.summary(testdata.alignments(spark, sf_dir), testdata.refs(spark, sf_dir), skip_uncovered=True).withColumns(_round("breadth", "mean_depth"))


@query("coverage_positions", _BLOCKS + "SELECT r.tid, r.pos, coalesce(depth, 0) AS depth FROM (SELECT tid, unnest(range(tlen)) AS pos FROM refs) r LEFT JOIN dp ON r.tid = dp.tid AND r.pos = dp.pos")
def coverage_positions(spark, sf_dir):
    return coverage.positions(testdata.alignments(spark, sf_dir), testdata.refs(spark, sf_dir))


@query("coverage_segments", _BLOCKS + """, ch AS (SELECT *, CASE WHEN lag(depth) OVER w = depth AND lag(pos) OVER w = pos - 1 THEN 0 ELSE 1 END AS s FROM dp WINDOW w AS (PARTITION BY tid ORDER BY pos)),
gr AS (SELECT *, sum(s) OVER (PARTITION BY tid ORDER BY pos) AS g FROM ch)
SELECT tid, min(pos) AS "start", max(pos) + 1 AS "end", any_value(depth) AS depth FROM gr GROUP BY tid, g""")
def coverage_segments(spark, sf_dir):
    return coverage.segments(testdata.alignments(spark, sf_dir), testdata.refs(spark, sf_dir))


# summary

_PRIMARY = ", pr AS (SELECT st.*, r.rname, r.tlen, matched - mm AS hit, mm + clip + indel AS sedit FROM st JOIN refs r ON st.tid = r.tid WHERE NOT unmapped AND flag & 256 = 0 AND pos0 >= {edge} AND tlen - (pos0 + greatest(1, span)) >= {edge})\n"
_ROWS = "SELECT ord, qname, qlen, rname, alen + clip AS glocal, hit AS match, round(100 - 100.0 * sedit / (alen + clip), 6) AS identity FROM pr"


@query("summary_rows", _PRIMARY.format(edge=0) + _ROWS)
def summary_rows(spark, sf_dir):
    return summary.rows(testdata.alignments(spark, sf_dir), testdata.refs(spark, sf_dir)).withColumns(_round("identity"))


@query("summary_edge", _PRIMARY.format(edge=100) + _ROWS)
def summary_edge(spark, sf_dir):
    return summary.rows(testdata.alignments(spark, sf_dir), testdata.refs(spark, sf_dir), 100).withColumns(_round("identity"))


def _register_histograms() -> None:
    for mode, sql in {"mapped": "hit", "unmapped": "qlen - hit", "edit": "sedit", "score": "hit - sedit"}.items():
        query(f"hist_{mode}", _PRIMARY.format(edge=0) + f"SELECT least(greatest({sql}, 0), 4096) AS bin, count(*) AS n FROM pr GROUP BY 1")(
            lambda spark, sf_dir, mode=mode: summary.histogram(testdata.alignments(spark, sf_dir), testdata.refs(spark, sf_dir), mode)
        )


_register_histograms()


@query("summary_totals", _PRIMARY.format(edge=0) + "SELECT CAST(sum(hit) AS BIGINT) AS total_mapped, CAST(sum(qlen - hit) AS BIGINT) AS total_unmapped, CAST(sum(sedit) AS BIGINT) AS total_edit, CAST(sum(hit - sedit) AS BIGINT) AS total_score FROM pr")
def summary_totals(spark, sf_dir):
    return summary.totals(testdata.alignments(spark, sf_dir), testdata.refs(spark, sf_dir))


@query("count_inserts", "SELECT count(*) AS n FROM (SELECT qname, lag(qname) OVER (ORDER BY ord) AS p FROM st WHERE NOT unmapped) WHERE p IS NULL OR p <> qname")
def count_inserts(spark, sf_dir):
    return summary.count_inserts(testdata.alignments(spark, sf_dir), grouped=False)


@query("count_inserts_grouped", "SELECT count(DISTINCT qname) AS n FROM st WHERE NOT unmapped")
def count_inserts_grouped(spark, sf_dir):
    return summary.count_inserts(testdata.alignments(spark, sf_dir))


# order of the input


def _by_position(spark, sf_dir) -> DataFrame:
    """The view in order of position, where reads aren't grouped."""
    return testdata.alignments(spark, sf_dir).withColumn("ord", F.coalesce("pos0", F.lit(900)) * 100_000_000_000 + F.col("ord"))


@query("qname_reopened", """, h AS (SELECT qname, row_number() OVER (ORDER BY o) AS record FROM (SELECT qname, coalesce(pos0, 900) * 100000000000 + ord AS o FROM st) ORDER BY o LIMIT 10000),
s AS (SELECT *, CASE WHEN lag(qname) OVER (ORDER BY record) = qname THEN 0 ELSE 1 END AS c FROM h),
g AS (SELECT *, sum(c) OVER (ORDER BY record) AS run FROM s),
r AS (SELECT run, any_value(qname) AS qname, min(record) AS "first", max(record) AS last FROM g GROUP BY run)
SELECT * FROM (SELECT qname, "first", lag(last) OVER (PARTITION BY qname ORDER BY run) AS previous_last FROM r) WHERE previous_last IS NOT NULL""")
def qname_reopened(spark, sf_dir):
    return qname.reopened(_by_position(spark, sf_dir))


@query("coord_order_check", """, h AS (SELECT * FROM (SELECT *, coalesce(pos0, 900) * 100000000000 + ord AS o FROM st) ORDER BY o LIMIT 100000),
m AS (SELECT tid, pos0, lag(tid) OVER (ORDER BY o) AS pt, lag(pos0) OVER (ORDER BY o) AS pp FROM h WHERE NOT unmapped AND tid IS NOT NULL)
SELECT (SELECT count(*) FROM h) AS input_records, (SELECT count(*) FROM m) AS mapped_records,
       (SELECT count(*) = 0 FROM m WHERE tid < pt OR (tid = pt AND pos0 < pp)) AS coordinate_ordered, (SELECT bool_or(flag & 2305 <> 0) FROM h) AS relevant""")
def coord_order_check(spark, sf_dir):
    return qname.order_statistics(_by_position(spark, sf_dir))


# matrices: customers by nation and market segment

_M = "WITH m AS (SELECT c_nationkey AS i, c_mktsegment AS j, CAST(count(*) AS DOUBLE) AS v FROM customer GROUP BY ALL), b AS (SELECT c_nationkey AS i, c_mktsegment AS j, sum(c_acctbal) AS v FROM customer GROUP BY ALL)\n"


def _m(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").groupBy(F.col("c_nationkey").alias("i"), F.col("c_mktsegment").alias("j"))
    return c.agg(F.count("*").cast("double").alias("v")), c.agg(F.sum("c_acctbal").cast("double").alias("v"))


_MATRICES: dict[str, tuple] = {
    "matrix_transpose": (lambda m, b: matrix.transpose(m), "SELECT j AS i, i AS j, v FROM m"),
    "matrix_square": (lambda m, b: matrix.square(m), "SELECT i, j, v * v AS v FROM m"),
    "matrix_add": (lambda m, b: matrix.add(m, b, check=False), "SELECT i, j, coalesce(m.v, 0) + coalesce(b.v, 0) AS v FROM m FULL JOIN b USING (i, j)"),
    "matrix_subtract": (lambda m, b: matrix.subtract(b, m, check=False), "SELECT i, j, coalesce(b.v, 0) - coalesce(m.v, 0) AS v FROM m FULL JOIN b USING (i, j)"),
    "matrix_multiply": (lambda m, b: matrix.multiply(matrix.transpose(m), b), "SELECT m.j AS i, b.j AS j, sum(m.v * b.v) AS v FROM m JOIN b ON m.i = b.i GROUP BY ALL"),
    "matrix_scale": (lambda m, b: matrix.divide(matrix.scale(m, 3.5), 7.0), "SELECT i, j, v * 3.5 / 7 AS v FROM m"),
    "matrix_row_normalise": (lambda m, b: matrix.row_normalise(m), "SELECT i, j, v / sum(v) OVER (PARTITION BY i) AS v FROM m"),
    "matrix_column_normalise": (lambda m, b: matrix.column_normalise(m), "SELECT i, j, v / sum(v) OVER (PARTITION BY j) AS v FROM m"),
    "matrix_log": (lambda m, b: matrix.log(m), "SELECT i, j, ln(v) AS v FROM m"),
    "matrix_fill": (lambda m, b: matrix.fill(m), "SELECT i, j, CAST(0 AS DOUBLE) AS v FROM m"),
}


def _register_matrices() -> None:
    for name, (f, sql) in _MATRICES.items():
        query(name, f"{_M}SELECT i, j, round(CAST(v AS DOUBLE), 4) AS v FROM ({sql})", view=False)(lambda spark, sf_dir, f=f: f(*_m(spark, sf_dir)).select("i", "j", F.round("v", 4).alias("v")))


_register_matrices()

_ABS = "WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)) + 0.01) AS p, list_transform(list_reverse(embedding), lambda x: abs(CAST(x AS DOUBLE)) + 0.01) AS q FROM embeddings),\n"


@query("kl_js_divergence", _ABS + """d AS (SELECT vec_id, list_transform(p, lambda x: x / list_sum(p)) AS p, list_transform(q, lambda x: x / list_sum(q)) AS q FROM e),
k AS (SELECT vec_id, list_sum(list_transform(range(1, len(p) + 1), lambda i: p[i] * ln(p[i] / q[i]))) AS kl,
      (list_sum(list_transform(range(1, len(p) + 1), lambda i: p[i] * ln(p[i] / ((p[i] + q[i]) / 2)))) + list_sum(list_transform(range(1, len(p) + 1), lambda i: q[i] * ln(q[i] / ((p[i] + q[i]) / 2))))) / 2 AS js FROM d)
SELECT vec_id, round(kl, 6) AS kl, round(js, 6) AS js, round(sqrt(greatest(js, 0)), 6) AS distance FROM k""", view=False)
def kl_js_divergence(spark, sf_dir):
    positive = lambda a: F.transform(a, lambda x: F.abs(x.cast("double")) + 0.01)
    share = lambda a: F.transform(a, lambda x: x / matrix.vector_sum(F.col(a)))
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", positive(F.col("embedding")).alias("p"), positive(F.reverse("embedding")).alias("q"))
    e = e.select("vec_id", share("p").alias("p"), share("q").alias("q"))
    p, q = F.col("p"), F.col("q")
    return e.select("vec_id", F.round(matrix.kl_divergence(p, q), 6).alias("kl"), F.round(matrix.js_divergence(p, q), 6).alias("js"), F.round(matrix.js_distance(p, q), 6).alias("distance"))


@query("kl_js_zeros", """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: greatest(CAST(x AS DOUBLE), 0)) AS a, list_transform(list_reverse(embedding), lambda x: abs(CAST(x AS DOUBLE))) AS b FROM embeddings),
v AS (SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN a ELSE b END AS p, CASE WHEN vec_id % 3 = 1 THEN a ELSE b END AS q FROM e),
k AS (SELECT vec_id, len(list_filter(p, lambda x: x = 0)) AS zp, len(list_filter(range(1, len(p) + 1), lambda i: p[i] > 0 AND q[i] = 0)) AS zq,
      list_sum(list_transform(range(1, len(p) + 1), lambda i: CASE WHEN p[i] > 0 AND q[i] > 0 THEN p[i] * ln(p[i] / q[i]) ELSE 0 END)) AS kl FROM v)
SELECT vec_id, CASE WHEN zp > 0 THEN 'nan' WHEN zq > 0 THEN 'inf' END AS kl_class, CASE WHEN zp = 0 AND zq = 0 THEN round(kl, 6) END AS kl FROM k""", view=False)
def kl_js_zeros(spark, sf_dir):
    """Zeros in p of every third vector, in q of another."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.transform("embedding", lambda x: F.greatest(x.cast("double"), F.lit(0.0))).alias("a"), F.transform(F.reverse("embedding"), lambda x: F.abs(x.cast("double"))).alias("b"))
    pick = lambda k: F.when(F.col("vec_id") % 3 == k, F.col("a")).otherwise(F.col("b"))
    e = e.select("vec_id", pick(0).alias("p"), pick(1).alias("q")).select("vec_id", matrix.kl_divergence(F.col("p"), F.col("q")).alias("kl"))
    class_ = F.when(F.isnan("kl"), "nan").when(F.col("kl") == float("inf"), "inf")
    return e.select("vec_id", class_.alias("kl_class"), F.when(class_.isNull(), F.round("kl", 6)).alias("kl"))


@query("matrix_log_zeros", f"{_M}SELECT i, j, CASE WHEN v = 0 THEN '-inf' WHEN v < 0 THEN 'nan' END AS log_class, CASE WHEN v > 0 THEN round(ln(v), 4) END AS v FROM (SELECT i, j, v - 12 AS v FROM m)", view=False)
def matrix_log_zeros(spark, sf_dir):
    m = matrix.log(matrix.mapped(_m(spark, sf_dir)[0], lambda v: v - 12))
    class_ = F.when(F.isnan("v"), "nan").when(F.col("v") == float("-inf"), "-inf")
    return m.select("i", "j", class_.alias("log_class"), F.when(class_.isNull(), F.round("v", 4)).alias("v"))


@query("vector_statistics", "SELECT vec_id, round(list_avg(e), 6) AS mean, round(list_stddev_samp(e), 6) AS sd, round(list_min(e), 6) AS low, round(list_max(e), 6) AS high FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)", view=False)
def vector_statistics(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    return e.select("vec_id", F.round(matrix.mean(F.col("e")), 6).alias("mean"), F.round(matrix.sample_stdev(F.col("e")), 6).alias("sd"), F.round(F.array_min("e"), 6).alias("low"), F.round(F.array_max("e"), 6).alias("high"))


# accuracy: profiles of equal sharing against proportional sharing, per genome


def _truth(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Customers' shares of each nation in the segments, and their balances' shares."""
    m, b = _m(spark, sf_dir)
    both = [matrix.row_normalise(x.withColumn("v", F.abs("v"))).select("i", F.col("j").alias("feature"), F.col("v").alias("value")) for x in (m, b)]
    return both[0], both[1]


_T = _M + """, p AS (SELECT i, j AS feature, coalesce(m.v / ms, 0) AS t, coalesce(abs(b.v) / bs, 0) AS e FROM m FULL JOIN b USING (i, j)
  JOIN (SELECT i, sum(v) AS ms FROM m GROUP BY i) USING (i) JOIN (SELECT i, CAST(sum(abs(v)) AS DOUBLE) AS bs FROM b GROUP BY i) USING (i))
"""
_T = _T.replace("\n, p", ", p")


@query("abundance_errors", _T + "SELECT i, round(avg(abs(e - t)), 6) AS mae, round(sqrt(avg((e - t) * (e - t))), 6) AS rmse, round(0.5 * sum(abs(e - t)), 6) AS tvd, round(sum(abs(e - t)) / sum(t + e), 6) AS bray_curtis, round(max(abs(e - t)), 6) AS max_error FROM p GROUP BY i", view=False)
def abundance_errors(spark, sf_dir):
    pairs = metrics.paired(*_truth(spark, sf_dir), ["i"])
    return metrics.errors(pairs, ["i"]).withColumns(_round("mae", "rmse", "tvd", "bray_curtis", "max_error"))


@query("abundance_correlation", _T + """, r AS (SELECT i, feature, t, e, rank() OVER (PARTITION BY i ORDER BY t) + (count(*) OVER (PARTITION BY i, t) - 1) / 2.0 AS rt, rank() OVER (PARTITION BY i ORDER BY e) + (count(*) OVER (PARTITION BY i, e) - 1) / 2.0 AS re FROM p)
SELECT i, round(CASE WHEN stddev_pop(t) > 0 AND stddev_pop(e) > 0 THEN corr(t, e) END, 5) AS pearson, round(CASE WHEN stddev_pop(rt) > 0 AND stddev_pop(re) > 0 THEN corr(rt, re) END, 5) AS spearman FROM r GROUP BY i""", view=False)
def abundance_correlation(spark, sf_dir):
    pairs = metrics.paired(*_truth(spark, sf_dir), ["i"])
    both = metrics.pearson(pairs, ["i"]).join(metrics.spearman(pairs, ["i"]), "i")
    return both.select("i", F.round("pearson", 5).alias("pearson"), F.round("spearman", 5).alias("spearman"))


@query("seed_statistics", "SELECT c_mktsegment AS segment, count(*) AS n, round(avg(c_acctbal), 4) AS mean, round(coalesce(stddev_samp(c_acctbal), 0), 4) AS sd FROM customer GROUP BY 1", view=False)
def seed_statistics(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").cast("double").alias("x"))
    return metrics.seed_statistics(rows, ["segment"], "x").withColumns({c: F.round(c, 4) for c in ("mean", "sd")})


@query("largest_remainder", _M + """, x AS (SELECT i, j, 1000 * v / sum(v) OVER (PARTITION BY i) AS x FROM m),
f AS (SELECT *, floor(x) AS f FROM x), t AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY x - f DESC, j) AS turn, 1000 - sum(f) OVER (PARTITION BY i) AS rest FROM f)
SELECT i, j, CAST(f AS BIGINT) + CASE WHEN turn <= rest THEN 1 ELSE 0 END AS share FROM t""".replace(", x", ", x", 1), view=False)
def largest_remainder(spark, sf_dir):
    m, _ = _m(spark, sf_dir)
    return metrics.largest_remainder(m.withColumn("total", F.lit(1000).cast("bigint")), ["i"], "total", "j", "v").select("i", "j", "share")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
