import hashlib
import html
import io
import math
import random
import re
import struct
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandframe.llm import chat, chroma, common, html_text, imatch, language_id, mixing, packing, queries, simhash, token_store, tokens, warc

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls, empty and long texts, repeated rows, letters beyond ASCII, special strings.
AWKWARD = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, "one two three four five six", "en", "a", 27),
    (3, "one two three four five six", "en", "a", 27),
    (4, "one two three four five six", "en", None, 27),
    (5, "Ünïcode 日本語 <|endoftext|> a  b\n \n c\t", "de", "b", 0),
    (None, "no id at all", "en", "b", 0),
    (7, "lorem ipsum dolor " * 20_000, "fr", "b", 0),
    (8, " \n\t ", None, "c", 0),
    (-9, "...", "en", "c", 0),
]


@pytest.fixture(scope="module")
def docs(spark):
    """Awkward rows, with extra columns whose names operators use inside."""
    extra = {c: F.lit("x") for c in ("size", "ids", "vertex", "grp", "shard", "bucket", "html", "digest", "p0", "codes", "rank", "page_id", "conv_id")}
    return spark.createDataFrame(AWKWARD, DOCS).withColumns(extra).persist()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").persist()


def same_as_sql(spark, name, folder=SMALL):
    con = duckdb.connect()
    for t in ("pages", "documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    sql = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, folder)
    assert sorted(got.columns) == sorted(sql.columns)
    return Counter(tuple(r[c] for c in sql.columns) for r in got.collect()) == Counter(sql.fetchall())


# tokens


@pytest.fixture(scope="module")
def encoder():
    return tokens.PieceEncoder(tokens.default_path(), entries=50)


def whole(encoder, text):
    return encoder.tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from([" ", "\n", "a", "word", ".", "'s", "'", "1", "é", "<|endoftext|>", "日", "\t", "́", "  ", "Ωx", "\xa0", "\x1c"]), max_size=12).map("".join), max_size=5))
def test_pieces_encode_as_the_whole(texts):
    e = tokens.encoder(tokens.default_path())
    assert [np.frombuffer(b, e.dtype).tolist() for b in e.encode(texts)] == [whole(e, t) for t in texts]


def test_pieces_encode_as_the_whole_beyond_the_cache(encoder, small):
    texts = [r.text or "" for r in small.collect()]
    for a, b in tokens.in_slices(texts, 30_000):
        assert [np.frombuffer(x, encoder.dtype).tolist() for x in encoder.encode(texts[a:b])] == [whole(encoder, t) for t in texts[a:b]]
    assert len(encoder.known) <= 50


@pytest.mark.parametrize("n", [0, 1, 2, 5, 1000])
def test_perfect_hash(n):
    h = token_store.key_hash(np.arange(n) * 7 - 3, np.zeros(n, dtype=np.int64))
    ph = token_store.PerfectHash.build(h)
    assert sorted(ph.slots(h).tolist()) == list(range(n))


def expected_store(rows, end_id):
    e = tokens.encoder(tokens.default_path())
    out, base = [], 0
    for doc_id, text in sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = whole(e, text or "") + [end_id]
        out.append((doc_id, base, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        base += len(ids)
    return out


def test_token_store(spark, docs, small, nothing):
    for df in (docs, small):
        got = token_store.store_and_read(df, tokens.default_path(), 2).collect()
        rows = [(r.doc_id, r.text) for r in df.collect()]
        assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got), key=lambda r: r[1]) == expected_store(rows, 2)
    assert token_store.store_and_read(nothing, tokens.default_path()).collect() == []


def test_index_finds_only_what_is_stored(spark, small):
    folder = common.new_path(spark, "test")
    manifest = token_store.write_shards(small, folder, tokens.default_path(), 2)
    index = token_store.build_index(manifest, folder)
    assert token_store.locate(spark.createDataFrame([(10**9, 0), (0, 5), (None, 0)], "doc_id long, occurrence long"), index).collect() == []
    assert [r.doc_id for r in token_store.locate(spark.createDataFrame([(7, 0)], "doc_id long, occurrence long"), index).collect()] == [7]


# packing


def test_tournament_tree_is_first_fit():
    rng = random.Random(1)
    tree, plain = packing.TournamentTree(200, 100), [100] * 200
    for _ in range(200):
        size = rng.randint(1, 100)
        at = next(k for k, room in enumerate(plain) if room >= size)
        plain[at] -= size
        assert tree.first_fit(size) == at


@pytest.mark.parametrize("lengths", [[], [1], [2048], [2049, 3], [5000, 1, 1, 700], list(range(1, 3000, 37))])
def test_pack_lengths(lengths):
    pieces = packing.pack_lengths(lengths, 2048)
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for doc, start, n, b, offset in pieces:
        by_doc[doc].append((start, n))
        by_bin[b].append((offset, n))
    for doc, n in enumerate(lengths):
        at = 0
        for start, size in sorted(by_doc[doc]):
            assert start == at and size > 0
            at += size
        assert at == n
    used = []
    for parts in by_bin.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        used.append(at)
    assert all(u <= 2048 for u in used) and sum(u < 2048 for u in used) <= 1


def test_packing(docs, small, nothing):
    for df in (docs, small):
        pieces = packing.pack(df, tokens.default_path(), 1, group_docs=20).toPandas()
        e = tokens.encoder(tokens.default_path())
        want = Counter()
        for r in df.collect():
            want[(r.doc_id, len(whole(e, r.text or "")) + 1)] += 1
        starts = Counter((None if d != d else d, n) for d, n, s in zip(pieces.doc_id, pieces.doc_tokens, pieces.start) if s == 0)
        assert starts == want
        assert pieces.length.sum() == sum(n * k for (_, n), k in want.items())
        used = pieces.groupby("sequence_id").length.sum()
        assert used.max() <= 2048
        for _, g in pieces.sort_values("offset").groupby("sequence_id"):
            assert g.offset.tolist() == np.r_[0, g.length.cumsum()[:-1]].tolist()
    first = pieces[(pieces.doc_id == 0)].sort_values("start")
    ids = np.array(whole(e, small.where("doc_id = 0").first().text) + [1], "<u4")
    assert [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(first.start, first.length)] == first.ids_crc32.tolist()
    assert packing.pack(nothing, tokens.default_path()).collect() == []


# html


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var x = "</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/a">a menu</a></ul></nav><div class="ad">Buy this, now. It is good, really.</div>
<div id="cookie-notice">We use cookies, you know. Accept them, please.</div>
<article><header><h1>Head &amp; line</h1><p class="byline">By someone, today.</p></header><p>One,   two &lt;three&gt;.<br>Four&nbsp;five.<p><b>Six <i>sev</i>en.<p>Eight, nine. Ten.</p>
<ul><li>item a<li>item b</ul><aside>Aside, not this. No, not this.</aside><form><p>Your name, please. Thanks.</p></form>
<section class="comments"><h2>Comments</h2><p>Nice article, really. I liked it, very much so, and more.</p></section></article>
<div class="sidebar"><p>Side, bar. Side, bar text here.</p></div><!-- <p>not a text</p> --><footer>&copy; someone</footer></body></html>"""


def test_packing_groups(spark, monkeypatch):
    """Null ids and one repeated id are dealt out by text; long documents make groups of fewer."""
    rows = [(None, f"text {k}") for k in range(600)] + [(5, f"other {k}") for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    groups = lambda **how: Counter(r.g for r in packing.pack(df, tokens.default_path(), **how).select((F.col("sequence_id") / (1 << 31)).cast("long").alias("g")).collect())
    sizes = groups(group_docs=100)
    assert len(sizes) == 12 and max(sizes.values()) < 200
    monkeypatch.setattr(packing, "GROUP_CHARS", 1000)
    assert len(groups()) >= 9


def test_page():
    assert html_text.main_text(PAGE) == "Head & line\nOne, two <three>. Four five.\nSix seven.\nEight, nine. Ten.\nitem a\nitem b"


@pytest.mark.parametrize(
    "page,expected",
    [
        (None, ""),
        ("", ""),
        ("just words", "just words"),
        ("<p>a < b, and c > d.</p>", "a < b, and c > d."),
        ("<nav>menu</nav>", ""),
        ("<p>x &amp y &am z &unknown; &#65;&#x42;</p>", "x & y &am z &unknown; AB"),
        ("<div><p>one, two.</p><p>three", "one, two.\nthree"),
        ("<p>cut <b", "cut"),
        ("<p>a<script>if (a<b) '</p>'</script>b</p>", "ab"),
        ("<p hidden>x</p><p style='display: none'>y</p><p>z, z.</p>", "z, z."),
        ("<a title=\"x>y\">in, side.</a>", "in, side."),
        ("<table><tr><td>a, b.<td>c, d.</table>", "a, b.\nc, d."),
        ("<p>Éİ <TITLE>no</TITLE>yes.</p>", "Éİ yes."),
    ],
)
def test_html_cases(page, expected):
    assert html_text.main_text(page) == expected


@pytest.mark.parametrize("parts", [(17, 3), (3, 17), (10, 10), (1, 18, 1)])
def test_text_split_over_sibling_divs(parts):
    lines, divs = [], []
    for d, n in enumerate(parts):
        own = [f"Part {d}, line {k}: some words, and some more of them. And the end." for k in range(n)]
        lines += own
        divs.append("<div>" + "".join(f"<p>{x}</p>" for x in own) + "</div>")
    page = "<html><body><nav><a href='/'>Home</a></nav>" + "".join(divs) + "</body></html>"
    assert html_text.main_text(page) == "\n".join(lines)


SENTENCE = "Some words of a sentence, and some more of them. And then the end of it."


@pytest.mark.parametrize("wrap", ["<div>{}</div>", "<article>{}</article>", "<div><div><section>{}</section></div></div>"])
def test_ratios_decide(wrap):
    """Nothing here has a telling name: lists of links go, captions, headings and table cells stay."""
    menu = "<ul>" + "".join(f"<li><a href='/{k}'>Entry {k} of it</a></li>" for k in range(8)) + "</ul>"
    cells = "".join(f"<tr><td>cell {k}</td><td>{k}</td></tr>" for k in range(4))
    body = f"<h2>A heading</h2><p>{SENTENCE}</p>{menu}<p>{SENTENCE}</p><figure><img src='x'><figcaption>A caption</figcaption></figure><table>{cells}</table><p>{SENTENCE}</p><p>{SENTENCE}</p>"
    want = "\n".join(["A heading", SENTENCE, SENTENCE, "A caption", *(x for k in range(4) for x in (f"cell {k}", str(k))), SENTENCE, SENTENCE])
    assert html_text.main_text(f"<html><body>{menu}{wrap.format(body)}{menu}</body></html>") == want


def test_every_path_selected_is_another_text(monkeypatch):
    page = f"<body><nav>Menu of it</nav><div><p>{SENTENCE}</p><ul><li><a href='/'>Link</a></li></ul><p>{SENTENCE}</p></div><div class='sidebar'>{SENTENCE}</div></body>"
    assert html_text.main_text(page) == f"{SENTENCE}\n{SENTENCE}"
    monkeypatch.setattr(html_text, "select", lambda ratio: (set(ratio), set(ratio)))
    assert html_text.main_text(page) == f"Menu of it\n{SENTENCE}\nLink\n{SENTENCE}\n{SENTENCE}"


def test_short_article_beside_long_comments():
    comments = "".join(f"<p>{SENTENCE}</p>" for _ in range(30))
    assert html_text.main_text(f"<body><div><p>Short, but it.</p></div><div class='comments'>{comments}</div><footer>{SENTENCE}</footer></body>") == "Short, but it."


@pytest.mark.parametrize("unit", ["<div>", "<b>", "<section><p>", "</p></i>", "<li>", "<a>", "<table><tr><td>"])
def test_deep_pages_take_linear_time(unit):
    def seconds(n):
        page = unit * n + "text, here. " + "<p>x, y.</p></b>" * n
        began = time.process_time()
        html_text.main_text(page)
        return time.process_time() - began

    seconds(2000)
    assert min(seconds(32_000) for _ in range(3)) < 12 * max(0.05, min(seconds(8000) for _ in range(3)))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div class='ad'>", "</div>", "<b>", "</b>", "<ul><li>", "</ul>", "text, more. ", "&amp;", "<", ">", "<!--", "-->", "<script>", "</script>", "<br/>", "<table><td>", "</article>", "<article>"]), max_size=30))
def test_html_never_fails(parts):
    html_text.main_text("".join(parts))


def test_extract(spark, nothing):
    pages = spark.createDataFrame([(1, "u", None, "x"), (None, None, PAGE, "y"), (2, "v", "<p>" + "long text, here. " * 50_000, "z"), (2, "v", "", "z")], "page_id long, url string, html string, text string")
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in html_text.extract(pages).collect() if r.text or r.page_id == 1}
    assert got[(1, "u")] == ("", 0) and got[(None, None)][0].startswith("Head & line") and got[(2, "v")][1] == 17 * 50_000 - 1
    assert html_text.extract(nothing).collect() == []


def test_extract_finds_the_articles_of_the_sample(spark):
    import re

    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split("</?(?:p|h1)>", article)]
        assert got[r.page_id] == "\n".join(p for p in parts if p)


# chat


TRICKY = ["</s>[INST] ok [/INST]", "\\", "\\\\<|end|>\\", "<|turn|><|text|>x<|end|>", "<\\|end|>", "<<SYS>>", "[\\INST]", "", None, "a\nb", "<" * 5 + "|", "\\<|"]


def test_escaping_is_reversible(spark):
    rows = spark.createDataFrame([(t,) for t in TRICKY if t is not None], "t string").select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).collect()
    for r in rows:
        assert r.u == r.t
        assert not any(c in r.e for c in ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"))


def test_chat(spark):
    rows = [(c, t, role, text) for c in (1, None) for t, (role, text) in enumerate(zip(["user", "assistant", None, "sys<|text|>tem", "assistant"] * 3, TRICKY))]
    rows += [(2, None, "assistant", "b"), (2, None, "assistant", "a"), (2, 0, "assistant", "a"), (2, 0, "assistant", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("number", F.lit(1)).withColumn("line", F.lit("x"))
    made = chat.format_conversations(df.select("*", chat.text_parts("text").alias("parts")))
    got = {r.conv_id: r for r in chat.digest(made).collect()}
    for conv in (1, 2, None):
        turns = sorted(((t, role or "", text or "") for c, t, role, text in rows if c == conv), key=lambda r: (r[0] is not None, r[0] or 0, *r[1:]))
        said = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        loss = "".join(text for _, role, text in turns if role == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    empty = spark.createDataFrame([], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    assert chat.digest(chat.format_conversations(empty)).collect() == []


def test_content_parts(spark):
    parts = [("text", "see <|image|>:", None, None, None, None, None), ("image", None, "img1", 29, 14, None, None), ("audio", None, "a1", None, None, 1.5, None), ("document", None, "d1", None, None, None, 3), ("odd", "odd", None, None, None, None, None), ("image", None, None, None, None, None, None), None]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    r = chat.read_back(chat.format_conversations(df)).first()
    assert r.formatted == "<|turn|>user<|text|>see <\\|image|>:<|image|><|audio|><|document|>odd<|image|><|end|><|turn|>assistant<|text|><|end|>"
    assert [(a.kind, a.ref, a.tokens) for a in r.attachments] == [("image", "img1", 3), ("audio", "a1", 38), ("document", "d1", 768), ("image", None, 0)]
    assert r.expanded_tokens == 809 and r.loss_texts == [""]


def test_chat_is_native_and_matches_sql(spark):
    plan = queries.op3_chat_formatting(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    assert same_as_sql(spark, "op3_chat_formatting")


# mixing


def water(sizes, weights, epochs=3.0):
    """Target of each source, by sharing out again until no cap is exceeded."""
    total, capped = sum(sizes), set()
    while True:
        left = total - sum(epochs * sizes[k] for k in capped)
        w = sum(weights[k] for k in range(len(sizes)) if k not in capped)
        target = [epochs * s if k in capped else (left * weights[k] / w if w else 0) for k, s in enumerate(sizes)]
        over = {k for k in range(len(sizes)) if k not in capped and target[k] > epochs * sizes[k]}
        if not over:
            return target
        capped |= over


@pytest.mark.parametrize("sizes", [[10, 1000, 10, 5], [0, 0], [7], [100, 1, 1, 1, 1, 1, 400]])
def test_water_filling(spark, sizes):
    df = spark.createDataFrame([(f"s{k}", n, float(1 + k % 3)) for k, n in enumerate(sizes)], "source string, source_size long, weight double")
    level = mixing.water_fill(df, 3.0, float(sum(sizes)))
    assert [min(3.0 * n, level * (1 + k % 3)) for k, n in enumerate(sizes)] == pytest.approx(water(sizes, [1 + k % 3 for k in range(len(sizes))]))


def test_mixing(spark, docs, small, nothing):
    for df in (docs, small):
        rows = mixing.mixed(df).collect()
        texts = Counter((r.doc_id, len((r.text or "").encode().split())) for r in df.collect())
        assert Counter((r.doc_id, r.size) for r in rows) == texts
        totals = defaultdict(int)
        for r in df.collect():
            totals[r.source] += len((r.text or "").encode().split())
        order = sorted(totals, key=lambda s: (s is None, s or ""))
        targets = dict(zip(order, water([totals[s] for s in order], [1 + k % 3 for k in range(len(order))])))
        assert sorted({(r.source_size, round(r.target, 6)) for r in rows}) == sorted({(totals[s], round(targets[s], 6)) for s in order})
        assert all(0 <= r.taken <= 3 * r.size for r in rows)
        assert Counter(rows) == Counter(mixing.mixed(df).collect())
    taken = defaultdict(int)
    source = {r.doc_id: r.source for r in small.collect()}
    for r in rows:
        taken[source[r.doc_id]] += r.taken
    for s in order:
        largest = max(r.size for r in rows if source[r.doc_id] == s)
        assert abs(taken[s] - targets[s]) <= largest / 2 + 1
    repeated = mixing.repeated(small)
    assert repeated.columns == small.columns
    assert Counter(r.doc_id for r in repeated.collect()) == Counter({r.doc_id: r.taken // r.size for r in rows if r.size and r.taken})
    assert mixing.mixed(nothing).collect() == [] and mixing.repeated(nothing).collect() == []


def test_mixing_over_several_buckets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_DOCS", 10)
    df = spark.range(1000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").otherwise(F.concat(F.lit("b"), F.col("id") % 7)).alias("source"), F.repeat(F.lit("w "), (1 + F.col("id") % 50).cast("int")).alias("text"))
    source = {r.doc_id: r.source for r in df.collect()}
    sums = defaultdict(lambda: [0, 0.0])
    for r in mixing.mixed(df).collect():
        sums[source[r.doc_id]][0] += r.taken
        sums[source[r.doc_id]][1] = r.target
    assert all(abs(taken - target) <= 26 for taken, target in sums.values())


# language


def test_language(spark, docs, small, nothing):
    network = language_id.fit(small)
    rows = {r.doc_id: r for r in language_id.identify(small, network).collect()}
    held = [(r.lang, rows[r.doc_id]) for r in small.collect() if rows[r.doc_id].held_out]
    assert len(held) > 30 and sum(lang == p.lang_pred for lang, p in held) >= 0.95 * len(held)
    for i, r in rows.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1
    odd = {r.doc_id: r for r in language_id.identify(docs, network).collect()}
    assert all(odd[k].lang_pred == "und" and odd[k].score == 0 for k in (1, 2, 8, -9))
    assert odd[None].held_out is False and odd[7].lang_pred in network.labels
    assert language_id.fit(nothing) is None and language_id.identify(nothing, network).collect() == []
    assert {r.lang_pred for r in language_id.identify(docs, None).collect()} == {"und"}
    again = language_id.fit(small.repartition(3))
    assert all((a == b).all() for a, b in zip(network.filters, again.filters))
    kept = language_id.keep_identified(docs, None)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {3, 4, 5, None, 7}


def test_every_language_is_learned(spark):
    """More languages than a fixed bound would take; the sample stays bounded."""
    alphabet = [chr(0x4E00 + 7 * k) for k in range(300)]
    rows = [(k, f"{a}{a} {a} {a}{a}{a}", f"l{k % 300}") for k, a in enumerate(alphabet * 3)]
    network = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    trained = {lang for k, _, lang in rows if zlib.crc32(str(k).encode()) % 4 != 2}
    assert set(network.labels) == trained and len(trained) > 256
    again = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7))
    assert all((x == y).all() for x, y in zip(network.filters, again.filters))


def test_clean_documents_stay(spark, small):
    """Documents labelled as good and not toxic pass the least score, in each language."""
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").where("quality = 1 and toxic = 0")
    clean = small.join(labels, "doc_id", "left_semi").select("doc_id", "lang").collect()
    kept = {r.doc_id for r in language_id.keep_identified(small, language_id.fit(small)).collect()}
    assert len(clean) > 60 and {r.lang for r in clean} == {"de", "en", "es", "fr"}
    assert {r.doc_id for r in clean} <= kept


def test_network_answers_as_the_plain_convolution():
    network = language_id.train(["the cat and the dog " * 20, "le chat et le chien " * 20], ["en", "fr"])
    reader = language_id.Reader(network)
    text = "the " * 100 + "é"
    raw = text.encode()
    n = -(-(len(raw) + 4) // language_id.WINDOW)
    x = np.frombuffer(raw, np.uint8).tolist() + [0] * (n * language_id.WINDOW + 4 - len(raw))
    total = np.zeros(2)
    for w in range(n):
        pooled = []
        for f in network.filters:
            width = len(f)
            answers = [sum(f[j][x[w * language_id.WINDOW + t + j]] for j in range(width)) for t in range(language_id.WINDOW)]
            pooled.append(np.maximum(0, np.max(answers, axis=0)))
        z = np.concatenate(pooled) @ network.dense + network.bias
        p = np.exp(z - z.max())
        total += p / p.sum() * min(language_id.WINDOW, max(0, len(raw) - w * language_id.WINDOW))
    assert reader.probabilities([text])[0] == pytest.approx(total / len(raw), rel=1e-4)


# I-Match


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def plain_terms(text):
    """Hashes of the distinct terms."""
    return {signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in re.split(r"[\x20\x09-\x0D]+", text.lower()) if w}


def plain_code(terms):
    """The code of a set of term hashes: 0 if there is none."""
    h = 42
    for t in sorted(terms):
        h = xxhash.xxh64_intdigest(struct.pack("<q", t), h)
    return max(1, h & 0xFFFFFFFF) if terms else 0


def plain_codes(text, band):
    kept = plain_terms(text) & band
    if not kept:
        return [max(1, plain_code(plain_terms(text)))] * sum(n for _, n in imatch.RATES)
    return [plain_code({t for t in kept if (t % (1 << 64)) >> (64 - bits) == k}) for bits, n in imatch.RATES for k in range(n)]


def plain_likeness(a, b):
    at, counts = 0, []
    for _, n in imatch.RATES:
        pairs = [(x, y) for x, y in zip(a[at : at + n], b[at : at + n]) if x or y]
        counts.append((len(pairs), sum(x == y for x, y in pairs)))
        at += n
    if any(n >= 2 for n, _ in counts):
        return max(e / n for n, e in counts if n >= 2)
    n = sum(n for n, _ in counts)
    return sum(e for _, e in counts) / n if n else float(a == b)


def plain_imatch(rows):
    """(doc_id, n_chars, edited digest, codes, edited codes, likenesses) of each row, in plain Python."""
    rows = [(i, t or "") for i, t in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, signed(xxhash.xxh64_intdigest(r[1].encode(), 42))), reverse=True)
    df = Counter(h for _, t in rows for h in plain_terms(t))
    low = max(2.0, imatch.LEAST * len(rows))
    band = {h for h, n in df.items() if low <= n <= max(low, imatch.MOST * len(rows))}
    show = lambda codes: "".join(f"{c:08x}" for c in codes)
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        own, changed, following = (plain_codes(t, band) for t in (text, edited, after))
        yield i, len(text), hashlib.sha256(edited.encode()).hexdigest(), show(own), show(changed), plain_likeness(own, changed), plain_likeness(own, following)


@pytest.mark.parametrize("bucket_rows", [2048, 9])
def test_imatch(spark, docs, small, nothing, monkeypatch, bucket_rows):
    monkeypatch.setattr(imatch, "BUCKET_ROWS", bucket_rows)
    for df in (small, docs):
        want = Counter(plain_imatch([(r.doc_id, r.text) for r in df.collect()]))
        got = imatch.fingerprint_and_edit(df).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
        assert Counter(map(tuple, got.collect())) == want
    rows = list(plain_imatch([(r.doc_id, r.text) for r in small.collect()]))
    assert np.mean([r[5] for r in rows]) > 5 * np.mean([r[6] for r in rows])
    assert imatch.fingerprint_and_edit(nothing).collect() == []
    assert imatch.fingerprint_and_edit(docs.where("doc_id = 4")).first().near_next == 1


def test_neighbours_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(imatch, "BUCKET_ROWS", 3)
    monkeypatch.setattr(imatch, "SAMPLED", 2)
    ids = [k * k % 977 for k in range(60)] + [5, 5, None, None, None, 10**12, -(10**12), -9 * 10**18, 9 * 10**18, -(1 << 63), (1 << 63) - 1]
    rows = [(i, f"t{k}") for k, i in enumerate(ids)] + [(7, "same")] * 20 + [(None, "same")] * 20
    df = spark.createDataFrame(rows, "doc_id long, text string")
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, signed(xxhash.xxh64_intdigest(r[1].encode(), 42))), reverse=True)
    want = Counter((a, b[1]) for a, b in zip(order, order[1:] + order[:1]))
    assert Counter(((r.doc_id, r.text), r.next_text) for r in imatch.with_next(df, ["text"]).collect()) == want


def test_buckets_follow_the_rows_and_not_the_ids(spark):
    """One far id beside dense ones: no bucket holds much more than its share."""
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text")).unionByName(spark.createDataFrame([(10**13, "far")], "doc_id long, text string"))
    placed = rows.withColumns(imatch._order("doc_id", "text"))
    sizes = [r["count"] for r in placed.groupBy(imatch._bucket(imatch._bounds(placed, 20_001)).alias("b")).count().collect()]
    assert len(sizes) >= 8 and max(sizes) < 3 * imatch.BUCKET_ROWS


def test_imatch_is_native(spark):
    plan = queries.op7_document_fingerprints(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "MapInArrow" not in plan


# SimHash


def plain_simhash(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(values, near):
    parent = list(range(len(values)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if near(values[i], values[j]):
                parent[root(i)] = root(j)
    return [root(k) for k in range(len(values))]


def check_components(rows, prints):
    values = sorted(set(prints))
    roots = dict(zip(values, plain_components(values, lambda a, b: (a ^ b).bit_count() <= 2)))
    least = {}
    for r, p in zip(rows, prints):
        if r.doc_id is not None:
            least[roots[p]] = min(least.get(roots[p], r.doc_id), r.doc_id)
    for r, p in zip(rows, prints):
        assert int(r.fingerprint, 16) == p and r.component_id == least.get(roots[p])


def shown(df):
    return simhash.near_duplicates(df).select("doc_id", F.lpad(F.lower(F.hex("p0")), 16, "0").alias("fingerprint"), "component_id")


def test_simhash(docs, small, nothing):
    for df in (docs, small):
        texts = defaultdict(list)
        for r in df.collect():
            texts[r.doc_id].append(plain_simhash(r.text))
        rows = shown(df).collect()
        assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in df.collect())
        check_components(rows, [int(r.fingerprint, 16) for r in rows])
        assert all(int(r.fingerprint, 16) in texts[r.doc_id] for r in rows)
    assert shown(nothing).collect() == []


@pytest.mark.parametrize("hot", [64, 2])
def test_links_lose_nothing(spark, monkeypatch, hot):
    """Chains at 0 to 4 differing bits around a few centres, with and without the hot way, for every plan."""
    monkeypatch.setattr(simhash, "HOT", hot)
    rng = random.Random(3)
    values = {0, (1 << 64) - 1}
    for _ in range(12):
        v = rng.getrandbits(64)
        for _ in range(12):
            values.add(v)
            for b in rng.sample(range(64), rng.randint(0, 4)):
                v ^= 1 << b
    signed = [v - (1 << 64) if v >> 63 else v for v in sorted(values)]
    df = spark.createDataFrame([(v, v) for v in signed], "vertex long, p0 long").persist()
    groups = plain_components(signed, lambda a, b: ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2)
    want = {frozenset(v for v, g in zip(signed, groups) if g == x) for x in set(groups)}
    for m in (2, 3, 4):
        monkeypatch.setattr(simhash, "plan", lambda bits, rows, spec, m=m: (simhash.group_bits(bits, m), {2: [1, 0], 3: [0, 0, 0], 4: [0, -1, 0, 0]}[m]))
        found = {r.vertex: r.root for r in simhash.components(simhash.links(df, simhash.QUERY)).collect()}
        got = defaultdict(set)
        for v in signed:
            got[found.get(v, v)].add(v)
        assert {frozenset(s) for s in got.values()} == want
        assert all(root == min(s) for root, s in got.items())


def test_allocation_is_the_cheapest():
    costs = [[0, 5, 50, 90], [0, 1, 2, 80], [0, 9, 10, 11]]
    for total in range(-3, 6):
        best = min((sum(costs[i][t + 1] for i, t in enumerate((a, b, c))) for a in range(-1, 3) for b in range(-1, 3) for c in range(-1, 3) if a + b + c == total), default=math.inf)
        cost, chosen = simhash.allocate(costs, total)
        assert cost == best and (not chosen or sum(chosen) == total)
    groups = simhash.group_bits(np.random.default_rng(1).integers(0, 2, (50, 64)), 5)
    assert sorted(b for g in groups for b in g) == list(range(64)) and {len(g) for g in groups} == {12, 13}


def test_components_of_a_long_chain(spark):
    edges = [(k, k + 1) for k in range(60)] + [(200, 100), (100, 300), (300, 200)]
    found = {r.vertex: r.root for r in simhash.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {**{k: 0 for k in range(61)}, 100: 100, 200: 100, 300: 100}
    assert simhash.components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_near_copies(spark, docs, monkeypatch):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows, expected = [], set()
    for k in range(40):
        text = [word() for _ in range(200)]
        rows.append((10 * k, " ".join(text)))
        expected.add(10 * k)
        for c in range(1, 3):
            near = list(text)
            near[rng.randrange(200)] = word()
            rows.append((10 * k + c, " ".join(near)))
        rows.append((10 * k + 5, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for hot in (64, 3):
        monkeypatch.setattr(simhash, "HOT", hot)
        assert {r.doc_id for r in simhash.one_of_each(df).collect()} == expected
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 3, 5, None, 7, -9])


def exact_near_copies(rows):
    """doc_id and the smallest doc_id of its component at a shingle Jaccard of 0.8, by comparing all pairs."""
    sets = []
    for _, text in rows:
        w = text.lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    roots = plain_components(list(range(len(rows))), lambda i, j: 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])))
    least = {}
    for (doc_id, _), r in zip(rows, roots):
        least[r] = min(least.get(r, doc_id), doc_id)
    return {doc_id: least[r] for (doc_id, _), r in zip(rows, roots)}


def edited(rng, text, n, kind):
    """A copy with n new words: in one run in its place, at its end, or scattered."""
    new = [f"n{rng.getrandbits(40):x}" for _ in range(n)]
    if kind == "appended":
        return text + new
    at = rng.randrange(len(text) - n)
    where = range(at, at + n) if kind == "block" else rng.sample(range(len(text)), n)
    out = list(text)
    for k, w in zip(where, new):
        out[k] = w
    return out


@pytest.mark.parametrize("pairs", [30, 300])
def test_near_copies_by_kind_of_edit(spark, pairs):
    """Pairs at a Jaccard of 0.8 to 0.95 are found and those at 0.6 to 0.79 left alone, for each kind of edit and two sizes."""
    rng = random.Random(pairs)
    rows, seen = [], Counter()
    for kind in ("block", "appended", "scattered"):
        for k in range(pairs):
            text = [f"w{rng.getrandbits(40):x}" for _ in range(300)]
            n = rng.randint(*{"block": (5, 65), "appended": (15, 180), "scattered": (2, 13)}[kind])
            pair = [(len(rows), " ".join(text)), (len(rows) + 1, " ".join(edited(rng, text, n, kind)))]
            rows += pair
            seen[kind, exact_near_copies(pair)[pair[1][0]] == pair[0][0]] += 1
    assert len(seen) == 6 and min(seen.values()) > pairs // 10
    want = {}
    for k in range(0, len(rows), 2):
        want |= exact_near_copies(rows[k : k + 2])
    got = {r.doc_id: r.component_id for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


@pytest.mark.parametrize(("hot", "block"), [(64, 200_000), (3, 800)])
def test_near_copies_are_exact_components(spark, monkeypatch, hot, block):
    """Chains and families around the similarity, with and without the hot way, as all pairs give them."""
    monkeypatch.setattr(simhash, "HOT", hot)
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(11)
    rows = []
    for family in range(12):
        text = [f"w{rng.getrandbits(40):x}" for _ in range(200)]
        for k in range(12):
            rows.append((len(rows), " ".join(text if k == 0 else edited(rng, text, rng.randint(3, 40) if k % 2 else rng.randint(1, 6), "block" if k % 2 else "scattered"))))
        for k in range(4):  # a chain: each near the one before
            text = edited(rng, text, 12, "block")
            rows.append((len(rows), " ".join(text)))
    want = exact_near_copies(rows)
    assert 12 < len(set(want.values())) < len(rows) - 60
    got = {r.doc_id: r.component_id for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_searched_bits_are_simhash():
    """All fingerprints are majorities of bits; pairs of less differing bits than partitions are probed share a value."""
    rng = np.random.default_rng(7)
    for n in (0, 1, 2, 5, 300, 1025):
        hashes = rng.integers(0, 1 << 64, n, dtype=np.uint64)
        assert simhash.many_lanes(hashes, 6).tolist() == simhash.lanes(hashes, 6)
    bits = rng.integers(0, 2, (512, 64 * simhash.LANES), dtype=np.uint8)
    bits[:, [k * simhash.WIDTH + b for k in (3, 50, 386) for b in range(simhash.WIDTH)]] = 1  # values that all share
    packed = lambda rows: [np.packbits(r, bitorder="little").tobytes() for r in rows]
    probed = simhash.near_plan(packed(bits), 100_000)
    assert len(probed) == simhash.PROBED and not {3, 50, 386} & set(probed)
    for row in bits[:20]:
        other = row.copy()
        for k in rng.choice(probed, simhash.PROBED - 1, replace=False):  # one bit in each but one: the worst case
            other[k * simhash.WIDTH + rng.integers(simhash.WIDTH)] ^= 1
        a, b = simhash._values(packed([row, other]))[:, probed]
        assert (a == b).sum() == 1


def test_near_copies_come_through_the_partitions(spark, monkeypatch):
    """The pairs are those that the probed partitions let meet, dense groups in blocks or not; sets of a few shingles too."""
    rng = random.Random(13)
    rows = []
    for _ in range(60):
        text = [f"w{rng.getrandbits(40):x}" for _ in range(300)]
        rows += [(len(rows), " ".join(text)), (len(rows) + 1, " ".join(edited(rng, text, 25, "block")))]
    for n in range(1, 14):
        text = [f"w{rng.getrandbits(40):x}" for _ in range(n)]
        rows += [(len(rows), " ".join(text)), (len(rows) + 1, " ".join([*text, "more"])), (len(rows) + 2, " ".join(["less", *text]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = lambda: {r.doc_id: r.component_id for r in simhash.near_copies(df).collect()}
    want = exact_near_copies(rows)
    monkeypatch.setattr(simhash, "DENSE", 0)
    assert found() == want and all(want[k + 1] == k for k in range(0, 120, 2))
    monkeypatch.setattr(simhash, "near_plan", lambda sample, rows: [0])
    assert sum(v == k - 1 for k, v in found().items() if k < 120 and k % 2) < 30


def test_a_family_below_the_similarity_makes_no_pair_list(spark, monkeypatch):
    """Many texts that are likely but seldom near copies are compared whole; what is written stays in proportion to them."""
    rng = random.Random(17)
    text = [f"w{rng.getrandbits(40):x}" for _ in range(300)]
    rows = [(k, " ".join(edited(rng, text, rng.randint(2, 9), "scattered"))) for k in range(200)]
    want = exact_near_copies(rows)
    assert 20 < len(set(want.values())) < 190
    stored, written = common.stored, Counter()

    def counted(df, name, **options):
        out = stored(df, name, **options)
        written[name] = max(written[name], out.count())
        return out

    monkeypatch.setattr(common, "stored", counted)
    monkeypatch.setattr(simhash, "BLOCK", 20_000)
    assert {r.doc_id: r.component_id for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want
    assert written["near-pairs"] <= 2 * len(rows) and written["near-met-prints"] <= len(rows) and written["near-more"] <= len(rows)


# WARC


def test_records():
    raw = warc.encode_record(5, "http://x/ä b\r\nX: y", b"payload\r\n\r\n", hashlib.sha1(b"payload\r\n\r\n").hexdigest(), None, False)
    headers, block = warc.decode_record(raw)
    assert block == b"payload\r\n\r\n" and headers["warc-type"] == "response" and "x" not in headers
    for bad in (raw[:-1], raw.replace(b"payload\r", b"pAyload\r"), raw.replace(b"WARC/1.1", b"WARC/0.1"), raw.replace(b"Content-Length: 11", b"Content-Length: 12"), raw.replace(b"WARC-Date", b"X-Date"), b""):
        with pytest.raises(ValueError):
            warc.decode_record(bad)
    assert warc.page_of(warc.record_id(None)) is None and warc.page_of(warc.record_id(-3)) == -3


@pytest.mark.parametrize("n", [1, 5, 300])
def test_archives(n):
    out = io.BytesIO()
    writer = warc.ArchiveWriter(out)
    texts = [f"<html>page {k} {'words and words ' * (k % 20)}</html>".encode() for k in range(n)]
    for k, t in enumerate(texts):
        writer.add(warc.encode_record(k, "u", t, hashlib.sha1(t).hexdigest(), None, False))
    writer.end()
    raw = out.getvalue()
    assert len(raw) == writer.size and raw[:4] == b"\x5d\x2a\x4d\x18"
    assert [b for _, b in warc.read_archive(io.BytesIO(raw))] == texts
    for bad in (raw[:-3], raw[4:], raw[:6]):
        with pytest.raises(ValueError):
            list(warc.read_archive(io.BytesIO(bad)))


def test_warc(spark, nothing):
    same, other = "a" * 1500, "b" * 999
    rows = [(k, "u", same) for k in range(40)] + [(None, None, same), (39, "again", same)] + [(k, "u", other) for k in range(100, 103)] + [(200, None, None), (201, "u", ""), (202, "u", "é" * 500), (203, "u", "é" * 500)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"digest": F.lit(1), "last": F.lit(2), "salt": F.lit(3)})
    got = warc.archive_and_read(df).collect()
    want = Counter()
    for page, _, text in rows:
        raw = (text or "").encode()
        last = max((p for p, _, t in rows if (t or "") == (text or "") and p is not None), default=None)
        revisit = len(raw) >= 1000 and page != last
        want[(page, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", last if revisit else None)] += 1
    assert Counter(tuple(r) for r in got) == want
    assert warc.archive_and_read(nothing).collect() == []


def test_hot_payloads(spark, monkeypatch):
    """Payloads of many rows take the broadcast, others the join; null ids and ties too."""
    monkeypatch.setattr(common, "HEAVY_ROWS", 3)
    bodies = ["a" * 2000, "b" * 2000, "c" * 1500, "short"]
    rows = [(k, f"u{k}", bodies[0]) for k in range(30)] + [(100 + k, "v", bodies[1]) for k in range(2)] + [(200, "w", bodies[2]), (300, "x", bodies[3]), (301, "x", bodies[3]), (None, "n", bodies[0]), (None, "n", bodies[0])]
    got = Counter((r.page_id, r.record_type, r.refers_to) for r in warc.archive_and_read(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    want = Counter((k, "revisit", 29) for k in range(29)) + Counter([(29, "response", None), (100, "revisit", 101), (101, "response", None), (200, "response", None), (300, "response", None), (301, "response", None), (None, "revisit", 29), (None, "revisit", 29)])
    assert got == want


def test_ties_of_turns_go_by_text(spark):
    """By the text itself, where its escaped form would come out otherwise; as the SQL has it."""
    rows = [(1, 0, "user", "<|"), (1, 0, "user", "<a"), (1, 0, "user", "<{"), (1, None, "user", "\\"), (1, None, "user", "]")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.format_conversations(df.select("conv_id", "turn", "role", chat.text_parts("text").alias("parts")))
    assert [t.text for t in chat.read_back(made).first().turns] == ["\\", "]", "<a", "<{", "<|"]


def test_warc_matches_sql(spark):
    assert same_as_sql(spark, "op9_warc")


# chroma


def noise(n, seed):
    rng = np.random.default_rng(seed)
    return chroma.render(rng.normal(size=n))


def plain_alignment(a, b):
    """(offset, equal integers, share of differing bits) by comparing all positions."""
    counts = Counter(j - i for i, x in enumerate(a) for j, y in enumerate(b) if x == y)
    if not counts:
        return 0, 0, 1.0
    equal = max(counts.values())
    offset = min(d for d, n in counts.items() if n == equal)
    bits = [int(x ^ b[i + offset]).bit_count() for i, x in enumerate(a) if 0 <= i + offset < len(b)]
    return offset, equal, round(sum(bits) / (32 * len(bits)), 9)


def test_alignment():
    a, b = noise(120, 1), noise(120, 2)
    whole, other = chroma.pack(chroma.frames(a)), chroma.pack(chroma.frames(b))
    shifted = chroma.pack(chroma.frames(a[10 * chroma.HOP :] + np.random.default_rng(3).normal(0, 0.05, len(a) - 10 * chroma.HOP)))
    offset, equal, error = chroma.best_offset(shifted, whole)
    assert offset == 10 and equal > 10 and error < 0.1
    assert chroma.best_offset(whole, whole) == (0, len(whole), 0.0)
    assert chroma.best_offset(whole, other)[1] < chroma.LEAST_EQUAL or chroma.best_offset(whole, other)[2] > chroma.MOST_DIFFERENT
    assert (whole >= 0).all() and whole.max() < 1 << 32


@settings(max_examples=300, deadline=None)
@given(*[st.lists(st.integers(0, 3).flatmap(lambda c: st.integers(1, 4).map(lambda n: [c] * n)), max_size=12).map(lambda x: np.array(sum(x, []), dtype=np.int64))] * 2, st.sampled_from([0, 8]))
def test_alignment_is_that_of_all_positions(a, b, many):
    """With runs, with and without the Fourier transform."""
    before, chroma.MANY_RUNS = chroma.MANY_RUNS, many
    try:
        offset, equal, error = chroma.best_offset(a, b)
    finally:
        chroma.MANY_RUNS = before
    assert (offset, equal, round(error, 9)) == plain_alignment(a.tolist(), b.tolist())


@pytest.mark.parametrize("make", [lambda n: np.zeros(n, dtype=np.int64), lambda n: np.arange(n) % 2, lambda n: np.arange(n) // 3 % 5])
def test_long_repeats_align_quickly(make):
    a = make(60_000)
    began = time.process_time()
    assert chroma.best_offset(a, a)[:2] == (0, 60_000)
    assert time.process_time() - began < 5


@pytest.mark.parametrize("samples", [[], [0.0] * 100, [float("nan")] * 5000])
def test_short_recordings(samples):
    assert len(chroma.pack(chroma.frames(np.array(samples, dtype=float)))) == 0


def test_area_sums_are_those_of_the_frames():
    x = np.abs(np.random.default_rng(1).normal(size=(chroma.WINDOW, 12)))
    kind, c, h, w = chroma.filters()[0]
    a = x[:w, c : c + h].sum()
    b = x[:w].sum() - a
    level = np.searchsorted(chroma.THRESHOLDS, np.log((a + 0.01) / (b + 0.01)))
    assert chroma.pack(x)[0] >> 30 == level ^ (level >> 1)


@pytest.mark.parametrize("hot", [256, 1])
def test_search(spark, monkeypatch, hot):
    monkeypatch.setattr(chroma, "HOT", hot)
    monkeypatch.setattr(chroma, "BLOCK", 3)
    rng = np.random.default_rng(9)
    vectors = {k: rng.normal(size=40).tolist() for k in range(12)}
    vectors[3] = [v + 0.001 for v in vectors[0]]
    vectors[50] = vectors[1]
    rows = [(k, v, "x") for k, v in vectors.items()] + [(60, None, "x"), (None, vectors[0], "x"), (7, vectors[7], "x"), (100, [], "x")]
    df = spark.createDataFrame(rows, "id long, vector array<double>, codes string")
    prints = common.stored(chroma.fingerprints(df, "vector"), "test")
    found = {(r.query_id, r.id): (r.offset, r.equal, round(r.bit_error, 9)) for r in chroma.search(prints).collect()}
    codes = {r.id: r.codes for r in prints.collect()}
    want = {(q, i): plain_alignment(codes[q], codes[i]) for q in codes if q % 50 == 0 for i in codes}
    want = {k: x for k, x in want.items() if x[1] >= chroma.LEAST_EQUAL and x[2] <= chroma.MOST_DIFFERENT}
    assert found == want and (0, 3) in found and (50, 1) in found
    empty = spark.createDataFrame([], "id long, vector array<double>")
    assert chroma.search(common.stored(chroma.fingerprints(empty, "vector"), "test")).collect() == []


def test_versions_are_found_where_they_begin(spark):
    """Every version of a query is found, at the offset that its rule gives; nothing else but the query is."""
    found = {(r.query_id, r.id): r.offset for r in queries.op10_media_columns(spark, "/root/testdata/sf0.01").collect()}
    ids = sorted(r.vec_id for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id").collect())
    asked = [i for i in ids if i % 50 == 0]
    want = {(q, q) for q in asked} | {(q, q + 1) for q in asked if q + 1 in ids}
    assert len({i for q, i in found if (q, i) in want and q != i}) >= 0.9 * len({i for q, i in want if q != i})
    assert all(found[(q, q)] == 0 for q in asked)
    # delayed by 5 notes; noisy; cut by a quarter of 64 notes; seven notes for the first fifth
    begins = {1: 5 * 1378, 2: 0, 3: -16 * 1378, 0: 7 * 1378 - 64 * 1378 // 5}
    for (q, i), offset in found.items():
        if i == q + 1:
            assert abs(offset - begins[(1 + q // 50) % 4] / chroma.HOP) <= 1


# pipeline


def test_pipeline(spark, small):
    import corpus_pipeline

    df = small
    seen = [small]
    for name, stage in corpus_pipeline.STAGES:
        df = common.stored(stage(spark, df, SMALL), f"test-{name}")
        seen.append(df)
    _, language, single, mixed, packed = seen
    assert all(x.columns == small.columns for x in (language, single, mixed))
    texts = [r.text for r in language.collect()]
    assert all(any(map(str.isalpha, t)) for t in texts)
    network = language_id.fit(small)
    answers = language_id.Reader(network).predict([r.text for r in small.collect()])
    assert Counter(texts) == Counter(r.text for r, label, score in zip(small.collect(), *answers) if label != "und" and score >= 0.4)
    groups = exact_near_copies([(r.doc_id, r.text) for r in language.collect()])
    assert sorted(r.doc_id for r in single.collect()) == sorted({*groups.values()}) and len({*groups.values()}) < len(groups)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    names = sorted({r.source for r in single.collect()}, key=lambda x: (x is None, x or ""))
    size, taken = Counter(), Counter()
    for r in single.collect():
        size[r.source] += words(r.text)
    for r in mixed.collect():
        taken[r.source] += words(r.text)
    longest = max(words(r.text) for r in single.collect())
    for n, target in zip(names, water([size[n] for n in names], [1 + k % 3 for k in range(len(names))])):
        assert abs(taken[n] - target) <= longest
    e = tokens.encoder(tokens.default_path())
    assert packed.agg(F.sum("length")).first()[0] == sum(len(whole(e, r.text)) + 1 for r in mixed.collect())
    assert Counter(corpus_pipeline.run(spark, SMALL).select("doc_id", "doc_tokens", "start", "length").collect()).total() == packed.count()


def test_every_query_is_registered():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{k}" for k in range(1, 11)]
