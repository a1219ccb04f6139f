"""Main text of HTML pages by tag-path ratios.

A page is read once into blocks of text, each with its tag path: the names (and classes) of the
elements from the root to the block. Text length outside links, punctuation and number of blocks are
summed per path; their ratios, given back to the blocks, are smoothed along the page, fused (geometric mean),
averaged per path again and multiplied by the path's share of text outside links. Two thresholds on
that, as shares of the page's mean, decide. A path above HIGH is main text wherever it lies. A path above LOW
(headings, captions, short items) is main text within the container of the others: the element that holds
80 % of them, or the article around it where an element or its name marks one; then nothing outside
counts. Paths below LOW, such as lists of links, are never main text.

Elements that hold something else by their kind or name (menus, headers, footers, sidebars, notices, adverts,
comments, hidden elements) make paths of their own, of ratio zero. The text of scripts, styles, buttons and
other controls isn't a block at all.

Defined results: a null or empty html, one without text and one with nothing but such elements give an
empty text; a page whose text is all in links is read as if it weren't; tags that aren't closed, or closed
twice, are tolerated as browsers do; a tag that the page's end cuts off is dropped; rows are independent, so
repeated rows give repeated results; a null page_id or url stays null; an empty table gives an empty result;
other columns are ignored. Time and memory grow with a page's length alone, however deep its elements lie.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from strandframe.llm import common
from strandframe.llm.tokens import in_slices

# The kinds of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes noscript script style textarea title xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul video audio".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that can be an article's container.
ARTICLE_NAME = "(article by name)"
CONTAINERS = frozenset([*"html body main article section div td center".split(), ARTICLE_NAME])
#: Start tag: what it closes if open, and at which elements the search for that stops.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
}
KEEP_P = frozenset("li dt dd option tr td th tbody tfoot thead caption legend summary".split())
#: Elements whose text is no block.
CONTROL = frozenset("head button select option optgroup svg canvas object audio video template label datalist map".split())
#: Elements that never hold main text.
OTHER = frozenset("head nav aside footer form button select option optgroup input textarea dialog menu svg canvas object audio video template label datalist map math script style noscript iframe".split()) - {"math"}
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Words in class names and ids of elements that hold something else.
BOILERPLATE = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising adsense alert alerts banner breadcrumb breadcrumbs byline comment comments commentlist consent cookie cookies "
    "copyright dialog disclaimer discussion disqus feedback footer form gdpr header login masthead menu menus modal nav navbar navigation newsletter notice notices "
    "notification pager pagination paywall popup promo promoted promotion recommended recommendations related replies respond responses rail search share sharing sidebar sidebars signup "
    "skip social sponsor sponsored subscribe subscription tags teaser toolbar topbar widget widgets".split()
)
#: Thresholds of a path's ratio, as shares of the page's mean by characters.
HIGH, LOW = 0.5, 0.002
#: Words that tell that the class names the layout and not the element.
LAYOUT = frozenset("has with without no is not".split())
#: Whole class names and ids of elements that hold the article.
ARTICLE = frozenset("article article-body article-content body content entry entry-content main main-content page-content post post-body post-content story story-body text".split())

_TAG = re.compile(
    r"<(?:!--(?:-?>|.*?(?:--!?>|\Z))|[!?/](?![A-Za-z])[^>]*(?:>|\Z)|![^>]*(?:>|\Z)|(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*)(?:>|\Z))", re.S
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_PUNCTUATION = re.compile(r"[.,;:!?…。，、！？؛،]")


def _names_other(name: str) -> bool:
    words = [w.lower() for w in _NAME.findall(name)]
    return bool(words) and words[0] not in LAYOUT and (words[0] in BOILERPLATE or words[-1] in BOILERPLATE)


def attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(raw):
        out.setdefault(name.lower(), entities.unescape(a or b or c))
    return out


def _kind(tag: str, raw: str, cache: dict) -> tuple[str, bool, bool]:
    """Label in the path, whether the element holds something else than main text, whether its name says that it holds the article."""
    key = (tag, raw)
    if key in cache:
        return cache[key]
    label, other, named = tag, tag in OTHER, False
    if raw and raw.strip(" /"):
        a = attributes(raw)
        names = [n for n in (a.get("class", "") + " " + a.get("id", "")).split()]
        if names:
            label = f"{tag}.{names[0]}"
        if tag not in ("html", "body", "main") and not other:
            named = any(n.lower() in ARTICLE for n in names)
            other = not named and any(map(_names_other, names))
            other = other or a.get("role", "").lower() in ROLES or (tag == "article" and any("comment" in n.lower() for n in names))
        other = other or "hidden" in a or a.get("aria-hidden", "").lower() == "true" or bool(_HIDDEN.search(a.get("style", "")))
    if len(cache) < 10_000:
        cache[key] = label, other, named
    return label, other, named


class Block:
    __slots__ = ("links", "node", "path", "text")

    def __init__(self, node: int, path: int, text: str, links: int):
        self.node, self.path, self.text, self.links = node, path, text, links


class Tree:
    """The block elements of a page by number: parent (-1: none), path, kind. A child has a larger number than its parent."""

    def __init__(self):
        self.parent: list[int] = [-1]
        self.kind: list[str] = [""]
        self.path: list[int] = [0]
        #: Paths whose elements hold something else.
        self.zero: set[int] = set()
        self._paths: dict[tuple[int, str, bool], int] = {}

    def add(self, parent: int, kind: str, label: str, zero: bool) -> int:
        path = self._paths.setdefault((self.path[parent], label, zero), len(self._paths) + 1)
        if zero:
            self.zero.add(path)
        self.parent.append(parent)
        self.kind.append(kind)
        self.path.append(path)
        return len(self.parent) - 1


class _Open:
    """An open element: what holds for the text in it."""

    __slots__ = ("article", "drop", "header", "heading", "link", "node", "other", "tag")

    def __init__(self, tag, node=0, other=False, drop=False, link=False, header=False, heading=False, article=False):
        self.tag, self.node, self.other, self.drop, self.link, self.header, self.heading, self.article = tag, node, other, drop, link, header, heading, article


def blocks(page: str) -> tuple[list[Block], Tree]:
    """The blocks in page order, and the elements that hold them."""
    out: list[Block] = []
    tree = Tree()
    cache: dict = {}
    stack: list[_Open] = [_Open("")]
    opened: dict[str, int] = {}
    text: list[str] = []
    links = 0
    where = 0

    def flush() -> None:
        nonlocal links
        if text:
            joined = " ".join(entities.unescape("".join(text)).split())
            if joined:
                out.append(Block(where, tree.path[where], joined, min(links, len(joined))))
            text.clear()
        links = 0

    def add(raw: str) -> None:
        nonlocal links, where
        top = stack[-1]
        if not raw or top.drop:
            return
        if not text:
            where = top.node
        text.append(raw)
        if top.link:
            links += len(raw.strip())

    def close(upto: int) -> None:
        gone = stack[upto:]
        if any(e.tag in BLOCK for e in gone):
            flush()
        for e in gone:
            opened[e.tag] -= 1
        del stack[upto:]

    at, lowered = 0, None
    while True:
        m = _TAG.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        tag = name.lower()
        if m[1]:  # an end tag
            if opened.get(tag):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        close(k)
                        break
                    if tag not in BLOCK and stack[k].tag in BLOCK:
                        break
            continue
        if tag in RAW:
            lowered = page.lower() if lowered is None else lowered
            if len(lowered) != len(page):  # a few letters change length
                lowered = "".join(c.lower() if c.isascii() else c for c in page)
            end = lowered.find("</" + tag, at)
            if tag in BLOCK:
                flush()
            at = len(page) if end < 0 else end
            continue
        if tag in BLOCK:
            if tag not in KEEP_P and opened.get("p"):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == "p":
                        close(k)
                        break
                    if stack[k].tag in BLOCK:
                        break
            if tag in CLOSES and any(opened.get(t) for t in CLOSES[tag][0]):
                shuts, stops = CLOSES[tag]
                first = None
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in stops:
                        break
                    if stack[k].tag in shuts:
                        first = k
                if first is not None:
                    close(first)
            flush()
        if tag in VOID:
            if tag == "br":
                add(" ")
            continue
        label, other, named = _kind(tag, m[3] or "", cache)
        if (m[3] or "").endswith("/") and tag in ("svg", "path", "use"):
            continue
        top = stack[-1]
        e = _Open(tag, top.node, top.other, top.drop or tag in CONTROL, top.link or tag == "a", top.header, top.heading or tag in HEADINGS, top.article or tag in ("article", "main"))
        if tag == "header" and not top.other:
            if top.article:
                e.header = True  # of the article: its headings stay
            else:
                other = True
        if tag in BLOCK:
            e.other = top.other or other
            kind = ARTICLE_NAME if named and tag in ("div", "section", "td") else tag
            e.node = tree.add(top.node, kind, label, e.other or (e.header and not e.heading))
        else:
            e.drop = e.drop or other
        opened[tag] = opened.get(tag, 0) + 1
        stack.append(e)
    flush()
    return out, tree


def smooth(values: list[float]) -> list[float]:
    """Gaussian over two neighbours on either side."""
    weights = [math.exp(-d * d / 2) for d in range(3)]
    out = []
    for k in range(len(values)):
        total = norm = 0.0
        for d in range(-2, 3):
            if 0 <= k + d < len(values):
                total += weights[abs(d)] * values[k + d]
                norm += weights[abs(d)]
        out.append(total / norm)
    return out


def ratios(found: list[Block], zero: set[int]) -> dict[int, float]:
    """The smoothed, fused ratio of each path, as a share of the page's mean."""
    out = dict.fromkeys((b.path for b in found), 0.0)
    live = [b for b in found if b.path not in zero]
    if not live:
        return out
    outside = [len(b.text) - b.links for b in live]
    if not any(outside):
        outside = [len(b.text) for b in live]
    sums: dict[int, list[float]] = {}
    for b, n in zip(live, outside):
        s = sums.setdefault(b.path, [0.0, 0.0, 0.0, 0.0])
        s[0] += n
        s[1] += len(_PUNCTUATION.findall(b.text))
        s[2] += 1
        s[3] += len(b.text)
    lengths = smooth([sums[b.path][0] / sums[b.path][2] for b in live])
    marks = smooth([(1 + sums[b.path][1]) / sums[b.path][2] for b in live])
    total = chars = 0.0
    for b, x, y in zip(live, lengths, marks):
        own = math.sqrt(x * y) * len(b.text)
        out[b.path] += own
        total += own
        chars += len(b.text)
    mean = total / chars
    return {path: r and r / sums[path][3] * (sums[path][0] / sums[path][3]) / mean for path, r in out.items()}


def select(ratio: dict[int, float]) -> tuple[set[int], set[int]]:
    """The paths above HIGH (the best at least), and those above LOW."""
    best = max(ratio.values(), default=0.0)
    return {p for p, r in ratio.items() if 0 < r >= min(HIGH, best)}, {p for p, r in ratio.items() if r > LOW}


def _within(tree: Tree, node: int) -> list[bool]:
    """Whether each element is that one or lies in it."""
    out = [k == node for k in range(len(tree.parent))]
    for k in range(1, len(out)):
        out[k] = out[k] or out[tree.parent[k]]
    return out


def _container(found: list[Block], tree: Tree, high: set[int]) -> tuple[int, bool]:
    """The element that holds the selected blocks, and whether it is marked as the article."""
    weight = [0] * len(tree.parent)
    for b in found:
        if b.path in high:
            weight[b.node] += len(b.text) - b.links
    if not any(weight):
        return 0, False
    for k in range(len(weight) - 1, 0, -1):
        weight[tree.parent[k]] += weight[k]
    # elements with most of the text lie in one another: the last is the deepest
    node = max((k for k, n in enumerate(weight) if tree.kind[k] in CONTAINERS and n >= 0.8 * weight[0]), default=0)
    around, k = [], node
    while k > 0:
        around.append(k)
        k = tree.parent[k]
    for kind in ("article", ARTICLE_NAME, "main"):
        if marked := [k for k in around if tree.kind[k] == kind]:
            return marked[-1], True
    return node, False


def main_text(page: str | None) -> str:
    """The main text: blocks in page order, one a line."""
    if not page:
        return ""
    found, tree = blocks(page)
    high, low = select(ratios(found, tree.zero))
    node, marked = _container(found, tree, high)
    inside = _within(tree, node)
    return "\n".join(b.text for b in found if (b.path in low if inside[b.node] else not marked and b.path in high))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            htmls = [h or "" for h in batch.column(2).to_pylist()]
            for a, b in in_slices(htmls):
                texts = [main_text(h) for h in htmls[a:b]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = common.plain(pages, {"page_id": "long", "url": "string", "html": "string"})
    return rows.mapInArrow(read, "page_id long, url string, text string, n_chars long")
