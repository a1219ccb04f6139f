"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints are made a document at a time in Arrow batches. Equal fingerprints are one vertex from
then on, so copies cost nothing more. The bits are put into partitions, bits that go together in one
(a bounded sample tells which); a dynamic programme shares the allowed distance out over the
partitions, unequally, from the candidates it expects of each: thresholds that add up to
distance - partitions + 1 can't miss a pair, and -1 means a partition isn't probed at all. Each
fingerprint probes every value within a partition's threshold; what it meets is verified on all bits.

A value that more than HOT fingerprints share isn't joined. Its members take another exact way:
two fingerprints of 64 bits are linked at distance 2 just if some value is within one bit of both. Each
member gives its 65 such values; a value has 65 members at most, and a star over them links all.

Components come from alternating large and small stars, cut by written tables. No pair list of a
group is made, and only a sample of fingerprints (SAMPLE) reaches the driver.

Defined results: null or empty texts, and texts without words, have the fingerprint zero and are
linked like any other; fewer words than a shingle make one shingle of all; rows that share a doc_id
are rows of their own; a component's id is its smallest doc_id, null if all are null; an empty table
gives an empty result; other columns are ignored.

The pipeline's near copies (one_of_each) are another relation: texts whose sets of five-word shingles
have a Jaccard of 0.8 at least, and what such links join. A pair at 0.8 differs in 15 % of all bits, too
many for 64 bits and a distance that can't be missed. So there are LANES fingerprints of a set, cut into
partitions of WIDTH bits; the dynamic programme probes all but the dearest, and pairs that differ in less
bits than partitions are probed can't be missed. Beyond that distance a partition is equal with
(1 - bits that differ)**WIDTH, whatever kind of edit made the difference and however many rows there
are: a pair at 0.8 is missed with 4 in ten million for sets of many shingles, 9 in a million for the worst sizes
(12 and 15), a more similar one less. What meets is checked on 64, then 256 other bits (LIKELY, LIKELIER: another 1 to 4
in a million are lost there), and decided by the two shingle sets.

Each is compared with some leaders of its values first. What likely pairs with leaders join is a family, and
is compared whole, in blocks of shingles. Then values are met whole, but only pairs of different families leave a task. Values with more than HOT members are
compared with a leader, then in blocks of BLOCK shingles. Texts with equal 64 bits, and sets of less than FEW
shingles (their bits are coarse) that are equal but for one shingle of each, which is all that the
similarity allows there, meet by that. Texts without words are copies of each other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.llm import common
from strandframe.llm.token_store import mix
from strandframe.llm.tokens import in_slices

#: Fingerprints that the driver sees, to group bits and estimate candidates.
SAMPLE = 2048
HOT = 64
#: Shingles of either side of a block.
BLOCK = 500_000
#: Near copies: words of a shingle; a Jaccard of SHARED / PARTS.
SHINGLE = 5
SHARED, PARTS = 4, 5
#: 64-bit fingerprints that are checked and that are searched; bits of a partition; partitions probed, and those of them led first.
CHECKED, LANES = 4, 121
WIDTH, PROBED, LED = 20, 384, 32
#: Leaders of a text that are compared with it at once.
LEADERS = 2
#: Differing bits of the first and of all checked fingerprints that a pair may have; a set of less than FEW shingles is few.
LIKELY, LIKELIER = 25, 72
FEW = 10
#: Pairs for each text from which a group of likely pairs is compared in blocks.
DENSE = 1
#: Values are dealt out by at least so many of their leading bits, more for more than DEALT rows.
PREFIX, DEALT = 4, 4_000_000


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of so many words, repeats included; A-Z in lower case, words joined by a space."""
    parts = text.encode().lower().split()
    if not parts:
        return np.empty(0, dtype=np.uint64)
    whole = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(whole, 42)], dtype=np.uint64)
    lengths = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1
    ends = np.cumsum(lengths) - 1
    starts = ends - lengths + 1
    view, h = memoryview(whole), xxhash.xxh64_intdigest
    return np.array([h(view[a:b], 42) for a, b in zip(starts[: len(parts) - words + 1].tolist(), ends[words - 1 :].tolist())], dtype=np.uint64)


def word_hashes(text: str) -> np.ndarray:
    """XXH64 (seed 42) of each distinct word."""
    return np.array([xxhash.xxh64_intdigest(w, 42) for w in set(text.encode().lower().split())], dtype=np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half the hashes."""
    n = len(hashes)
    if n == 0:
        return 0
    count = np.zeros(64, dtype=np.int64)
    for k in range(0, n, 255):  # a byte holds the count of 255
        bits = np.unpackbits(hashes[k : k + 255].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return int(np.packbits(count * 2 > n, bitorder="little").view("<u8")[0])


def lanes(hashes: np.ndarray, count: int) -> list[int]:
    """count fingerprints of 64 bits; the first is over the hashes themselves."""
    return [majority(hashes if k == 0 else mix(hashes, 100 + k)) for k in range(count)]


@dataclass(frozen=True)
class Spec:
    """What to fingerprint and when to link.

    probe: fingerprints of 64 bits that are searched; check: those that are verified (0: the searched
    ones). distance: differing bits that the search can't miss; most: differing bits, of those
    verified, that link.
    """

    shingle: int = 3
    probe: int = 1
    words: bool = False
    check: int = 0
    distance: int = 2
    most: int = 2

    @property
    def probed(self) -> list[str]:
        return [f"p{k}" for k in range(self.probe)]

    @property
    def checked(self) -> list[str]:
        return [f"c{k}" for k in range(self.check)] or self.probed

    @property
    def columns(self) -> list[str]:
        return self.probed + [c for c in self.checked if c not in self.probed]


#: The contract of the query: 3 words, 64 bits, 2 differing bits.
QUERY = Spec()


def fingerprints(docs: DataFrame, spec: Spec = QUERY) -> DataFrame:
    """doc_id and the fingerprints, as signed longs, of each row's whole text."""

    def signed(v: int) -> int:
        return v - (1 << 64) if v >> 63 else v

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in in_slices(texts):
                rows = []
                for text in texts[a:b]:
                    shingles = shingle_hashes(text, spec.shingle) if spec.check or not spec.words else None
                    row = lanes(word_hashes(text) if spec.words else shingles, spec.probe)
                    rows.append([signed(v) for v in row + (lanes(shingles, spec.check) if spec.check else [])])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(c, pa.int64()) for c in zip(*rows))], names=["doc_id", *spec.columns])

    rows = common.plain(docs, {"doc_id": "long", "text": "string"})
    return rows.mapInArrow(make, "doc_id long, " + ", ".join(f"{c} long" for c in spec.columns))


def _bits(rows: np.ndarray) -> np.ndarray:
    """(n, k) signed longs as (n, 64 k) bits."""
    return np.unpackbits(np.ascontiguousarray(rows.astype("<i8")).view(np.uint8).reshape(len(rows), 8 * rows.shape[1]), axis=1, bitorder="little")


def group_bits(bits: np.ndarray, partitions: int) -> list[list[int]]:
    """All bit positions in so many groups of nearly equal size; a group takes the bits that go with it most."""
    total = bits.shape[1]
    x = bits.astype(np.float32) * 2 - 1
    x -= x.mean(axis=0, keepdims=True) if len(x) else 0
    spread = np.sqrt((x**2).sum(axis=0)) + 1e-6
    tie = np.abs((x.T @ x) / spread[:, None] / spread[None, :])
    left, out = set(range(total)), []
    for k in range(partitions):
        size = (total - sum(map(len, out))) // (partitions - k)
        own = [max(left, key=lambda b: (tie[b].sum(), -b))]
        left.discard(own[0])
        near = tie[own[0]].copy()
        while len(own) < size:
            b = max(left, key=lambda b: (near[b], -b))
            own.append(b)
            left.discard(b)
            near += tie[b]
        out.append(sorted(own))
    return out


def expected(bits: np.ndarray, group: list[int], most: int, rows: int) -> tuple[list[float], float]:
    """(for thresholds 0 to most, the share of pairs that are joined as candidates; the share of rows with a hot value).

    Counted over the sample; at least what independent bits would give. Rows whose value more than HOT of
    all rows seem to share aren't joined, so their pairs don't count.
    """
    w = len(group)
    chance = np.cumsum([math.comb(w, t) * 0.5**w for t in range(most + 1)])
    if len(bits) < 2:
        return chance.tolist(), 0.0
    key = bits[:, group].astype(np.int64) @ (np.int64(1) << np.arange(w, dtype=np.int64))
    _, value, times = np.unique(key, return_inverse=True, return_counts=True)
    hot = (times[value] - 1) * (rows / len(bits)) > HOT
    few = min(len(bits), 1024)
    x = bits[:few][~hot[:few]][:, group].astype(np.float32)
    differ = x @ (1 - x).T
    differ = np.rint(differ + differ.T)[np.triu_indices(len(x), 1)]
    pairs = few * (few - 1) / 2
    return [max(float((differ <= t).sum() / pairs), float(c)) for t, c in enumerate(chance)], float(hot.mean())


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds (-1 and up) of the least cost that add up to total. costs[i][t + 1]: cost of threshold t in partition i."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for spent, (cost, chosen) in best.items():
            for t, c in enumerate(row, -1):
                if spent + t not in step or cost + c < step[spent + t][0]:
                    step[spent + t] = (cost + c, [*chosen, t])
        best = step
    return best.get(total, (math.inf, []))


def plan(bits: np.ndarray, rows: int, spec: Spec) -> tuple[list[list[int]], list[int]]:
    """Partitions of the bits and their thresholds, for so many fingerprints of which bits is a sample."""
    total = bits.shape[1]
    best = (math.inf, [], [])
    for m in range(2, min(spec.distance + 2, total // 12) + 1):
        groups = group_bits(bits, m)
        most = min(spec.distance, 3)
        costs = []
        for g in groups:
            share, hot = expected(bits, g, most, rows)
            costs.append([0.0] + [rows * sum(math.comb(len(g), k) for k in range(t + 1)) + rows * rows * share[t] + 65 * hot * rows for t in range(most + 1)])
        cost, chosen = allocate(costs, spec.distance - m + 1)
        if cost < best[0]:
            best = (cost, groups, chosen)
    return best[1], best[2]


def keys(rows: DataFrame, spec: Spec, groups: list[list[int]], thresholds: list[int], probe: bool) -> DataFrame:
    """part, key and the fingerprint, for each value that a row has (or probes) in each partition."""

    def variants(w: int, t: int) -> np.ndarray:
        return np.array([sum(1 << b for b in c) for k in range(t + 1) for c in combinations(range(w), k)], dtype=np.int64)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 4096):
                batch = whole.slice(begin, 4096)
                own = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(len(spec.columns))])
                bits = _bits(own[:, : spec.probe])
                for i, (g, t) in enumerate(zip(groups, thresholds)):
                    if t < 0:
                        continue
                    key = bits[:, g].astype(np.int64) @ (np.int64(1) << np.arange(len(g), dtype=np.int64))
                    flips = variants(len(g), t if probe else 0)
                    many = np.repeat(own, len(flips), axis=0)
                    key = (key[:, None] ^ flips[None, :]).ravel()
                    for a in range(0, len(key), 65536):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(key[a : a + 65536]), i, np.int32)), pa.array(key[a : a + 65536]), *(pa.array(many[a : a + 65536, k]) for k in range(many.shape[1]))],
                            names=["part", "key", *spec.columns],
                        )

    return rows.select(*spec.columns).mapInArrow(make, "part int, key long, " + ", ".join(f"{c} long" for c in spec.columns))


def _star(hot: DataFrame, name: str) -> DataFrame:
    """Links of 64-bit fingerprints at 2 or fewer differing bits, by the values within one bit of each."""
    near = F.array(F.col(name), *[F.col(name).bitwiseXOR(F.lit(1 << b if b < 63 else -(1 << 63)).cast("long")) for b in range(64)])
    shared = hot.select(name).distinct().select(name, F.explode(near).alias("centre")).groupBy("centre").agg(F.min(name).alias("v"), F.collect_set(name).alias("us"))
    return shared.where(F.size("us") > 1).select(F.explode("us").alias("u"), "v").where("u <> v").distinct()


def _differ(spec: Spec, a: str, b: str) -> Column:
    """Differing bits of the verified fingerprints of two aliases."""
    return sum((F.bit_count(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))) for c in spec.checked), F.lit(0))


def links(vertices: DataFrame, spec: Spec) -> DataFrame:
    """u, v: links between vertices (columns vertex and the fingerprints, distinct) that give the same components as all links."""
    rows = vertices.count()
    sample = vertices.orderBy(F.xxhash64("vertex")).limit(SAMPLE).select(*spec.probed).toPandas().to_numpy(dtype=np.int64).reshape(-1, spec.probe)
    groups, thresholds = plan(_bits(sample), rows, spec)
    symmetric = max(thresholds) == 0
    # the vertex's number is a function of the fingerprint, so it needn't travel beside it
    named = _vertex(spec)
    data = keys(vertices, spec, groups, thresholds, False).withColumn("vertex", named)
    probes = data if symmetric else keys(vertices, spec, groups, thresholds, True).withColumn("vertex", named)
    hot = common.stored(data.groupBy("part", "key").agg(F.count("*").alias("n")).where(F.col("n") > HOT), "simhash-hot")
    x = data.join(hot.select("part", "key"), ["part", "key"], "left_anti").select("part", "key", "vertex", *spec.checked).alias("x")
    p = probes.select("part", "key", "vertex", *spec.checked).alias("p")
    met = p.join(x, (F.col("p.part") == F.col("x.part")) & (F.col("p.key") == F.col("x.key")) & (F.col("p.vertex") > F.col("x.vertex") if symmetric else F.col("p.vertex") != F.col("x.vertex")))
    found = met.where(_differ(spec, "x", "p") <= spec.most).select(F.col("p.vertex").alias("u"), F.col("x.vertex").alias("v")).distinct()
    if hot.isEmpty():
        return found
    members = probes.join(hot.select("part", "key"), ["part", "key"], "left_semi")
    return found.unionByName(_star(members, "vertex"))


def _vertex(spec: Spec):
    """A number for a fingerprint: itself if it is one long, else a hash of all its longs."""
    return F.col(spec.columns[0]) if len(spec.columns) == 1 else F.xxhash64(*spec.columns)


def components(edges: DataFrame) -> DataFrame:
    """vertex, root (the smallest vertex) of each vertex that has a link, by alternating large and small stars.

    Each round's table replaces that of the round before; the last one stays, for what is returned.
    """

    def state(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    e = common.stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "links")
    before = state(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = common.join_unique(both.where("v > u"), low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        previous, e = e, common.stored(small, "links")
        common.discard(previous)
        after = state(e)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("vertex"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("vertex"), F.col("v").alias("root")).distinct())


def _component_ids(own: DataFrame, vertices: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """own (stored, with vertex) with component_id, the smallest least of the vertices (vertex, least) that links join."""
    named = vertices.select("vertex", "least").join(components(links), "vertex", "left").withColumn("root", F.coalesce("root", "vertex"))
    named = common.stored(named, name)
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = common.stored(common.join_unique(named.select("vertex", "root"), least, "root").select("vertex", "component_id"), f"{name}-ids")
    return common.join_unique(own, ids, "vertex")


def near_duplicates(docs: DataFrame, spec: Spec = QUERY) -> DataFrame:
    """doc_id, the fingerprints and component_id, for each row."""
    with common.scratch(docs.sparkSession):
        own = common.stored(fingerprints(docs, spec).withColumn("vertex", _vertex(spec)), "simhash", batch=common.WIDE_ROWS)
        vertices = common.stored(own.groupBy("vertex", *[c for c in spec.columns]).agg(F.min("doc_id").alias("least")), "simhash-vertices")
        found = _component_ids(own, vertices, links(vertices, spec), "simhash-roots")
        return common.stored(found.select("doc_id", *spec.columns, "component_id"), "simhash-found", outlives=True)


def shingle_set(text: str) -> np.ndarray:
    """The distinct five-word shingles' hashes, sorted."""
    return np.unique(shingle_hashes(text, SHINGLE))


def _sum(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    """Sums of numbers whose bits lie in planes, the lowest first; both have as many."""
    carry, out = np.uint64(0), []
    for p, q in zip(a, b):
        either = p ^ q
        out.append(either ^ carry)
        carry = (p & q) | (either & carry)
    return [*out, carry]


def many_lanes(hashes: np.ndarray, count: int) -> np.ndarray:
    """The same fingerprints as lanes, by adders on 64 bits at once."""
    zero = np.zeros((1, count), dtype=np.uint64)
    seeds = np.arange(100, 100 + count)[None, :]
    total = [zero]
    for k in range(0, len(hashes), 1024):
        part = hashes[k : k + 1024]
        x = mix(part[:, None], seeds)
        x[:, 0] = part
        planes = [x]
        while (n := len(planes[0])) > 1:
            if n % 2:
                planes = [np.concatenate([p, zero]) for p in planes]
            half = (n + 1) // 2
            planes = _sum([p[:half] for p in planes], [p[half:] for p in planes])
        most = max(len(total), len(planes))
        total = _sum(total + [zero] * (most - len(total)), planes + [zero] * (most - len(planes)))
    over, same = zero, ~zero
    for i in range(len(total) - 1, -1, -1):
        if len(hashes) // 2 >> i & 1:
            same = same & total[i]
        else:
            over, same = over | (same & total[i]), same & ~total[i]
    return over[0]


def similar_sizes(a: str, b: str) -> Column:
    """Sets of these sizes can reach the similarity."""
    return F.least(a, b) * PARTS >= F.greatest(a, b) * SHARED


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, text and vertex, a number for the text."""
    rows = common.plain(docs, {"doc_id": "long", "text": "string"}).withColumn("text", F.coalesce("text", F.lit("")))
    return rows.withColumn("vertex", F.xxhash64("text"))


#: Names of the checked fingerprints; the first one names a vertex of the search.
PRINTS = [f"p{k}" for k in range(CHECKED)]


def _printed(texts: DataFrame) -> DataFrame:
    """doc_id, vertex, size of the shingle set, checked fingerprints, the searched bits, keys of a small set."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.sliced(batches):
            texts = batch.column(2).to_pylist()
            for a, b in in_slices(texts):
                sets = [shingle_set(t) for t in texts[a:b]]
                made = np.stack([many_lanes(s, CHECKED + LANES) for s in sets])
                checked = [pa.array(made[:, k].astype(np.int64)) for k in range(CHECKED)]
                bits = pa.array([row.tobytes() for row in made[:, CHECKED:].astype("<u8")], pa.binary())
                few = pa.array([_less_one(s) if len(s) < FEW else [] for s in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), *checked, bits, few], names=["doc_id", "vertex", "size", *PRINTS, "bits", "few"])

    return texts.select("doc_id", "vertex", "text").mapInArrow(make, "doc_id long, vertex long, size long, " + ", ".join(f"{c} long" for c in PRINTS) + ", bits binary, few array<long>")


def _less_one(shingles: np.ndarray) -> list[int]:
    """A key of the set and of each set without one of its shingles."""
    with np.errstate(over="ignore"):
        each = mix(shingles, 300)
        return np.unique(mix(np.concatenate([[each.sum()], each.sum() - each]), 301)).view(np.int64).tolist()


def _values(bits: list[bytes]) -> np.ndarray:
    """(rows, partitions): the value of each partition of WIDTH bits."""
    each = np.unpackbits(np.frombuffer(b"".join(bits), dtype=np.uint8).reshape(len(bits), 8 * LANES), axis=1, bitorder="little")
    width = 64 * LANES // WIDTH * WIDTH
    padded = np.zeros((len(bits), width // WIDTH, 32), dtype=np.uint8)
    padded[:, :, :WIDTH] = each[:, :width].reshape(len(bits), -1, WIDTH)
    return np.packbits(padded, axis=2, bitorder="little").view("<u4")[:, :, 0]


def near_plan(sample: list[bytes], rows: int) -> list[int]:
    """The partitions that are probed for values that are equal, PROBED of all, by the least cost.

    Thresholds are 0 or -1 (not probed) and add up to distance - partitions + 1, for a distance of PROBED - 1 bits.
    """
    bits = np.unpackbits(np.frombuffer(b"".join(sample), dtype=np.uint8).reshape(len(sample), 8 * LANES), axis=1, bitorder="little")
    total = 64 * LANES // WIDTH
    costs = []
    for i in range(total):
        share, hot = expected(bits, list(range(i * WIDTH, (i + 1) * WIDTH)), 0, rows)
        costs.append([0.0, rows + rows * rows * share[0] + 65 * hot * rows])
    return [i for i, t in enumerate(allocate(costs, PROBED - 1 - total + 1)[1]) if t == 0]


def _meetings(vertices: DataFrame, probed: list[int], rows: int, lead: bool) -> DataFrame:
    """Fingerprints (vertices: p0, size, bits, code) that share a value of a probed partition and are likely near copies.

    lead: u, v and key, each fingerprint, the leader of its value and that one's rank. Otherwise u and v, those of different codes,
    and key and u, the fingerprints of a value that more than HOT rows share.
    """
    hot, likely, split = HOT, LIKELY, PREFIX + max(0, rows // DEALT).bit_length()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 1000):
                batch = whole.slice(begin, 1000)
                n = batch.num_rows
                value = _values(batch.column(2).to_pylist())[:, probed].T.ravel()
                part = np.repeat(np.array(probed, dtype=np.int64), n)
                group = part << split | value >> (WIDTH - split)
                order = np.argsort(group, kind="stable")
                at = order % n
                edges = np.flatnonzero(np.concatenate([[True], np.diff(group[order]) != 0, [True]]))
                name, size = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
                size = np.floor(8 * np.log2(np.maximum(size, 1))).astype(np.uint8)
                coded = np.flatnonzero(batch.column(3).is_valid().to_numpy(zero_copy_only=False)[at])
                code = batch.column(3).fill_null(0).to_numpy(zero_copy_only=False)[at[coded]]
                starts = np.searchsorted(coded, edges)
                place = (coded - edges[np.searchsorted(edges, coded, side="right") - 1]).astype("<u4")
                columns = [pa.array(group[order][edges[:-1]]), *(_cut(x, edges) for x in ((value[order] & ((1 << WIDTH - split) - 1)).astype("<u2"), name[at], size[at])), _cut(place, starts), _cut(code, starts)]
                yield pa.RecordBatch.from_arrays(columns, names=["group", "value", "name", "size", "place", "code"])

    def meet(table: pa.Table) -> pa.RecordBatch:
        get = lambda c, t: np.frombuffer(b"".join(table.column(c).to_pylist()), dtype=t)
        value, name, size, code = get("value", "<u2"), get("name", "<i8"), get("size", np.uint8).astype(np.int16), get("name", "<i8").copy()
        counts = np.array([len(x) // 8 for x in table.column("name").to_pylist()])
        coded = np.array([len(x) // 8 for x in table.column("code").to_pylist()])
        code[get("place", "<u4") + np.repeat(np.cumsum(counts) - counts, coded)] = get("code", "<i8")
        rank = mix(name, 302)
        order = np.lexsort((rank, value))
        value, name, size, code = value[order], name[order], size[order], code[order]
        first = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
        times = np.diff(np.concatenate([first, [len(value)]]))
        run = np.repeat(np.arange(len(first)), times)
        out = [np.empty((0, 2), dtype=np.int64)]

        def near(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            keep = (np.abs(size[i] - size[j]) <= 3) & (name[i] != name[j]) & (np.bitwise_count((name[i] ^ name[j]).view(np.uint64)) <= likely)
            return keep if lead else keep & (code[i] != code[j])

        keys, members = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        if lead:
            i = np.arange(len(value))
            j = first[run]
            keep = near(i, j)
            out.append(np.column_stack([name[i[keep]], name[j[keep]]]))
        else:
            several = np.logical_or.reduceat(code != code[first[run]], first)
            whole = []
            for k in np.flatnonzero((times > hot) & several):
                every = np.arange(first[k], first[k] + times[k])
                codes, of, often = np.unique(code[every], return_inverse=True, return_counts=True)
                rest = every[of != np.argmax(often)]  # each pair of different codes has one of these
                found, count = [], 0
                for i in rest:
                    if count > 4 * len(every):
                        break
                    j = every[near(np.full(len(every), i), every)]
                    count += len(j)
                    found.append(np.column_stack([np.minimum(name[i], name[j]), np.maximum(name[i], name[j])]))
                if count > 4 * len(every):
                    whole.append(every)
                else:
                    out += found
            here = np.concatenate(whole) if whole else np.empty(0, dtype=np.int64)
            keys = mix(table.column("group")[0].as_py() * (1 << 16) + value[here].astype(np.int64), 303).view(np.int64)
            members = name[here]
            alive, lag = np.flatnonzero((several & (times <= hot))[run]), 0
            while len(alive):
                lag += 1
                alive = alive[alive + lag < len(value)]
                alive = alive[run[alive] == run[alive + lag]]
                keep = alive[near(alive, alive + lag)]
                out.append(np.column_stack([np.minimum(name[keep], name[keep + lag]), np.maximum(name[keep], name[keep + lag])]))
        pairs = np.unique(np.concatenate(out), axis=0)
        u = pa.array(np.concatenate([pairs[:, 0], members]))
        v = pa.concat_arrays([pa.array(pairs[:, 1]), pa.nulls(len(members), pa.int64())])
        ranks = pa.array((mix(pairs[:, 1], 302) >> np.uint64(1)).astype(np.int64)) if lead else pa.nulls(len(pairs), pa.int64())
        key = pa.concat_arrays([ranks, pa.array(keys)])
        return pa.RecordBatch.from_arrays([u, v, key], names=["u", "v", "key"])

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by group; the last group of a batch may go on in the next."""
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            group = batch.column(0).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]
            for a, b in zip(edges, edges[1:]):
                if waiting and waiting[0].column(0)[0].as_py() != group[a]:
                    yield meet(pa.Table.from_batches(waiting))
                    waiting = []
                if b > a:
                    waiting.append(batch.slice(a, b - a))
        if waiting:
            yield meet(pa.Table.from_batches(waiting))
        common.release()

    dealt = vertices.select("p0", "size", "bits", "code").mapInArrow(deal, "group long, value binary, name binary, size binary, place binary, code binary")
    return dealt.repartition("group").sortWithinPartitions("group").mapInArrow(groups, "u long, v long, key long").distinct()


def _cut(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    """The bytes of the values between edges, as one binary each."""
    values = np.ascontiguousarray(values)
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer((edges * values.itemsize).astype(np.int32)), pa.py_buffer(values.tobytes())])


def _sets(texts: DataFrame, needed: DataFrame) -> DataFrame:
    """vertex and the shingle set of each needed vertex."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.sliced(batches):
            texts = batch.column(1).to_pylist()
            for a, b in in_slices(texts):
                sets = [shingle_set(t).view(np.int64) for t in texts[a:b]]
                lists = pa.array(sets, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], names=["vertex", "shingles"])

    one = texts.groupBy("vertex").agg(F.any_value("text").alias("text"))  # first: copies are one row before they meet
    return one.join(needed, "vertex", "left_semi").select("vertex", "text").mapInArrow(make, "vertex long, shingles array<long>")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs u, v whose shingle sets reach the similarity. A v of many pairs is dealt out by their u."""
    many = common.stored(pairs.groupBy("v").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("v", F.ceil(F.col("n") / HOT).cast("int").alias("fan")), "near-fans")
    fan = F.coalesce("fan", F.lit(1))
    right = sets.withColumnRenamed("vertex", "v").join(many, "v", "left").select("v", F.explode(F.sequence(F.lit(0), fan - 1)).alias("salt"), F.col("shingles").alias("b"))
    left = common.join_unique(pairs, many, "v", "left").select("u", "v", F.pmod(F.xxhash64("u"), fan).cast("int").alias("salt"))
    left = left.join(sets.select(F.col("vertex").alias("u"), F.col("shingles").alias("a")), "u")
    both = F.size(F.array_intersect("a", "b"))
    return left.join(right, ["v", "salt"]).where(both * (PARTS + SHARED) >= (F.size("a") + F.size("b")) * SHARED).select("u", "v")


def _met_in_blocks(members: DataFrame, sets: DataFrame, known: DataFrame) -> DataFrame:
    """Links between components among the members (key, vertex, size, root, apart: not of the leader's component) of each key.

    known: key and n, its members.
    """

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        name, root_of, sets = pdf.vertex.to_numpy(), pdf.root.tolist(), pdf.shingles.tolist()
        a, b = np.flatnonzero(pdf.asks), np.flatnonzero(~pdf.asks)
        if not len(a) or not len(b):
            return pd.DataFrame({"u": [], "v": []}, dtype="int64")
        parent = {x: x for x in root_of}

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        sizes = np.fromiter((len(sets[j]) for j in b), dtype=np.int64, count=len(b))
        edges = np.concatenate([[0], np.cumsum(sizes)])
        answers, code = np.unique(np.concatenate([sets[j] for j in b]), return_inverse=True)
        code = code.astype(np.int32)
        has = np.zeros(len(answers), dtype=np.int8)
        out = []
        for i in a:
            at = np.searchsorted(answers, sets[i])
            own = at[answers.take(at, mode="clip") == sets[i]] if len(answers) else at[:0]
            has[own] = 1
            shared = np.diff(np.concatenate([[0], np.cumsum(has[code], dtype=np.int64)])[edges])
            has[own] = 0
            for j in np.flatnonzero(shared * (PARTS + SHARED) >= (len(sets[i]) + sizes) * SHARED):
                if (p := root(root_of[i])) != (q := root(root_of[b[j]])):
                    parent[q] = p
                    out.append((int(name[i]), int(name[b[j]])))
        del sets, answers, code
        common.release()
        return pd.DataFrame(out, columns=["u", "v"])

    share = lambda n: F.greatest(F.lit(1), F.ceil(n / BLOCK).cast("int"))
    asking = F.sum(F.when(F.col("apart"), F.col("size")))  # null: none asks
    counts = members.groupBy("key").agg(share(F.sum("size")).alias("blocks"), F.when(asking.isNotNull(), share(asking)).alias("askers"))
    own = common.stored(common.join_unique(members, counts, "key", counts=known), "near-blocks")
    dealt = lambda n: F.pmod(F.xxhash64("vertex"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    ask = own.where("apart").select("key", "vertex", "root", dealt("askers").alias("a"), every("blocks").alias("b"), F.lit(True).alias("asks"))
    answer = own.where("askers is not null").select("key", "vertex", "root", dealt("blocks").alias("b"), every("askers").alias("a"), F.lit(False).alias("asks"))
    both = ask.unionByName(answer).join(sets, "vertex").groupBy("key", "a", "b")
    return both.applyInPandas(meet, "u long, v long").distinct()


def _likely() -> Column:
    """x and y may be near copies by their sizes and checked fingerprints."""
    differ = sum((F.bit_count(F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}"))) for c in PRINTS), F.lit(0))
    return similar_sizes("x.size", "y.size") & ((differ <= LIKELIER) | (F.greatest("x.size", "y.size") < FEW))


def near_links(vertices: DataFrame, texts: DataFrame) -> DataFrame:
    """u, v: links between vertices (vertex, size, fingerprints, bits, few) that give the same components as all candidates that reach the similarity."""
    rows = vertices.count()
    sample = [r.bits for r in vertices.orderBy(F.xxhash64("vertex")).limit(SAMPLE // 4).select("bits").collect()]
    probed = near_plan(sample, rows)
    # first: each with the leader of its equal fingerprint, of its key if its set is small, and with some leaders of its values
    alike = vertices.groupBy("p0").agg(F.min("vertex").alias("leader"), F.count("*").alias("n"), F.min_by(F.struct("size", *PRINTS), "vertex").alias("prints"))
    alike = common.stored(alike, "near-alike")
    every = common.stored(vertices.select("vertex", F.explode("few").alias("key")), "near-few")
    lead = common.stored(every.groupBy("key").agg(F.count("*").alias("n"), F.min("vertex").alias("leader")).where("n > 1"), "near-lead")
    small = common.stored(common.join_unique(every, lead, "key", counts=lead), "near-small")
    of_print = common.join_unique(vertices.select("vertex", "p0"), alike.where("n > 1"), "p0", counts=alike).select(F.col("vertex").alias("u"), F.col("leader").alias("v"))
    led = common.stored(_meetings(vertices.withColumn("code", F.lit(None).cast("long")), probed[:LED], rows, True), "near-meetings")
    named = led.join(alike.select(F.col("p0").alias("u"), F.col("leader").alias("a"), F.col("prints").alias("x")), "u").select("a", "x", "v", "key")
    named = common.join_unique(common.stored(named, "near-led-names"), alike.select(F.col("p0").alias("v"), F.col("leader").alias("b"), F.col("prints").alias("y")), "v")
    named = common.stored(named.where(_likely()).select(F.col("a").alias("u"), F.col("b").alias("v"), "key").distinct(), "near-led-likely")
    highest = named.groupBy("u").agg(F.slice(F.sort_array(F.collect_list(F.struct("key", "v"))), 1, LEADERS).alias("of")).select("u", F.explode("of.v").alias("v"))
    named = named.select("u", "v")
    pairs = of_print.unionByName(small.select(F.col("vertex").alias("u"), F.col("leader").alias("v"))).unionByName(highest)
    pairs = common.stored(pairs.where("u <> v").distinct(), "near-pairs")
    sets = common.stored(_sets(texts, pairs.unionByName(named).select(F.explode(F.array("u", "v")).alias("vertex")).distinct()), "near-sets", batch=common.WIDE_ROWS)
    led = common.stored(_verified(pairs, sets), "near-led")
    # families, what likely pairs with leaders join, linked or not: each is compared whole, so no list of its pairs is made
    families = common.stored(components(named.unionByName(led)).withColumnRenamed("root", "family"), "near-families")
    kin = families.join(vertices.select("vertex", "size"), "vertex").join(components(led), "vertex", "left").withColumn("root", F.coalesce("root", "vertex"))
    kin = common.stored(kin, "near-kin")
    large = kin.groupBy("family", "root").agg(F.count("*").alias("n")).groupBy("family").agg(F.sum("n").alias("n"), F.count("*").alias("roots"), F.max_by("root", F.struct("n", "root")).alias("first"))
    large = common.stored(large.where("roots > 1 and n > 2").select(F.col("family").alias("key"), "n", "first"), "near-large")
    kin = common.join_unique(kin.withColumnRenamed("family", "key"), large, "key", counts=large)
    kin = common.stored(kin.select("key", "vertex", "size", "root", (F.col("root") != F.col("first")).alias("apart")), "near-compared")
    if not kin.isEmpty():
        led = common.stored(led.unionByName(_met_in_blocks(kin, sets, large.select("key", "n"))), "near-led-whole", batch=common.WIDE_ROWS)
    common.discard(sets)
    roots = common.stored(components(led), "near-roots")
    # then: all that share a value, of different families. A fingerprint's code is the family of all its texts
    prints = vertices.select("vertex", "size", *PRINTS)
    rooted = prints.join(roots, "vertex", "left").join(families, "vertex", "left")
    rooted = common.stored(rooted.withColumn("root", F.coalesce("root", "vertex")).withColumn("family", F.coalesce("family", "vertex")), "near-rooted")
    codes = rooted.groupBy("p0").agg(F.min("family").alias("code"), F.max("family").alias("other"))
    linked = rooted.join(families, "vertex", "left_semi").select("p0").distinct()
    codes = common.stored(codes.where("code = other").join(linked, "p0", "left_semi").select("p0", "code"), "near-codes")
    coded = common.join_unique(vertices.select("p0", "size", "bits"), codes, "p0", "left", counts=alike)
    met = common.stored(_meetings(coded, probed, rows, False), "near-met-prints")
    several_texts = alike.where("n > 1")
    other = lambda c: several_texts.select(F.col("p0").alias(c), F.lit(True).alias(f"many_{c}"))
    two = common.stored(met.where("v is not null").join(other("u"), "u", "left").join(other("v"), "v", "left").select("u", "v", F.coalesce("many_u", "many_v").alias("many")), "near-two")
    keyed = two.where("many").select(F.xxhash64("u", "v").alias("key"), F.explode(F.array("u", "v")).alias("p0"))
    keyed = keyed.unionByName(met.where("v is null").select("key", F.col("u").alias("p0"))).unionByName(several_texts.select(F.col("p0").alias("key"), "p0"))
    keyed = common.stored(keyed.distinct(), "near-keyed")
    columns = ["key", "vertex", "size", *PRINTS, "root", "family"]
    members = keyed.join(rooted, "p0").select(*columns).unionByName(small.select("key", "vertex").join(rooted, "vertex").select(*columns))
    members = common.stored(members.distinct(), "near-members")
    # keys whose members aren't all of one component, with the component of their leader
    several = members.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("a"), F.max("root").alias("b"), F.min_by("root", "vertex").alias("first")).where("a <> b").select("key", "n", "first")
    several = common.stored(several, "near-several")
    apart = common.stored(common.join_unique(members, several, "key", counts=several).withColumn("apart", F.col("root") != F.col("first")), "near-apart")
    few = apart.where(F.col("n") <= HOT)
    x, y = few.alias("x"), few.alias("y")
    more = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.vertex") > F.col("y.vertex")) & (F.col("x.family") != F.col("y.family")))
    x, y = rooted.alias("x"), rooted.alias("y")
    single = two.where("many is null").join(x, F.col("u") == F.col("x.p0")).join(y, F.col("v") == F.col("y.p0")).where(F.col("x.family") != F.col("y.family"))
    greater, lesser = F.greatest("x.vertex", "y.vertex").alias("u"), F.least("x.vertex", "y.vertex").alias("v")
    more = more.where(_likely()).select(greater, lesser).unionByName(single.where(_likely()).select(greater, lesser)).distinct()
    tried = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    more = common.stored(more.join(tried, ["u", "v"], "left_anti"), "near-more")
    # pairs that are dense are compared in blocks too
    groups = common.stored(components(more).join(rooted.select("vertex", "size", F.col("root").alias("was")), "vertex"), "near-groups")
    pairs_of = more.join(groups.select(F.col("vertex").alias("u"), "root"), "u").groupBy("root").agg(F.count("*").alias("pairs"))
    dense = groups.groupBy("root").agg(F.count("*").alias("n"), F.min_by("was", "vertex").alias("first")).join(pairs_of, "root").where(F.col("pairs") > DENSE * F.col("n"))
    dense = common.stored(dense.select(F.col("root").alias("key"), "n", "first"), "near-dense")
    held = common.stored(groups.withColumnRenamed("root", "key").join(dense, "key").select("key", "vertex", "size", F.col("was").alias("root"), (F.col("was") != F.col("first")).alias("apart")), "near-held")
    more = common.stored(more.join(held.select(F.col("vertex").alias("u")), "u", "left_anti"), "near-sparse")
    hot = common.stored(apart.where(F.col("n") > HOT).select("key", "vertex", "size", "root", "apart").unionByName(held), "near-hot")
    several = several.select("key", "n").unionByName(dense.select("key", "n")).groupBy("key").agg(F.sum("n").alias("n"))
    needed = more.select(F.explode(F.array("u", "v")).alias("vertex")).unionByName(hot.select("vertex")).distinct()
    sets = common.stored(_sets(texts, needed), "near-more-sets", batch=common.WIDE_ROWS)
    found = led.unionByName(_verified(more, sets))
    if hot.isEmpty():
        return found
    return found.unionByName(common.stored(_met_in_blocks(hot, sets, several), "near-met", batch=common.WIDE_ROWS))


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id and component_id, the smallest doc_id of the near copies, for each row."""
    with common.scratch(docs.sparkSession):
        texts = _texts(docs)
        own = common.stored(_printed(texts), "near-printed", batch=common.WIDE_ROWS)
        vertices = common.stored(own.groupBy("vertex").agg(F.min("doc_id").alias("least"), *[F.any_value(c).alias(c) for c in ("size", *PRINTS, "bits", "few")]), "near-vertices")
        found = _component_ids(own.select("doc_id", "vertex"), vertices, near_links(vertices, texts), "near-named")
        return common.stored(found.select("doc_id", "component_id"), "near-copies", outlives=True)


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of their component; of rows that share that doc_id, one."""
    own = near_copies(docs)
    stays = own.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    ids = stays.groupBy("doc_id").agg(F.count("*").alias("n"))
    kept = docs.join(stays.select(F.col("doc_id").alias("_kept")).distinct(), F.col("doc_id").eqNullSafe(F.col("_kept")), "left_semi")
    return kept if ids.where("n > 1").isEmpty() else kept.dropDuplicates(["doc_id"])
