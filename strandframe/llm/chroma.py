"""Chroma audio fingerprints and their alignment.

A recording's samples become overlapping spectra, each folded into twelve pitch classes and scaled
to length one. Filters compare sums of rectangles (pitch classes by frames) of the integral image in
each window of WINDOW frames; three thresholds make two bits (a Gray code) of each answer, and sixteen
filters a packed integer per window. Two recordings are aligned by the histogram of offsets at which
they hold equal integers; the bits that differ over the overlap at the best offset decide.

The histogram is made from runs of equal integers: two runs add a trapezoid, so long silences cost as much
as one integer; integers with very many runs in both recordings are correlated by a Fourier transform.

The search joins distinct integers of the queries with those of all recordings. Integers that more than HOT
recordings hold aren't joined: the queries that hold one are compared, in blocks, with the recordings that
hold one, and aligned with those that share an integer, so nothing is lost and no task gathers them.

Defined results: null or too few samples (under WINDOW frames) give no integers and no match; samples
that are null or not finite count as 0; silence gives frames of zeros; ties between offsets go to the
smaller; rows that share an id are one recording (the least by content); a null id is left out; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.llm import common

RATE = 11_025
FRAME = 4096
HOP = FRAME // 3
LOW_HZ, HIGH_HZ = 60.0, 3520.0
CLASSES = 12
WINDOW = 16
FILTERS = 16
#: Logarithms of the ratio of sums at which a filter's two bits change.
THRESHOLDS = (-0.25, 0.0, 0.25)
HOT = 256
#: Equal integers at one offset, and share of differing bits, that make a match.
LEAST_EQUAL, MOST_DIFFERENT = 3, 0.3
BLOCK = 512
#: Recordings that one task fingerprints.
TASK_ROWS = 2000
#: Run pairs of an integer, per integer of the recordings, from which a Fourier transform is cheaper.
MANY_RUNS = 8
#: Tones a worker has made: one for each whole pitch of four octaves.
_NOTES: dict[tuple[int, int], np.ndarray] = {}


def _bins() -> np.ndarray:
    """The pitch class of each spectrum line; -1 outside the range."""
    hz = np.fft.rfftfreq(FRAME, 1 / RATE)
    with np.errstate(divide="ignore"):
        cls = np.rint(12 * np.log2(np.maximum(hz, 1e-9) / 440.0)).astype(np.int64) % CLASSES
    return np.where((hz >= LOW_HZ) & (hz <= HIGH_HZ), cls, -1)


def filters() -> list[tuple[int, int, int, int]]:
    """(kind, first class, classes, frames) by a rule: kinds in turn, sizes that grow, places spread by a stride of five."""
    out = []
    for k in range(FILTERS):
        kind = k % 5
        frames = (4, 8, 12, 16)[(k // 4) % 4]
        classes = (2, 4, 6, 8)[k % 4]
        out.append((kind, (5 * k) % (CLASSES - classes + 1), classes, frames))
    return out


def frames(samples: np.ndarray) -> np.ndarray:
    """(n, 12): one row of pitch-class energies per spectrum."""
    x = np.nan_to_num(np.asarray(samples, dtype=np.float32), posinf=0.0, neginf=0.0)
    n = 1 + (len(x) - FRAME) // HOP if len(x) >= FRAME else 0
    out = np.zeros((n, CLASSES))
    bins = _bins()
    fold = np.zeros((len(bins), CLASSES), dtype=np.float32)
    fold[np.flatnonzero(bins >= 0), bins[bins >= 0]] = 1
    hann = np.hanning(FRAME).astype(np.float32)
    for a in range(0, n, 256):  # long recordings in pieces
        b = min(n, a + 256)
        cut = np.lib.stride_tricks.as_strided(x[a * HOP :], (b - a, FRAME), (x.strides[0] * HOP, x.strides[0]))
        lines = np.fft.rfft(cut * hann, axis=1)
        out[a:b] = (lines.real**2 + lines.imag**2) @ fold
    norm = np.sqrt((out**2).sum(axis=1, keepdims=True))
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 1e-9)


def pack(chroma: np.ndarray) -> np.ndarray:
    """A 32-bit integer for each window of frames."""
    n = len(chroma) - WINDOW + 1
    if n < 1:
        return np.empty(0, dtype=np.int64)
    image = np.zeros((len(chroma) + 1, CLASSES + 1))
    image[1:, 1:] = chroma.cumsum(axis=0).cumsum(axis=1)
    at = np.arange(n)

    def area(t0: int, t1: int, c0: int, c1: int) -> np.ndarray:
        return image[at + t1, c1] - image[at + t0, c1] - image[at + t1, c0] + image[at + t0, c0]

    out = np.zeros(n, dtype=np.int64)
    for kind, c, h, w in filters():
        halves = area(0, w, c, c + h // 2), area(0, w, c + h // 2, c + h)
        if kind == 0:  # the whole against the same time's other classes
            a = area(0, w, c, c + h)
            b = area(0, w, 0, CLASSES) - a
        elif kind == 1:  # low against high classes
            a, b = halves
        elif kind == 2:  # early against late
            a, b = area(0, w // 2, c, c + h), area(w // 2, w, c, c + h)
        elif kind == 3:  # quarters crosswise
            a = area(0, w // 2, c, c + h // 2) + area(w // 2, w, c + h // 2, c + h)
            b = area(0, w // 2, c + h // 2, c + h) + area(w // 2, w, c, c + h // 2)
        else:  # the middle third against the sides
            t = w // 4
            a = area(t, w - t, c, c + h)
            b = area(0, w, c, c + h) - a
        level = np.searchsorted(THRESHOLDS, np.log((a + 0.01) / (b + 0.01)))
        out = (out << 2) | (level ^ (level >> 1))
    return out


def _runs(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code, begin and length of each run of equal codes, by code."""
    begins = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    lengths = np.diff(np.concatenate([begins, [len(codes)]]))
    order = np.argsort(codes[begins], kind="stable")
    return codes[begins][order], begins[order], lengths[order]


def offset_counts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many i have a[i] == b[i + offset], for offsets from 1 - len(a) to len(b) - 1."""
    if not len(a) or not len(b):
        return np.zeros(max(0, len(a) + len(b) - 1), dtype=np.int64)
    total = len(a) + len(b)
    (ca, ba, la), (cb, bb, lb) = _runs(a), _runs(b)
    lo, hi = np.searchsorted(cb, ca, "left"), np.searchsorted(cb, ca, "right")
    codes, times = np.unique(ca, return_counts=True)
    many = codes[times * (hi - lo)[np.searchsorted(ca, codes)] > MANY_RUNS * total]
    counts = np.zeros(total - 1, dtype=np.int64)
    for code in many:
        size = 1 << total.bit_length()
        product = np.fft.rfft((b == code).astype(float), size) * np.fft.rfft((a == code)[::-1].astype(float), size)
        counts += np.rint(np.fft.irfft(product, size)[: total - 1]).astype(np.int64)
    # the others, run by run: the second difference of a trapezoid has four ends
    bend = np.zeros(total + 1, dtype=np.int64)
    keep = np.flatnonzero((hi > lo) & ~np.isin(ca, many))
    for k in range(0, len(keep), 1024):
        part = keep[k : k + 1024]
        n = hi[part] - lo[part]
        x = np.repeat(part, n)
        y = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[x]
        first = bb[y] - ba[x] - la[x] + len(a)
        for at, sign in ((first, 1), (first + la[x], -1), (first + lb[y], -1), (first + la[x] + lb[y], 1)):
            bend += sign * np.bincount(at, minlength=total + 1)
    return counts + bend.cumsum().cumsum()[: total - 1]


def best_offset(a: np.ndarray, b: np.ndarray) -> tuple[int, int, float]:
    """(offset, equal integers there, share of differing bits over the overlap): b[i + offset] against a[i]."""
    counts = offset_counts(a, b)
    if not counts.any():
        return 0, 0, 1.0
    best = int(counts.argmax())
    return best + 1 - len(a), int(counts[best]), differing(a, b, best + 1 - len(a))


def differing(a: np.ndarray, b: np.ndarray, offset: int) -> float:
    i0, i1 = max(0, -offset), min(len(a), len(b) - offset)
    if i1 <= i0:
        return 1.0
    return float(np.bitwise_count(a[i0:i1] ^ b[i0 + offset : i1 + offset]).sum()) / (2 * FILTERS * (i1 - i0))


def _note(pitch: int, samples: int) -> np.ndarray:
    """A tone of that pitch (69: 440 Hz) with a weaker octave."""
    if (pitch, samples) not in _NOTES:
        phase = 2 * np.pi * 440.0 * 2 ** ((pitch - 69) / 12) * np.arange(samples) / RATE
        _NOTES[pitch, samples] = np.sin(phase) + 0.3 * np.sin(2 * phase)
    return _NOTES[pitch, samples]


def render(vector: np.ndarray, note: int = 1378) -> np.ndarray:
    """A recording of a vector: for each value a note whose pitch rises with it, over four octaves."""
    x = np.nan_to_num(np.asarray(vector, dtype=np.float64))
    scale = np.sqrt((x**2).mean()) if len(x) else 0.0
    pitch = np.rint(69 + 12 * np.clip(x / (scale or 1.0), -2, 2)).astype(int)
    return np.concatenate([_note(p, note) for p in pitch.tolist()]) if len(x) else np.empty(0)


def versions(vectors: DataFrame, every: int = 50) -> DataFrame:
    """vectors (id, vector) with base and kind: each id after one divisible by every is a version of that one.

    The kinds, in turn: 1 delayed, 2 noisy, 3 cut, 4 all of it; see version().
    """
    rows = common.plain(vectors, {"id": "long", "vector": "array<double>"})
    base = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("vector").alias("base")).select((F.col("id") + 1).alias("id"), "base")
    return rows.join(base, "id", "left").withColumn("kind", F.when(F.col("base").isNotNull(), 1 + F.pmod(F.floor(F.col("id") / every), F.lit(4))).otherwise(0).cast("int"))


def version(own: np.ndarray, base: np.ndarray, kind: int, seed: int, note: int = 1378) -> np.ndarray:
    """A version of the base recording (kind 0: the own recording)."""
    if kind == 0:
        return own
    noise = np.random.default_rng(abs(seed)).standard_normal
    if kind == 1:  # five notes of its own come first
        return np.concatenate([own[: 5 * note], base])
    if kind == 2:
        return base + 0.1 * noise(len(base))
    if kind == 3:  # without the first quarter and the last eighth
        return base[len(base) // 4 : len(base) - len(base) // 8]
    made = np.concatenate([own[: 7 * note], base[len(base) // 5 :]])
    return made + 0.05 * noise(len(made))


def fingerprints(recordings: DataFrame, source: str = "samples") -> DataFrame:
    """recordings: id and samples (array of numbers); with source 'vector' what versions() returns, which is rendered first. id, codes."""

    def numbers(values) -> np.ndarray:
        return np.array([0.0 if v is None else v for v in values.as_py() or []], dtype=np.float64)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                codes = []
                for id_, values, base, kind in zip(*part.columns):
                    x = numbers(values)
                    if source == "vector":
                        x = version(render(x), render(numbers(base)), kind.as_py() or 0, id_.as_py())
                    codes.append(pack(frames(x)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(codes, pa.list_(pa.int64()))], names=["id", "codes"])

    rows = common.plain(recordings, {"id": "long", source: "array<double>", "base": "array<double>", "kind": "int"}).where("id is not null")
    dealt = rows.repartition(max(1, -(-rows.count() // TASK_ROWS)), "id")
    return dealt.mapInArrow(make, "id long, codes array<long>").groupBy("id").agg(F.min("codes").alias("codes"))


def search(prints: DataFrame, every: int = 50) -> DataFrame:
    """query_id, id, offset, equal, bit_error of each match of a query (id divisible by every) among all recordings."""
    held = common.stored(prints.select("id", F.explode(F.array_distinct("codes")).alias("code")), "chroma-codes")
    asked = held.where(F.col("id") % every == 0).select(F.col("id").alias("query_id"), "code")
    hot = common.stored(held.groupBy("code").agg(F.count("*").alias("n")).where(F.col("n") > HOT), "chroma-hot")
    pairs = asked.join(held.join(hot.select("code"), "code", "left_anti"), "code").select("query_id", "id").distinct()
    codes = prints.select("id", "codes")
    both = pairs.join(codes, "id").join(codes.select(F.col("id").alias("query_id"), F.col("codes").alias("query_codes")), "query_id")
    schema = "query_id long, id long, offset long, equal long, bit_error double"

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [best_offset(np.array(a), np.array(b)) for a, b in zip(pdf.query_codes, pdf.codes)]
            out = pd.DataFrame(found, columns=["offset", "equal", "bit_error"])
            out.insert(0, "id", pdf.id.to_numpy())
            out.insert(0, "query_id", pdf.query_id.to_numpy())
            yield out[(out.equal >= LEAST_EQUAL) & (out.bit_error <= MOST_DIFFERENT)]

    cold = both.select("query_id", "id", "codes", "query_codes").mapInPandas(align, schema)
    if hot.isEmpty():
        return cold
    # recordings and queries that hold a hot integer, block against block; a block of either is bounded
    owners = held.join(hot.select("code"), "code", "left_semi").select("id").distinct().join(codes, "id")
    n = owners.count()
    blocks = max(1, -(-n // BLOCK))
    block = F.pmod(F.xxhash64("id"), F.lit(blocks))
    queries = owners.where(F.col("id") % every == 0)
    query_blocks = max(1, -(-queries.count() // BLOCK))
    left = queries.select(F.col("id").alias("query_id"), F.col("codes").alias("query_codes"), F.pmod(F.xxhash64("id"), F.lit(query_blocks)).alias("qb"))
    left = left.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("qb", F.col("b").cast("long").alias("b"), "query_id", "query_codes")
    right = owners.select(block.alias("b"), "id", "codes").withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))).select(F.col("qb").cast("long").alias("qb"), "b", "id", "codes")

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        ids, others = b.id.tolist(), [np.array(c) for c in b.codes]
        distinct = [np.unique(c) for c in others]
        owner = np.repeat(np.arange(len(others)), [len(c) for c in distinct])
        every_code = np.concatenate([*distinct, np.empty(0, dtype=np.int64)])
        for q, qc in zip(a.query_id, map(np.array, a.query_codes)):
            for k in np.unique(owner[np.isin(every_code, qc)]).tolist():  # those that share an integer
                offset, equal, error = best_offset(qc, others[k])
                if equal >= LEAST_EQUAL and error <= MOST_DIFFERENT:
                    out.append((q, ids[k], offset, equal, error))
        return pd.DataFrame(out, columns=["query_id", "id", "offset", "equal", "bit_error"])

    warm = left.groupBy("qb", "b").cogroup(right.groupBy("qb", "b")).applyInPandas(meet, schema)
    return cold.unionByName(warm).distinct()
