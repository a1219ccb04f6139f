"""Language identification with a byte convolutional network.

Filters two, three and four bytes wide slide over UTF-8 bytes; the largest answer of each filter in
a window (and zero) goes to a softmax layer. The network is trained here, in numpy, on windows
of labelled documents: about SAMPLE_DOCS of them, equally many of each language and about LEAST_DOCS of each at
least, WINDOWS_PER_DOC windows each, whatever the corpus. Every language with a label can be predicted. It is applied to the whole text: windows of WINDOW positions side
by side, each document padded with zero bytes to a whole number of them. A document's probabilities
are the mean over its windows, by their bytes.

To apply it, the filters' weights are summed beforehand for each pair of bytes, so that a position
costs two table rows instead of nine.

Defined results: a null text, or one without a letter, is ``und`` with score 0; so is every text if
there is nothing to learn from; labels that are null don't train; a null doc_id doesn't train and
isn't held out; an empty table gives an empty result; very long texts are read in slices of windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.llm import common
from strandframe.llm.tokens import in_slices

UNKNOWN = "und"
WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
#: Bounds of what trains the network, for any corpus.
SAMPLE_DOCS = 3000
LEAST_DOCS = 16
WINDOWS_PER_DOC = 3
#: So many languages are broadcast.
BROADCAST_ROWS = 50_000
STEPS = 500
BATCH = 64


@dataclass
class Network:
    labels: list[str]
    filters: list[np.ndarray]  # for each width w: (w, 256, FILTERS)
    dense: np.ndarray
    bias: np.ndarray

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """By the pair of bytes at a position, and by the pair two further on."""
        w2, w3, w4 = self.filters
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, -1)
        near = np.concatenate([pair(w2[0], w2[1]), pair(w3[0], w3[1]), pair(w4[0], w4[1])], axis=1)
        far = np.concatenate([pair(w3[2], np.zeros_like(w3[2])), pair(w4[2], w4[3])], axis=1)
        return np.ascontiguousarray(near, dtype=np.float32), np.ascontiguousarray(far, dtype=np.float32)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: list[str], labels: list[str], seed: int = 5) -> Network | None:
    """A network for the labels; None if there is none. Equal input gives an equal network."""
    names = sorted(set(labels))
    if not names:
        return None
    rng = np.random.default_rng(seed)
    raw = [np.frombuffer(t.encode()[: 4 * WINDOW], dtype=np.uint8) for t in texts]
    y = np.array([names.index(v) for v in labels])
    f = [rng.normal(0, 0.1, (w, 256, FILTERS)) for w in WIDTHS]
    for w in f:
        w[:, 0] = 0
    params = [*f, rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(names))), np.zeros(len(names))]
    m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    columns = np.arange(FILTERS)
    for step in range(1, STEPS + 1):
        pick = rng.integers(0, len(raw), BATCH)
        x = np.zeros((BATCH, WINDOW + max(WIDTHS)), dtype=np.int64)
        for k, i in enumerate(pick):  # a stretch of the text, a quarter of them short
            n = len(raw[i])
            size = min(n, WINDOW if rng.random() > 0.25 else int(rng.integers(4, WINDOW)))
            at = int(rng.integers(0, n - size + 1))
            x[k, :size] = raw[i][at : at + size]
        pooled, where = [], []
        for w, width in zip(params, WIDTHS):
            answer = sum(w[j][x[:, j : j + WINDOW]] for j in range(width))
            at = answer.argmax(axis=1)
            where.append(at)
            pooled.append(np.take_along_axis(answer, at[:, None, :], 1)[:, 0, :])
        h = np.maximum(0, np.concatenate(pooled, axis=1))
        p = softmax(h @ params[3] + params[4])
        p[np.arange(BATCH), y[pick]] -= 1
        p /= BATCH
        back = (p @ params[3].T) * (h > 0)
        grads = []
        for k, (at, width) in enumerate(zip(where, WIDTHS)):
            g = np.zeros_like(params[k])
            own = back[:, k * FILTERS : (k + 1) * FILTERS]
            for j in range(width):
                np.add.at(g[j], (np.take_along_axis(x, at + j, 1), np.broadcast_to(columns, own.shape)), own)
            g[:, 0] = 0
            grads.append(g)
        grads += [h.T @ p, p.sum(axis=0)]
        for k, g in enumerate(grads):
            m1[k] = 0.9 * m1[k] + 0.1 * g
            m2[k] = 0.999 * m2[k] + 0.001 * g * g
            params[k] -= 0.01 * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    return Network(names, [p.astype(np.float32) for p in params[:3]], params[3].astype(np.float32), params[4].astype(np.float32))


class Reader:
    """Applies a network to texts."""

    def __init__(self, network: Network):
        self.network = network
        self.near, self.far = network.tables()

    def probabilities(self, texts: list[str]) -> np.ndarray:
        net, total = self.network, FILTERS * len(WIDTHS)
        raw = [t.encode() for t in texts]
        n = np.array([len(r) for r in raw])
        windows = -(-(n + max(WIDTHS)) // WINDOW)
        first = np.concatenate([[0], np.cumsum(windows)])
        flat = np.zeros(int(first[-1]) * WINDOW + max(WIDTHS), dtype=np.uint8)
        for r, k in zip(raw, first.tolist()):
            flat[k * WINDOW : k * WINDOW + len(r)] = np.frombuffer(r, dtype=np.uint8)
        step = 16
        a, b = np.empty((step * WINDOW, total), np.float32), np.empty((step * WINDOW, total - FILTERS), np.float32)
        pooled = np.empty((int(first[-1]), total), np.float32)
        for k in range(0, len(pooled), step):
            stop = min(len(pooled), k + step)
            size = (stop - k) * WINDOW
            part = flat[k * WINDOW : k * WINDOW + size + 3].astype(np.intp)
            pair = (part[:-1] << 8) | part[1:]
            np.take(self.near, pair[:size], axis=0, out=a[:size], mode="clip")
            np.take(self.far, pair[2 : size + 2], axis=0, out=b[:size], mode="clip")
            a[:size, FILTERS:] += b[:size]
            np.maximum(0, a[:size].reshape(stop - k, WINDOW, total).max(axis=1), out=pooled[k:stop])
        p = softmax(pooled @ net.dense + net.bias)
        begin = np.arange(len(p)) - np.repeat(first[:-1], windows)
        weight = np.clip(np.repeat(n, windows) - begin * WINDOW, 0, WINDOW).astype(np.float64)
        weight[first[:-1]] += n == 0
        total_weight = np.add.reduceat(weight, first[:-1])
        return np.add.reduceat(p * weight[:, None], first[:-1], axis=0) / total_weight[:, None]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        labels, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        known = [k for k, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        if known:
            p = self.probabilities([texts[k] for k in known])
            for k, best, score in zip(known, p.argmax(axis=1), p.max(axis=1)):
                labels[k], scores[k] = self.network.labels[best], float(min(1.0, score))
        return labels, scores


def held_out(doc_id):
    """Whether a document's label may not train: crc32 of the id's text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, seed: int = 5) -> Network | None:
    """Trains on the labelled documents that aren't held out."""
    rows = common.plain(docs, {"doc_id": "long", "text": "string", "lang": "string"})
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & (F.length("text") > 0) & ~held_out(F.col("doc_id")))
    # the one with the least hash comes in, whatever else is drawn
    first = F.min(F.struct(F.xxhash64("doc_id", F.lit(seed)).alias("h"), "doc_id")).alias("first")
    each = common.stored(rows.groupBy("lang").agg(F.count("*").alias("n"), first), "languages")
    languages = each.count()
    if not languages:
        return None
    quota = max(LEAST_DOCS, SAMPLE_DOCS // languages)
    draw = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    size = F.lit(2 * WINDOW)
    stretches = [F.substring("text", 1 + F.pmod(F.xxhash64("doc_id", F.lit(seed + 1 + k)), F.greatest(F.length("text") - size, F.lit(1))).cast("int"), size) for k in range(WINDOWS_PER_DOC)]
    sample = rows.join(F.broadcast(each) if languages <= BROADCAST_ROWS else each, "lang")
    sample = sample.where((draw < F.lit(float(quota)) / F.col("n")) | (F.col("doc_id") == F.col("first.doc_id")))
    got = sorted((r.doc_id, r.lang, tuple(r.texts)) for r in sample.select("doc_id", "lang", F.array(*stretches).alias("texts")).collect())
    return train([t for _, _, texts in got for t in texts], [lang for _, lang, texts in got for _ in texts], seed)


def identify(docs: DataFrame, network: Network | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row's whole text."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(network) if network else None
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in in_slices([t or "" for t in texts]):
                labels, scores = reader.predict(texts[a:b]) if reader else ([UNKNOWN] * (b - a), [0.0] * (b - a))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(labels), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = common.plain(docs, {"doc_id": "long", "text": "string"})
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(apply, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, network: Network | None, least: float = 0.4) -> DataFrame:
    """The rows of docs whose language is recognised: not ``und``, and a score of at least least.

    Without a network only texts without a letter go.
    """
    at = [c.lower() for c in docs.columns].index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(network) if network else None
        for batch in common.sliced(batches):
            texts = batch.column(at).to_pylist()
            stays: list[bool] = []
            for a, b in in_slices([t or "" for t in texts]):
                if reader:
                    stays += [label != UNKNOWN and score >= least for label, score in zip(*reader.predict(texts[a:b]))]
                else:
                    stays += [bool(t) and any(map(str.isalpha, t)) for t in texts[a:b]]
            yield batch.filter(pa.array(stays, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
