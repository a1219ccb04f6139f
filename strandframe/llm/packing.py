"""Packing token sequences: first-fit decreasing over a tournament tree, in randomised groups.

Documents are dealt to groups of about GROUP_DOCS documents and GROUP_CHARS characters at most by a seeded
hash of id and text; groups are packed apart from each other. Within a group each document is cut into full sequences and a remainder. The remainders,
longest first, go to the first bin with room for them; a tournament tree over the bins' free room
finds it in a logarithmic number of steps. At last the emptiest bins are taken apart: their
pieces are cut to fill the room left in the fullest ones, so a group pads one sequence at most.

Defined results: a null or empty text holds the end id alone; rows that share a doc_id are packed as
documents of their own; equal lengths keep the order of doc_id (null first), then of content; an
empty table gives no pieces; other columns are ignored. A document of any length is cut.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.llm import common, tokens

GROUP_DOCS, GROUP_CHARS = 4096, 16_000_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class TournamentTree:
    """Free room of bins 0, 1, ...; each inner node holds the largest room below it."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.room = [capacity] * (2 * self.leaves)

    def first_fit(self, size: int) -> int:
        """Puts size into the first bin with room for it; that bin."""
        room, at = self.room, 1
        while at < self.leaves:
            at *= 2
            if room[at] < size:
                at += 1
        room[at] -= size
        bin_ = at - self.leaves
        while at > 1:
            at //= 2
            best = room[2 * at] if room[2 * at] >= room[2 * at + 1] else room[2 * at + 1]
            if room[at] == best:
                break
            room[at] = best
        return bin_


def pack_lengths(lengths: list[int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, bin, offset) of each piece. lengths: tokens of each document, in the order for ties."""
    pieces, rest, bins = [], [], 0
    for doc, n in enumerate(lengths):
        full, left = divmod(n, capacity)
        for k in range(full):
            pieces.append((doc, k * capacity, capacity, bins, 0))
            bins += 1
        if left:
            rest.append((-left, doc, full * capacity))
    rest.sort()
    tree = TournamentTree(max(1, len(rest)), capacity)
    content: list[list[tuple[int, int, int]]] = []
    for size, doc, start in rest:
        b = tree.first_fit(-size)
        while len(content) <= b:
            content.append([])
        content[b].append((doc, start, -size))
    used = [sum(p[2] for p in c) for c in content]
    order = sorted((b for b in range(len(content)) if used[b] < capacity), key=lambda b: (used[b], b))
    low, high = 0, len(order) - 1
    while low < high:
        giver, taker = content[order[low]], content[order[high]]
        doc, start, n = giver.pop()
        take = min(n, capacity - used[order[high]])
        taker.append((doc, start, take))
        used[order[high]] += take
        used[order[low]] -= take
        if take < n:
            giver.append((doc, start + take, n - take))
        if used[order[high]] == capacity:
            high -= 1
        if not giver:
            low += 1
    for c in content:
        if c:
            offset = 0
            for doc, start, n in c:
                pieces.append((doc, start, n, bins, offset))
                offset += n
            bins += 1
    return pieces


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 2048, seed: int = 17, group_docs: int = GROUP_DOCS, cache_entries: int = tokens.CACHE_ENTRIES, slice_chars: int = tokens.SLICE_CHARS) -> DataFrame:
    """The pieces of all documents: SCHEMA. sequence_id is the group's number times 2**31 plus the bin. cache_entries: pieces of text whose ids a worker remembers; slice_chars: characters it encodes at once."""
    rows = common.plain(docs, {"doc_id": "long", "text": "string"})
    count, chars = rows.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    groups = max(1, -(-count // group_docs), -(-chars // GROUP_CHARS))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(tokenizer, cache_entries)
        end = np.array([end_id], dtype=encoder.dtype).tobytes()
        for batch in common.sliced(batches, max(1, slice_chars // 1000)):
            texts = [t or "" for t in batch.column(2).to_pylist()]
            for a, b in tokens.in_slices(texts, slice_chars):
                ids = pa.array([raw + end for raw in encoder.encode(texts[a:b])], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), ids, pa.array([encoder.dtype.itemsize] * (b - a), pa.int32())], names=["grp", "doc_id", "ids", "itemsize"])

    def pack_group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "ids"], na_position="first", ignore_index=True)
        group, itemsize = int(pdf.grp.iloc[0]), int(pdf.itemsize.iloc[0])
        ids = [np.frombuffer(x, f"<u{itemsize}") for x in pdf.ids]
        p = pd.DataFrame(pack_lengths([len(x) for x in ids], capacity), columns=["doc", "start", "length", "bin", "offset"])
        return pd.DataFrame(
            {
                "doc_id": pdf.doc_id.astype("Int64").to_numpy()[p.doc] if pdf.doc_id.isna().any() else pdf.doc_id.to_numpy()[p.doc],
                "start": p.start,
                "length": p.length,
                "ids_crc32": [zlib.crc32(ids[d][s : s + n].astype("<u4").tobytes()) for d, s, n in zip(p.doc, p.start, p.length)],
                "doc_tokens": [len(ids[d]) for d in p.doc],
                "sequence_id": group * (1 << 31) + p.bin,
                "offset": p.offset,
            }
        )

    dealt = rows.select(F.pmod(F.xxhash64("doc_id", "text", F.lit(seed)), F.lit(groups)).cast("long").alias("grp"), "doc_id", "text")
    encoded = dealt.mapInArrow(encode, "grp long, doc_id long, ids binary, itemsize int")
    return encoded.groupBy("grp").applyInPandas(pack_group, SCHEMA)
