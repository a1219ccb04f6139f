"""Token-id shards and a minimal perfect hash index over them.

Shard file: 16 bytes of header (``TIDS``, version, bytes per id, reserved; little-endian 32-bit
integers), then the raw ids of its documents, one after another. Documents lie in ascending doc_id
order within a shard and from shard to shard.

Index file, one per bucket of keys: header (``TMPH``, version, number of keys, number of groups),
a displacement per group, then a slot per key: fingerprint (32 bits), shard (32 bits), offset and
length (64 bits each, in ids). A key is (doc_id, occurrence): hash -> bucket file -> group ->
displacement -> slot. A slot whose fingerprint differs means the key isn't stored. That is a
constant number of steps for any number of documents.

Both kinds of file get a name of their own per attempt, and only names in the committed manifest are
read, so a task that runs again after a lost executor leaves at most an unread file behind.

Defined results: a null text is empty; an empty text holds the end id alone; rows that share a
doc_id are stored in text order as occurrences 0, 1, ...; a null doc_id is a key of its own and comes
first; an empty table gives no shard and an empty result; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.llm import common, tokens

#: Keys in an index bucket, about.
KEYS_PER_BUCKET = 16_384
#: Keys in a displacement group, about.
KEYS_PER_GROUP = 4
_NULL_KEY = -(1 << 63)
_HEADER = "<4sIII"
_HEADER_BYTES = 16
_SLOT = np.dtype([("fingerprint", "<u4"), ("shard", "<u4"), ("offset", "<u8"), ("length", "<u8")])


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit mixer: multiply and shift, twice."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64(seed * 2 + 1) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def key_hash(doc_id: np.ndarray, occurrence: np.ndarray) -> np.ndarray:
    return mix(mix(np.asarray(doc_id, dtype=np.int64).view(np.uint64), 1) ^ np.asarray(occurrence, dtype=np.uint64), 2)


def _ids(column: pd.Series) -> np.ndarray:
    return column.astype("Int64").fillna(_NULL_KEY).to_numpy(dtype=np.int64)


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit hashes, by displacement per group.

    Groups are placed largest first; a group's displacement is the first that puts all its keys on
    free slots. A group of one key states its slot (as -1 - slot), so the last ones need no search.
    """

    def __init__(self, n: int, displacement: np.ndarray):
        self.n, self.displacement = n, displacement

    @staticmethod
    def _candidates(h: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
        a, b = mix(h, 3) % np.uint64(n), mix(h, 4) % np.uint64(n)
        return (a[None, :] + d[:, None].astype(np.uint64) * b[None, :] + d[:, None].astype(np.uint64) // np.uint64(n)) % np.uint64(n)

    @classmethod
    def build(cls, hashes: np.ndarray) -> PerfectHash:
        n = len(hashes)
        groups = max(1, -(-n // KEYS_PER_GROUP))
        displacement = np.zeros(groups, dtype=np.int64)
        if not n:
            return cls(0, displacement)
        group = (mix(hashes, 5) % np.uint64(groups)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        begins = np.searchsorted(group[order], np.arange(groups + 1))
        sizes = np.diff(begins)
        free = np.ones(n, dtype=bool)
        for g in np.argsort(-sizes, kind="stable"):
            size = sizes[g]
            if size < 2:
                break
            own = hashes[order[begins[g] : begins[g + 1]]]
            at, step = 0, 16
            while True:
                slots = cls._candidates(own, np.arange(at, at + step), n)
                good = free[slots].all(axis=1)
                for row in np.flatnonzero(good):
                    if len(np.unique(slots[row])) == size:
                        break
                else:
                    at, step = at + step, min(4096, step * 2)
                    continue
                break
            displacement[g] = at + row
            free[slots[row]] = False
        single = np.flatnonzero(sizes == 1)
        displacement[single] = -1 - np.flatnonzero(free)[: len(single)]
        return cls(n, displacement)

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        d = self.displacement[(mix(hashes, 5) % np.uint64(len(self.displacement))).astype(np.int64)]
        u = np.maximum(d, 0).astype(np.uint64)
        n = np.uint64(max(1, self.n))
        placed = (mix(hashes, 3) % n + u * (mix(hashes, 4) % n) + u // n) % n
        return np.where(d < 0, -1 - d, placed.astype(np.int64))


ENTRY = "shard int, file string, doc_id long, occurrence long, offset long, length long"


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int) -> DataFrame:
    """Writes the shards; the manifest, a row per document: ENTRY. Its rows are committed Parquet."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = tokens.encoder(tokenizer)
        end = np.array([end_id], dtype=encoder.dtype).tobytes()
        shard = TaskContext.get().partitionId()
        file = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}.tids"
        out, at, last, times = None, 0, object(), 0
        try:
            for batch in common.sliced(batches, 4 * common.WIDE_ROWS):
                ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
                for a, b in tokens.in_slices(texts, tokens.SLICE_CHARS):
                    rows = []
                    for doc_id, raw in zip(ids[a:b], encoder.encode(texts[a:b])):
                        if out is None:
                            fs, path = common.filesystem(file)
                            fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
                            out = fs.open_output_stream(path)
                            out.write(struct.pack(_HEADER, b"TIDS", 1, encoder.dtype.itemsize, 0))
                        times = times + 1 if doc_id == last else 0
                        last = doc_id
                        n = len(raw) // encoder.dtype.itemsize + 1
                        out.write(raw + end)
                        rows.append((doc_id, times, at, n))
                        at += n
                    c = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([shard] * len(rows), pa.int32()), pa.array([file] * len(rows)), *(pa.array(x, pa.int64()) for x in c)],
                        names=["shard", "file", "doc_id", "occurrence", "offset", "length"],
                    )
        finally:
            if out is not None:
                out.close()

    rows = common.plain(docs, {"doc_id": "long", "text": "string"})
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return common.stored(ordered.mapInArrow(write, ENTRY), "token-manifest")


def shard_table(manifest: DataFrame) -> list[tuple[int, str, int]]:
    """(shard, file, ids before it) of each shard: a row for each writing task, whatever the documents."""
    out, base = [], 0
    for r in sorted(manifest.groupBy("shard", "file").agg(F.sum("length").alias("n")).collect()):
        out.append((r.shard, r.file, base))
        base += r.n
    return out


def build_index(manifest: DataFrame, folder: str) -> tuple[int, DataFrame]:
    """Writes the index; (number of buckets, DataFrame of bucket and file)."""
    buckets = max(1, -(-manifest.count() // KEYS_PER_BUCKET))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        h = key_hash(_ids(pdf.doc_id), pdf.occurrence.to_numpy())
        ph = PerfectHash.build(h)
        slots = np.zeros(len(h), dtype=_SLOT)
        at = ph.slots(h)
        slots["fingerprint"][at] = (mix(h, 6) >> np.uint64(32)).astype(np.uint32)
        for name in ("shard", "offset", "length"):
            slots[name][at] = pdf[name].to_numpy()
        bucket = int(pdf.bucket.iloc[0])
        file = f"{folder}/index-{bucket:08d}-{uuid.uuid4().hex}.tmph"
        fs, path = common.filesystem(file)
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with fs.open_output_stream(path) as f:
            f.write(struct.pack(_HEADER, b"TMPH", 1, ph.n, len(ph.displacement)))
            f.write(ph.displacement.astype("<i8").tobytes())
            f.write(slots.tobytes())
        return pd.DataFrame({"bucket": [bucket], "index_file": [file]})

    keyed = with_bucket(manifest.select("doc_id", "occurrence", "shard", "offset", "length"), buckets)
    return buckets, common.stored(keyed.groupBy("bucket").applyInPandas(build, "bucket long, index_file string"), "token-index")


def with_bucket(keys: DataFrame, buckets: int) -> DataFrame:
    h = F.xxhash64(F.coalesce("doc_id", F.lit(_NULL_KEY)), F.col("occurrence").cast("long"))
    return keys.withColumn("bucket", F.pmod(h, F.lit(buckets)).cast("long"))


def read_index(file: str) -> tuple[PerfectHash, np.ndarray]:
    fs, path = common.filesystem(file)
    with fs.open_input_file(path) as f:
        raw = f.read()
    magic, version, n, groups = struct.unpack_from(_HEADER, raw)
    if magic != b"TMPH" or version != 1 or len(raw) != _HEADER_BYTES + 8 * groups + n * _SLOT.itemsize:
        raise ValueError(f"not an index file: {file}")
    return PerfectHash(n, np.frombuffer(raw, "<i8", groups, _HEADER_BYTES)), np.frombuffer(raw, _SLOT, n, _HEADER_BYTES + 8 * groups)


def find(ph: PerfectHash, slots: np.ndarray, doc_id: np.ndarray, occurrence: np.ndarray) -> np.ndarray:
    """The slot number of each key; -1 if its fingerprint isn't stored there."""
    if not ph.n:
        return np.full(len(doc_id), -1)
    h = key_hash(doc_id, occurrence)
    at = ph.slots(h)
    return np.where(slots["fingerprint"][at] == (mix(h, 6) >> np.uint64(32)).astype(np.uint32), at, -1)


def locate(keys: DataFrame, index: tuple[int, DataFrame]) -> DataFrame:
    """doc_id, occurrence, shard, offset, length of the keys (doc_id, occurrence) that are stored."""
    buckets, files = index

    def look(pdf: pd.DataFrame) -> pd.DataFrame:
        ph, slots = read_index(pdf.index_file.iloc[0])
        at = find(ph, slots, _ids(pdf.doc_id), pdf.occurrence.to_numpy())
        pdf, at = pdf[at >= 0], at[at >= 0]
        return pd.DataFrame({"doc_id": pdf.doc_id.astype("Int64"), "occurrence": pdf.occurrence, **{c: slots[c][at].astype(np.int64) for c in ("shard", "offset", "length")}})

    asked = with_bucket(keys.select("doc_id", F.col("occurrence").cast("long").alias("occurrence")), buckets).join(files, "bucket")
    return asked.groupBy("bucket").applyInPandas(look, "doc_id long, occurrence long, shard int, offset long, length long")


def read_ids(file, itemsize: int, offset: int, length: int) -> np.ndarray:
    raw = file.read_at(length * itemsize, _HEADER_BYTES + offset * itemsize)
    if len(raw) != length * itemsize:
        raise ValueError("the shard is shorter than its index says")
    return np.frombuffer(raw, f"<u{itemsize}")


def read_back(located: DataFrame, shards: list[tuple[int, str, int]]) -> DataFrame:
    """Reads each located document's ids: doc_id, occurrence, start, n_tokens, ids_crc32. A group is one shard's documents."""
    known = {s: (file, base) for s, file, base in shards}

    def read(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("offset")
        name, base = known[int(pdf["shard"].iloc[0])]
        fs, path = common.filesystem(name)
        with fs.open_input_file(path) as f:
            magic, version, itemsize, _ = struct.unpack(_HEADER, f.read_at(_HEADER_BYTES, 0))
            if magic != b"TIDS" or version != 1:
                raise ValueError(f"not a shard: {name}")
            crc = [zlib.crc32(read_ids(f, itemsize, o, n).astype("<u4").tobytes()) for o, n in zip(pdf.offset.tolist(), pdf.length.tolist())]
        return pd.DataFrame({"doc_id": pdf.doc_id.astype("Int64"), "occurrence": pdf.occurrence, "start": pdf.offset + base, "n_tokens": pdf.length, "ids_crc32": crc})

    return located.groupBy("shard").applyInPandas(read, "doc_id long, occurrence long, start long, n_tokens long, ids_crc32 long")


def store_and_read(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Encodes, writes, indexes, then finds every document by its key and reads its ids back."""
    folder = common.new_path(docs.sparkSession, "token-shards")
    manifest = write_shards(docs, folder, tokenizer, end_id)
    index = build_index(manifest, folder)
    return read_back(locate(manifest.select("doc_id", "occurrence"), index), shard_table(manifest))
