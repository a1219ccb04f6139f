"""WARC archives in Zstandard frames with a dictionary in front, written and read.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds the Zstandard dictionary;
then one frame per record, compressed with it. The dictionary is trained for each archive on its
first records (SAMPLE_RECORDS at most, so many bytes of each). Record headers name, in this order,
type, id, target, date, digests, lengths; the reader checks version, mandatory headers, block length and
digests, and raises on the first record that isn't as its headers say.

Of records with equal payloads of at least LEAST_BYTES, that with the largest page_id is the response
and the others revisit it: they hold no payload, but its length and digest. Equal payloads are
found by SHA-1 sums alone, pre-aggregated, and the rows of a digest are dealt over SALTS tasks.

An archive's name is its own per attempt and only archives in the committed manifest are read.

Defined results: a null html is an empty payload; a null page_id is smaller than any other; rows that
share the largest page_id and the payload are all responses; null urls are written as an empty target;
an empty table gives no archive and an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.llm import common

LEAST_BYTES = 1000
SKIPPABLE = 0x184D2A5D
SAMPLE_RECORDS = 128
SAMPLE_BYTES = 16_384
DICTIONARY_BYTES = 65_536
_VERSION = b"WARC/1.1"
_DATE = "2024-01-01T00:00:00Z"
_NONE = "none"
MANIFEST = "file string, records long, bytes long"
RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{_NONE if page_id is None else page_id}>"


def page_of(identifier: str) -> int | None:
    name = identifier.removeprefix("<urn:page:").removesuffix(">")
    if identifier != f"<urn:page:{name}>":
        raise ValueError(f"not a record id: {identifier}")
    return None if name == _NONE else int(name)


def encode_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    block = b"" if revisit else payload
    target = "".join(c if c.isprintable() and c != " " else "%" + "%".join(f"{b:02X}" for b in c.encode()) for c in url or "")
    lines = [
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Target-URI: {target}",
        f"WARC-Date: {_DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    return _VERSION + b"\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def decode_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block; ValueError if the record isn't well formed."""
    head, mark, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not mark or lines[0] != _VERSION:
        raise ValueError("no WARC record")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.decode().partition(":")
        if not colon or not name or name != name.strip() or name.lower() in headers:
            raise ValueError(f"bad header: {line!r}")
        headers[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise ValueError(f"no header {name}")
    length = headers["content-length"]
    if not length.isdecimal() or len(rest) != int(length) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError("the block isn't as long as its header says")
    block = rest[:-4]
    if headers.get("warc-block-digest", "") != f"sha1:{hashlib.sha1(block).hexdigest()}":
        raise ValueError("the block's digest is wrong")
    if headers["warc-type"] == "response" and (headers.get("warc-payload-digest") != headers["warc-block-digest"] or headers.get("x-payload-length") != length):
        raise ValueError("the payload isn't the block")
    if headers["warc-type"] == "revisit" and (block or "warc-refers-to" not in headers or "warc-payload-digest" not in headers or not headers.get("x-payload-length", "").isdecimal()):
        raise ValueError("the revisit record is incomplete")
    if headers["warc-type"] not in ("response", "revisit"):
        raise ValueError(f"unknown type {headers['warc-type']}")
    return headers, block


class ArchiveWriter:
    """Writes one archive to a binary stream; records wait until there are enough to train the dictionary."""

    def __init__(self, out):
        self.out, self.waiting, self.compressor, self.records, self.size = out, [], None, 0, 0

    def _put(self, raw: bytes) -> None:
        self.out.write(raw)
        self.size += len(raw)

    def _begin(self) -> None:
        import zstandard

        samples = [r[:SAMPLE_BYTES] for r in self.waiting]
        try:
            dictionary = zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=3).as_bytes() if len(samples) >= 8 else b""
        except zstandard.ZstdError:  # too little to train on
            dictionary = b""
        self._put(struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary)
        data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.compressor = zstandard.ZstdCompressor(level=3, dict_data=data, write_content_size=True, write_checksum=True)
        for r in self.waiting:
            self._put(self.compressor.compress(r))
        self.waiting = []

    def add(self, record: bytes) -> None:
        self.records += 1
        if self.compressor:
            self._put(self.compressor.compress(record))
            return
        self.waiting.append(record)
        if len(self.waiting) >= SAMPLE_RECORDS:
            self._begin()

    def end(self) -> None:
        if not self.compressor:
            self._begin()


def read_archive(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an archive, each from its own frame; the stream is read in pieces."""
    import zstandard

    def take(n: int) -> bytes:
        raw = stream.read(n)
        if len(raw) != n:
            raise ValueError("the archive is cut off")
        return raw

    magic, size = struct.unpack("<II", take(8))
    if magic != SKIPPABLE:
        raise ValueError("no dictionary frame in front")
    dictionary = take(size)
    if dictionary[:4] == b"\x28\xb5\x2f\xfd":  # the dictionary itself may be compressed
        dictionary = zstandard.ZstdDecompressor().decompress(dictionary)
    decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    rest = b""
    while True:
        one, parts = decompressor.decompressobj(), []
        while not one.eof:
            rest = rest or stream.read(1 << 18)
            if not rest:
                break
            parts.append(one.decompress(rest))
            rest = one.unused_data if one.eof else b""
        if not one.eof:
            if parts:
                raise ValueError("the archive is cut off")
            return
        yield decode_record(b"".join(parts))


def decided(pages: DataFrame) -> DataFrame:
    """page_id, url, html (no null), digest, refers_to (null: a response) and revisit of each row."""
    rows = common.plain(pages, {"page_id": "long", "url": "string", "html": "string"}).withColumn("html", F.coalesce("html", F.lit("")))
    payload = F.col("html").cast("binary")
    rows = rows.withColumn("digest", F.sha1(payload)).withColumn("n", F.octet_length("html"))
    shared = rows.where(F.col("n") >= LEAST_BYTES).groupBy("digest", "n").agg(F.max("page_id").alias("last"), F.count("*").alias("times")).where("times > 1")
    shared = common.stored(shared, "warc-shared")
    # payloads of over a thousandth of all rows, so a thousand at most, are broadcast; their rows get keys of their own in the other join
    hot = F.col("times") > max(common.HEAVY_ROWS, rows.count() / common.HEAVY_KEYS)
    same = (F.col("digest") == F.col("_digest")) & (F.col("n") == F.col("_n"))
    few = shared.where(hot).select(F.col("digest").alias("_digest"), F.col("n").alias("_n"), F.col("last").alias("_hot_last"), F.lit(True).alias("_hot"))
    out = rows.join(F.broadcast(few), same, "left").drop("_digest", "_n")
    key = F.when(F.col("_hot"), F.concat_ws(" ", F.lit("row"), "page_id", "url")).otherwise(F.col("digest"))
    rest = shared.where(~hot).select(F.col("digest").alias("_digest"), F.col("n").alias("_n"), F.col("last").alias("_last"))
    out = out.withColumn("_key", key).join(rest, (F.col("_key") == F.col("_digest")) & (F.col("n") == F.col("_n")), "left")
    last = F.when(F.col("_hot"), F.col("_hot_last")).otherwise(F.col("_last"))
    # without a match both sides are null and the row is a response
    copied = F.coalesce("_hot", F.col("_digest").isNotNull())
    revisit = F.coalesce(copied & ~F.col("page_id").eqNullSafe(last), F.lit(False))
    return out.select("page_id", "url", "html", "digest", F.when(revisit, last).alias("refers_to"), revisit.alias("revisit"))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes an archive per task; the committed manifest: MANIFEST."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, out, writer = f"{folder}/pages-{uuid.uuid4().hex}.warc.zst", None, None
        try:
            for batch in batches:
                for k in range(0, batch.num_rows, 256):
                    for page_id, url, html, digest, refers_to, revisit in zip(*(c.to_pylist() for c in batch.slice(k, 256).columns)):
                        if out is None:
                            fs, path = common.filesystem(file)
                            fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
                            out = fs.open_output_stream(path)
                            writer = ArchiveWriter(out)
                        writer.add(encode_record(page_id, url, html.encode(), digest, refers_to, revisit))
            if writer is not None:
                writer.end()
        finally:
            if out is not None:
                out.close()
        if writer is not None:
            yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([writer.records]), pa.array([writer.size])], names=["file", "records", "bytes"])

    return common.stored(decided(pages).mapInArrow(write, MANIFEST), "warc-manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """RESULT, a row per record; a task reads whole archives."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, path = common.filesystem(file)
                rows, seen = [], 0
                with fs.open_input_stream(path) as stream:
                    for headers, _ in read_archive(stream):
                        revisit = headers["warc-type"] == "revisit"
                        digest = headers["warc-payload-digest"].removeprefix("sha1:")
                        rows.append((page_of(headers["warc-record-id"]), int(headers["x-payload-length"]), digest, headers["warc-type"], page_of(headers["warc-refers-to"]) if revisit else None))
                        seen += 1
                        if len(rows) == 4096:
                            yield as_batch(rows)
                            rows = []
                if seen != expected:
                    raise ValueError(f"{file} holds {seen} records, not {expected}")
                if rows:
                    yield as_batch(rows)

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        c = list(zip(*rows))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    files = max(1, manifest.count())
    return manifest.select("file", "records").repartition(files, "file").mapInArrow(read, RESULT)


def archive_and_read(pages: DataFrame) -> DataFrame:
    return read_archives(write_archives(pages, common.new_path(pages.sparkSession, "warc")))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
g AS (SELECT payload_digest, max(page_id) AS last FROM d WHERE payload_bytes >= 1000 GROUP BY 1 HAVING count(*) > 1)
SELECT d.page_id, payload_bytes, d.payload_digest,
       CASE WHEN g.payload_digest IS NULL OR d.page_id = g.last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN g.payload_digest IS NULL OR d.page_id = g.last THEN NULL ELSE g.last END AS refers_to
FROM d LEFT JOIN g ON d.payload_digest = g.payload_digest
"""
