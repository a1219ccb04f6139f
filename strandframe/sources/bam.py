"""BAM: a codec on bytes, a Python data source that reads it, and a writer.

BGZF is a series of gzip members (blocks) that name their own size, so a file is read in splits of
SPLIT_BYTES. A split begins at the first record that begins in or after its first block: blocks are found by
their marks, records by a chain of plausible ones. The split before reads up to that very place, else
it fails, so a wrong guess can't lose or repeat a record. Files of plain gzip are one split each.
Records leave a task in Arrow batches of BATCH_ROWS. Writing makes members of at most 64 KB and the empty one
at the end.
"""

from __future__ import annotations

import gzip
import itertools
import struct
import zlib
from collections.abc import Iterable, Iterator
from types import SimpleNamespace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from strandframe.schema import ALIGNMENT, Header
from strandframe.sources.files import filesystem
from strandframe.sources.sam import parse_header

# Fixed values of the format.
MAGIC = b"BAM\x01"
CIGAR_OPS = "MIDNSHP=X"
BASES = "=ACMGRSVTWYHKDBN"
EOF_MEMBER = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
INT_TAGS = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I"}
ARRAY_TAGS = INT_TAGS | {"f": "<f"}
MEMBER_BYTES = 0xFF00
#: Bytes of a file that a task reads; records of a batch; records in a row that must look right where a split begins.
SPLIT_BYTES = 32 << 20
BATCH_ROWS = 4096
CHAIN = 6
_TYPES = {"BIGINT": pa.int64(), "INT": pa.int32(), "STRING": pa.string(), "ARRAY<STRING>": pa.list_(pa.string())}
ARROW = pa.schema([(c.split()[0], _TYPES[c.split()[1]]) for c in ALIGNMENT.split(", ")])


def _exactly(stream, n: int) -> bytes:
    raw = stream.read(n)
    if len(raw) != n:
        raise ValueError("the BAM file is cut off")
    return raw


def decode_header(stream) -> Header:
    if _exactly(stream, 4) != MAGIC:
        raise ValueError("not a BAM file")
    (n,) = struct.unpack("<i", _exactly(stream, 4))
    lines = [x for x in _exactly(stream, n).rstrip(b"\0").decode().split("\n") if x]
    refs = []
    for _ in range(struct.unpack("<i", _exactly(stream, 4))[0]):
        (n,) = struct.unpack("<i", _exactly(stream, 4))
        name = _exactly(stream, n)[:-1].decode()
        refs.append((name, struct.unpack("<i", _exactly(stream, 4))[0]))
    parsed = parse_header(lines)
    return Header(parsed.lines, tuple(refs))


def decode_tags(raw: bytes) -> list[str]:
    out, at = [], 0
    while at < len(raw):
        name, kind = raw[at : at + 2].decode(), chr(raw[at + 2])
        at += 3
        if kind == "A":
            value, at = chr(raw[at]), at + 1
        elif kind in INT_TAGS:
            size = struct.calcsize(INT_TAGS[kind])
            value, kind, at = struct.unpack_from(INT_TAGS[kind], raw, at)[0], "i", at + size
        elif kind == "f":
            value, at = f"{struct.unpack_from('<f', raw, at)[0]:g}", at + 4
        elif kind in "ZH":
            end = raw.index(b"\0", at)
            value, at = raw[at:end].decode(), end + 1
        elif kind == "B":
            sub, n = chr(raw[at]), struct.unpack_from("<i", raw, at + 1)[0]
            form = ARRAY_TAGS[sub]
            values = [struct.unpack_from(form, raw, at + 5 + k * struct.calcsize(form))[0] for k in range(n)]
            value = ",".join([sub, *(f"{v:g}" if sub == "f" else str(v) for v in values)])
            at += 5 + n * struct.calcsize(form)
        else:
            raise ValueError(f"unknown type of tag: {kind}")
        out.append(f"{name}:{kind}:{value}")
    return out


def decode_record(raw: bytes, refs: tuple[tuple[str, int], ...], ord_: int) -> tuple:
    tid, pos, name_size, mapq, _, n_ops, flag, size, next_tid, next_pos, tlen = struct.unpack_from("<iiBBHHHiiii", raw)
    at = 32 + name_size
    qname = raw[32 : at - 1].decode()
    ops = struct.unpack_from(f"<{n_ops}I", raw, at)
    at += 4 * n_ops
    cigar = "".join(f"{o >> 4}{CIGAR_OPS[o & 15]}" for o in ops) or "*"
    packed = raw[at : at + (size + 1) // 2]
    seq = "".join(BASES[b >> 4] + BASES[b & 15] for b in packed)[:size] or "*"
    at += len(packed)
    quality = raw[at : at + size]
    qual = "*" if not size or quality[0] == 0xFF else "".join(chr(q + 33) for q in quality)
    tags = decode_tags(raw[at + size :])
    first = {}
    for t in tags:
        first.setdefault(t[:4], t[5:])
    number = lambda key: int(first[key]) if key in first else None
    mate = "*" if next_tid < 0 else "=" if next_tid == tid else refs[next_tid][0]
    return (
        ord_, qname, flag, None if tid < 0 else tid, "*" if tid < 0 else refs[tid][0], pos, mapq, cigar, mate, next_pos + 1, tlen, seq, qual, tags,
        first.get("MD:Z"), number("NM:i"), number("AS:i"),
    )


def decode(stream) -> Iterator[tuple]:
    """The records of an uncompressed BAM stream, as ALIGNMENT tuples."""
    refs = decode_header(stream).refs
    ord_ = 0
    while head := stream.read(4):
        if len(head) != 4:
            raise ValueError("the BAM file is cut off")
        yield decode_record(_exactly(stream, struct.unpack("<i", head)[0]), refs, ord_)
        ord_ += 1


def block_size(head: bytes) -> int:
    """The size of the BGZF block that begins so; 0 if none does."""
    if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04":
        return 0
    at, end = 12, 12 + struct.unpack_from("<H", head, 10)[0]
    while at + 6 <= min(end, len(head)):
        (size,) = struct.unpack_from("<H", head, at + 2)
        if head[at : at + 2] == b"BC" and size == 2:
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + size
    return 0


class Blocks:
    """The uncompressed bytes from a block on, and the place of each of them: (block's offset in the file, offset in the block)."""

    def __init__(self, file, at: int):
        self.file, self.next, self.ended = file, at, False
        self.data, self.done = bytearray(), 0  # done: bytes that were dropped from the front
        self.starts: list[tuple[int, int]] = []  # (place among all bytes, the block's offset)

    def _more(self) -> bool:
        self.file.seek(self.next)
        head = self.file.read(64)
        if not head:
            self.ended = True
            return False
        size = block_size(head)
        raw = head[:size] + self.file.read(max(0, size - len(head)))
        if not size or len(raw) < size:
            raise ValueError("the BAM file is cut off")
        plain = zlib.decompress(raw[12 + struct.unpack_from("<H", raw, 10)[0] : -8], -15)
        if zlib.crc32(plain) != struct.unpack_from("<I", raw, size - 8)[0]:
            raise ValueError("a block of the BAM file is damaged")
        if plain:
            self.starts.append((self.done + len(self.data), self.next))
            self.data += plain
        self.next += size
        return True

    def has(self, upto: int) -> bool:
        """Whether there are so many bytes in front."""
        while len(self.data) < upto and self._more():
            pass
        return len(self.data) >= upto

    def take(self, n: int) -> bytes:
        if not self.has(n):
            raise ValueError("the BAM file is cut off")
        out = bytes(self.data[:n])
        del self.data[:n]
        self.done += n
        return out

    read = take

    def place(self, ahead: int = 0) -> tuple[int, int]:
        """Of the byte so far ahead; beyond the last block the file's end."""
        if not self.has(ahead + 1):
            return self.next, 0
        while len(self.starts) > 1 and self.starts[1][0] <= self.done:
            del self.starts[0]
        begin, block = next(x for x in reversed(self.starts) if x[0] <= self.done + ahead)
        return block, self.done + ahead - begin


def find_block(file, at: int, size: int) -> int:
    """The offset of the first block at or after at; the file's size if there is none."""
    step = 1 << 17  # two blocks at least
    while at < size:
        file.seek(at)
        raw = file.read(step)
        k = raw.find(b"\x1f\x8b\x08\x04")
        while 0 <= k and (k < step // 2 or at + len(raw) == size):
            if own := block_size(raw[k : k + 64]):
                after = raw[k + own : k + own + 64]
                if at + k + own == size or block_size(after):
                    return at + k
            k = raw.find(b"\x1f\x8b\x08\x04", k + 1)
        at += step // 2
    return size


def _plausible(blocks: Blocks, at: int, n_refs: int) -> int:
    """Where the record that seems to begin at at ends; 0 if none does."""
    if not blocks.has(at + 36):
        return 0
    size, tid, pos, name_size, _, _, n_ops, _, length, next_tid, next_pos = struct.unpack_from("<iiiBBHHHiii", blocks.data, at)
    if not (-1 <= tid < n_refs and -1 <= next_tid < n_refs and pos >= -1 and next_pos >= -1 and length >= 0 and name_size >= 1):
        return 0
    if size < 32 + name_size + 4 * n_ops + (length + 1) // 2 + length or not blocks.has(at + 36 + name_size):
        return 0
    name = blocks.data[at + 36 : at + 36 + name_size]
    return at + 4 + size if name[-1] == 0 and all(33 <= c <= 126 for c in name[:-1]) else 0


def first_record(file, at: int, size: int, n_refs: int) -> tuple[int, int]:
    """The place of the first record that begins in or after the first block at or after at."""
    blocks = Blocks(file, find_block(file, at, size))
    begin = 0
    while blocks.has(begin + 1):
        end, k = begin, 0
        while k < CHAIN and (k == 0 or blocks.has(end + 1)):
            end = _plausible(blocks, end, n_refs)
            if not end:
                break
            k += 1
        if end and (k == CHAIN or not blocks.has(end + 1)):
            return blocks.place(begin)
        begin += 1
    return size, 0


class _Split(InputPartition):
    """Bytes first to last of a file (last 0: all of it, as one stream); number: among all splits."""

    def __init__(self, path: str, first: int, last: int, number: int):
        self.path, self.first, self.last, self.number = path, first, last, number


def _files(path: str):
    """(file system, files): the file itself or the *.bam files of the folder, by name."""
    from pyarrow.fs import FileSelector, FileType

    fs, plain = filesystem(path)
    info = fs.get_file_info(plain)
    if info.type != FileType.Directory:
        return fs, [info]
    found = sorted((f for f in fs.get_file_info(FileSelector(plain)) if f.path.endswith(".bam")), key=lambda f: f.path)
    if not found:
        raise ValueError(f"no *.bam file in {path}")
    return fs, found


class _Reader(DataSourceReader):
    def __init__(self, path: str, split_bytes: int):
        self.path, self.split_bytes = path, split_bytes

    def partitions(self):
        fs, files = _files(self.path)
        out = []
        for info in files:
            with fs.open_input_stream(info.path, compression=None) as f:
                whole = not block_size(f.read(64))
            edges = [0] if whole else list(range(0, max(1, info.size), self.split_bytes))
            out += [_Split(info.path, a, 0 if whole else min(info.size, a + self.split_bytes), len(out) + k) for k, a in enumerate(edges)]
        return out

    def read(self, partition):
        rows = self._records(partition)
        while batch := list(itertools.islice(rows, BATCH_ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*batch), ARROW.types)], schema=ARROW)

    def _records(self, split: _Split) -> Iterator[tuple]:
        fs, _ = filesystem(self.path)
        base = split.number << 33
        if not split.last:
            with fs.open_input_stream(split.path, compression=None) as raw, gzip.open(raw) as stream:
                for row in decode(stream):
                    yield (base + row[0], *row[1:])
            return
        with fs.open_input_file(split.path) as file:
            size = file.size()
            blocks = Blocks(file, 0)
            refs = decode_header(blocks).refs
            top = blocks.place()

            def begin(at: int) -> tuple[int, int]:
                return top if at <= top[0] else first_record(file, at, size, len(refs))

            if (start := begin(split.first)) != top:
                blocks = Blocks(file, start[0])
                blocks.take(start[1])
            stop, ord_ = begin(split.last) if split.last < size else (size, 0), base
            while (at := blocks.place()) < stop:
                yield decode_record(blocks.take(struct.unpack("<i", blocks.take(4))[0]), refs, ord_)
                ord_ += 1
            if at != stop:
                raise ValueError(f"no record begins where one was expected in {split.path}, block {stop[0]}")


class BamDataSource(DataSource):
    """spark.read.format("strandframe_bam").load(path): a file or a folder of *.bam files."""

    @classmethod
    def name(cls) -> str:
        return "strandframe_bam"

    def schema(self) -> str:
        return ALIGNMENT

    def reader(self, schema):
        return _Reader(self.options["path"], int(self.options.get("splitBytes", SPLIT_BYTES)))


def read_bam(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> tuple[DataFrame, Header]:
    """A file, or a folder of files that all have the same sequences: (alignments, the first file's header)."""
    spark.dataSource.register(BamDataSource)
    fs, files = _files(path)
    headers = []
    for info in files:
        with fs.open_input_stream(info.path, compression=None) as raw, gzip.open(raw) as stream:
            headers.append(decode_header(stream))
        if headers[-1].refs != headers[0].refs:
            raise ValueError(f"{info.path} has other sequences than {files[0].path}")
    return spark.read.format("strandframe_bam").option("splitBytes", str(split_bytes)).load(path), headers[0]


def first_records(path: str, n: int) -> list[tuple]:
    """The first records of a file, or of a folder's first file, as ALIGNMENT tuples."""
    fs, files = _files(path)
    with fs.open_input_stream(files[0].path, compression=None) as raw, gzip.open(raw) as stream:
        return list(itertools.islice(decode(stream), n))


# writing


def encode_tag(tag: str) -> bytes:
    name, kind, value = tag[:2].encode(), tag[3], tag[5:]
    if kind == "A":
        return name + b"A" + value.encode()
    if kind == "i":
        n = int(value)
        return name + (b"i" + struct.pack("<i", n) if n < 1 << 31 else b"I" + struct.pack("<I", n))
    if kind == "f":
        return name + b"f" + struct.pack("<f", float(value))
    if kind in "ZH":
        return name + kind.encode() + value.encode() + b"\0"
    if kind == "B":
        sub, *values = value.split(",")
        number = float if sub == "f" else int
        return name + b"B" + sub.encode() + struct.pack("<i", len(values)) + b"".join(struct.pack(ARRAY_TAGS[sub], number(v)) for v in values)
    raise ValueError(f"unknown type of tag: {kind}")


def bin_of(begin: int, end: int) -> int:
    """The index bin of a stretch: the smallest of the nested bins that holds it."""
    end -= 1
    for shift, first in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if begin >> shift == end >> shift:
            return first + (begin >> shift)
    return 0


def encode_record(row, tids: dict[str, int]) -> bytes:
    ops, number = [], ""
    for c in row.cigar if row.cigar and row.cigar != "*" else "":
        if c.isdigit():
            number += c
        else:
            ops.append((int(number), CIGAR_OPS.index(c)))
            number = ""
    seq = "" if row.seq in (None, "*") else row.seq
    code = [max(0, BASES.find(c)) if c in BASES else 15 for c in seq.upper()] + [0] * (len(seq) % 2)
    packed = bytes(code[k] << 4 | code[k + 1] for k in range(0, len(code), 2))
    qual = b"\xff" * len(seq) if row.qual in (None, "*") else bytes(ord(c) - 33 for c in row.qual)
    pos = -1 if row.pos0 is None else row.pos0
    span = sum(n for n, o in ops if CIGAR_OPS[o] in "MDN=X")
    tid = -1 if row.tid is None else row.tid
    mate = -1 if row.rnext in (None, "*") else tid if row.rnext == "=" else tids[row.rnext]
    name = row.qname.encode() + b"\0"
    where = bin_of(max(0, pos), max(0, pos) + max(1, span)) & 0xFFFF if pos >= 0 else 4680
    body = struct.pack("<iiBBHHHiiii", tid, pos, len(name), row.mapq or 0, where, len(ops), row.flag, len(seq), mate, (row.pnext or 0) - 1, row.tlen or 0)
    body += name + b"".join(struct.pack("<I", n << 4 | o) for n, o in ops) + packed + qual + b"".join(map(encode_tag, row.tags or []))
    return struct.pack("<i", len(body)) + body


def member(data: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    packed = z.compress(data) + z.flush()
    return struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(packed) + 25) + packed + struct.pack("<II", zlib.crc32(data), len(data))


def encode_header(header: Header) -> bytes:
    text = "".join(f"{x}\n" for x in header.lines).encode()
    parts = [MAGIC, struct.pack("<i", len(text)), text, struct.pack("<i", len(header.refs))]
    for name, length in header.refs:
        parts.append(struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", length))
    return b"".join(parts)


def members(rows: Iterable, tids: dict[str, int], level: int = 6, data: bytes = b"") -> Iterator[bytes]:
    """BGZF members of data and the records after it."""
    data = bytearray(data)
    for row in rows:
        data += encode_record(row, tids)
        while len(data) >= MEMBER_BYTES:
            yield member(bytes(data[:MEMBER_BYTES]), level)
            del data[:MEMBER_BYTES]
    while data:
        yield member(bytes(data[:MEMBER_BYTES]), level)
        del data[:MEMBER_BYTES]


def write_bam(out, header: Header, rows: Iterable, level: int = 6) -> None:
    """Writes header and rows to a binary stream; level 0 stores without compression."""
    tids = {name: tid for tid, (name, _) in enumerate(header.refs)}
    for m in members(rows, tids, level, encode_header(header)):
        out.write(m)
    out.write(EOF_MEMBER)


def write_folder(df: DataFrame, header: Header, path: str, level: int = 6) -> int:
    """Each partition of df as a BAM file with the header in the folder path; the number of records.

    A file gets its name once it is whole, the same name whichever attempt of the task writes it.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast((encode_header(header), {name: tid for tid, (name, _) in enumerate(header.refs)}))
    fs, plain = filesystem(path)
    fs.create_dir(plain, recursive=True)
    columns = ["qname", "flag", "tid", "rname", "pos0", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual", "tags"]

    def write(batches):
        from pyspark import TaskContext

        at, head_and_tids = TaskContext.get(), shared.value
        n = 0

        def rows():
            nonlocal n
            for batch in batches:
                n += batch.num_rows
                for values in zip(*(c.to_pylist() for c in batch.columns)):
                    yield SimpleNamespace(**dict(zip(columns, values)))

        out_fs, folder = filesystem(path)
        part = f"{folder}/.part-{at.partitionId():05d}-{at.taskAttemptId()}"
        with out_fs.open_output_stream(part, compression=None) as out:
            for m in members(rows(), head_and_tids[1], level, head_and_tids[0]):
                out.write(m)
            out.write(EOF_MEMBER)
        out_fs.move(part, f"{folder}/part-{at.partitionId():05d}.bam")
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return sum(r.n for r in df.select(*columns).mapInArrow(write, "n bigint").collect())

