"""Text outputs. DataFrames carry raw doubles; only these functions format them, with Python's %.

Writers stream rows in order from Spark partition by partition; the driver holds one at a time.
"""

from __future__ import annotations

import gzip
import math
import sys
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.operators import coverage
from strandframe.operators.profile import Profile
from strandframe.operators.summary import LAST_BIN
from strandframe.schema import Header
from strandframe.sources.files import filesystem
from strandframe.sources.sam import record_line


@contextmanager
def opened(path: str, compressed: bool = False):
    """A binary stream to a file or, for '-', to standard output."""
    if path == "-":
        raw, close = sys.stdout.buffer, sys.stdout.buffer.flush
    else:
        fs, plain = filesystem(path)
        raw = fs.open_output_stream(plain, compression=None)
        close = raw.close
    try:
        if compressed:
            with gzip.GzipFile(fileobj=raw, mode="wb") as out:
                yield out
        else:
            yield raw
    finally:
        close()


def number(x: float, form: str = "%.8g") -> str:
    """C's spelling, also of nan and inf."""
    return form % x


def sam_text(header: Header | None, rows: Iterable) -> Iterator[str]:
    yield from header.lines if header else ()
    yield from map(record_line, rows)


def insert_line(name: str, n: int, total: int, right: bool = False) -> str:
    width = 1 + int(math.log10(total)) if total > 0 else 7
    value = "NA" if name == "Total inserts" and n == -1 else str(n)
    percent = "%6.2f" % (100.0 * n / total) if total > 0 else "%6s" % "NA"
    return f"# {name:>20}: {value:>{width}} ({percent}%)" if right else f"# {name:<20}: {value:>{width}} ({percent}%)"


def equivalent_line(name: str, x: float, total: int, note: str = "") -> str:
    percent = "%6.2f" % (100.0 * x / total) if total > 0 else "%6s" % "NA"
    return f"# {name:<20}: {'%10.7g' % x} ({percent}%)" + (f" {note}" if note else "")


def profile_text(profile: Profile, label: str, comments: Iterable[str] = (), pandas: bool = True) -> Iterator[str]:
    yield from comments
    total = profile.total
    yield insert_line("Total inserts", total, total)
    yield insert_line("Mapped inserts", profile.mapped, total)
    yield insert_line("- Multiple mapped ", profile.multi, total, right=True)
    yield insert_line("- Uniquely mapped ", profile.unique, total, right=True)
    yield equivalent_line("Purged inserts", profile.purged, total, "due to ambiguous mapping or low abundance features")
    yield equivalent_line("Effective inserts", profile.effective, total)
    yield "# Estimated seq. length for 'Unknown': " + ("NA" if profile.unknown_length is None else f"{profile.unknown_length}bp")
    yield f"ID\t{label}" if pandas else label
    for r in profile.values.orderBy("feature_ord").toLocalIterator():
        yield f"{r.feature}\t{number(r.value)}"


def summary_text(rows: DataFrame) -> Iterator[str]:
    for r in rows.orderBy("ord").toLocalIterator():
        yield f"{r.qname}\t{r.qlen}\t{r.rname}\t{r.glocal}\t{r.match}\t{number(r.identity, '%.1f')}"


def histogram_text(histogram: DataFrame) -> Iterator[str]:
    for r in histogram.orderBy("bin").collect():  # LAST_BIN + 1 rows at most
        yield f"{r.bin}+\t{r.n}" if r.bin == LAST_BIN else f"{r.bin}\t{r.n}"


def coverage_summary_text(summary: DataFrame) -> Iterator[str]:
    for r in summary.orderBy("tid").toLocalIterator():
        yield f"{r.rname}\t{number(r.breadth, '%.8f')}\t{number(r.mean_depth, '%.2f')}" if r.touched else f"{r.rname}\t0\t0"


def coverage_text(df: DataFrame, refs: DataFrame, words: int = 17, skip_uncovered: bool = False) -> Iterator[str]:
    """>name, then depths, so many a line. Segments are streamed; zeros between them are made here."""
    if words < 1:
        raise ValueError("-w must be a non-zero positive integer")
    touched = df.where("tid is not null").select("tid").distinct().withColumn("touched", F.lit(True))
    targets = refs.join(touched, "tid", "inner" if skip_uncovered else "left")
    deep = targets.join(coverage.segments(df, refs), "tid", "left").select("tid", "rname", "tlen", "start", "end", "depth").orderBy("tid", "start")
    line: list[str] = []
    current, at, length = None, 0, 0

    def put(depth: int, upto: int) -> Iterator[str]:
        nonlocal at, line
        while at < upto:
            step = min(upto - at, words - len(line))
            line += [str(depth)] * step
            at += step
            if len(line) == words:
                yield " ".join(line)
                line = []

    def end() -> Iterator[str]:
        nonlocal line
        yield from put(0, length)
        if line:
            yield " ".join(line)
            line = []

    for r in deep.toLocalIterator():
        if r.tid != current:
            if current is not None:
                yield from end()
            current, at, length = r.tid, 0, r.tlen
            yield f">{r.rname}"
        if r.start is not None:
            yield from put(0, r.start)
            yield from put(r.depth, r.end)
    if current is not None:
        yield from end()


def matrix_text(rows: Iterable[tuple[str, list[float]]], columns: list[str], style: str = "r") -> Iterator[str]:
    """style: plain (numbers alone, %-8.8f), r (header without a corner), pandas (header with ID)."""
    if style != "plain":
        yield "\t".join((["ID"] if style == "pandas" else []) + columns)
    for name, values in rows:
        if style == "plain":
            yield " ".join("%-8.8f" % v for v in values)
        else:
            yield "\t".join([name, *map(number, values)])


def write_lines(path: str, lines: Iterable[str], compressed: bool = False) -> None:
    """The first line is made before the file is, so an error that comes early leaves no file."""
    lines = iter(lines)
    first = next(lines, None)
    with opened(path, compressed) as out:
        if first is not None:
            out.write((first + "\n").encode())
        for line in lines:
            out.write((line + "\n").encode())
