"""Command line: python -m strandframe filter|profile|coverage|summary ..."""

from __future__ import annotations

import argparse
import sys

USAGE = """Usage: strandframe <command> [options]

Commands:
  filter    filter alignments by length, identity, aligned share of the query, or best hit
  profile   estimate relative abundance of sequences or genomes
  coverage  per-position or per-sequence coverage
  summary   per-alignment statistics, histograms or insert count
  help      this text
"""


class _Parser(argparse.ArgumentParser):
    def error(self, message):
        print(message, file=sys.stderr)
        print("Use --help for usage instructions!")
        raise SystemExit(1)


def _parser(command: str) -> argparse.ArgumentParser:
    p = _Parser(prog=f"strandframe {command}", add_help=False)
    p.add_argument("--help", action="help", help="print this help and exit")
    p.add_argument("-S", dest="sam", action="store_true", help="input is SAM")
    p.add_argument("input", help="input SAM/BAM file or folder; - is standard input")
    if command == "filter":
        p.add_argument("-o", dest="folder", help="write a folder of parts instead of standard output: BAM files with -b or -u, else SAM lines without header")
        for flag, name in (("-b", "bam"), ("-u", "uncompressed"), ("-h", "header"), ("-k", "keep_unmapped"), ("-v", "invert")):
            p.add_argument(flag, dest=name, action="store_true")
        for flag, name in (("-l", "min_length"), ("-p", "percent_identity"), ("--ppt", "ppt"), ("-z", "min_query_percent")):
            p.add_argument(flag, dest=name, type=int)
        for name in ("rescore", "besthit", "uniqhit"):
            p.add_argument(f"--{name}", action="store_true")
    elif command == "profile":
        p.add_argument("-o", dest="output", required=True)
        p.add_argument("--label", required=True)
        p.add_argument("--genome")
        p.add_argument("--total", type=int)
        p.add_argument("--mincount", type=int)
        p.add_argument("--unit", default="rel")
        p.add_argument("--multi", default="proportional")
        for name in ("pandas", "no-pandas", "nolen"):
            p.add_argument(f"--{name}", action="store_true")
    elif command == "coverage":
        p.add_argument("-o", dest="output", required=True)
        p.add_argument("--summary", action="store_true")
        p.add_argument("-x", dest="skip", action="store_true", help="leave out sequences without alignments")
        p.add_argument("-w", dest="words", type=int, default=17)
        p.add_argument("-z", dest="gzip", action="store_true", help="no effect: output is always compressed")
    else:
        p.add_argument("-e", dest="edge", type=int)
        p.add_argument("-c", "--count", dest="count", action="store_true")
        p.add_argument("--stats")
    return p


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("strandframe").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def run(arguments: list[str], spark=None) -> int:
    if not arguments:
        print(USAGE, file=sys.stderr)
        return 1
    command, rest = arguments[0], arguments[1:]
    if command in ("help", "--help"):
        print(USAGE)
        return 0
    if command not in ("filter", "profile", "coverage", "summary"):
        print(f"unrecognized command '{command}'", file=sys.stderr)
        print(USAGE, file=sys.stderr)
        return 1
    try:
        options = _parser(command).parse_args(rest)
    except SystemExit as e:
        return int(e.code or 0)
    try:
        globals()[f"_{command}"](options, arguments, spark)
    except ValueError as e:
        print(e)
        return 1
    return 0


def _input(o, spark):
    """(alignments, header, a function that gives the first records)."""
    from strandframe.plans import commands

    path = commands.received(spark) if o.input == "-" else o.input
    df, header = commands.read(spark, path, o.sam)
    return df, header, lambda: commands.first_records(spark, path, header, o.sam)


def _filter(o, arguments, spark) -> None:
    from strandframe.operators.filter import FilterOptions
    from strandframe.plans import commands
    from strandframe.sinks import provenance, text
    from strandframe.sources import bam, sam

    options = FilterOptions(o.min_length, o.percent_identity, o.ppt, o.min_query_percent, o.invert, o.keep_unmapped, o.rescore, o.besthit, o.uniqhit)
    df, header, first = _input(o, spark or _session())
    rows, check = commands.filter_plan(df, header, options, first() if options.needs_grouping else None)
    header = provenance.add_program(header, arguments, check)
    if o.folder and (o.bam or o.uncompressed):
        bam.write_folder(rows, header, o.folder, 0 if o.uncompressed else 6)
    elif o.folder:
        sam.sam_lines(rows).write.text(o.folder)
    elif o.bam or o.uncompressed:
        with text.opened("-") as out:
            bam.write_bam(out, header, rows.toLocalIterator(), 0 if o.uncompressed else 6)
    else:
        text.write_lines("-", text.sam_text(header if o.header else None, rows.toLocalIterator()))


def _profile(o, arguments, spark) -> None:
    from strandframe.operators.profile import MULTI, UNITS, by_prefix
    from strandframe.plans import commands
    from strandframe.sinks import provenance, text

    if o.pandas and o.no_pandas:
        raise ValueError("--pandas and --no-pandas cannot be used together")
    if o.mincount is not None and o.mincount < 0:
        raise ValueError("--mincount must be a non-negative integer")
    if o.total is not None and o.total <= 0:
        raise ValueError("--total must be a positive integer")
    by_prefix(o.multi, MULTI, "--multi")
    by_prefix(o.unit, UNITS, "--unit")
    spark = spark or _session()
    df, header, first = _input(o, spark)
    made, check = commands.profile_plan(spark, df, header, o.genome, first(), multi=o.multi, unit=o.unit, total=o.total, mincount=o.mincount, nolen=o.nolen)
    text.write_lines(o.output, text.profile_text(made, o.label, provenance.profile_comments(arguments, check), not o.no_pandas), compressed=True)
    made.release()


def _coverage(o, arguments, spark) -> None:
    from strandframe.plans import commands
    from strandframe.sinks import text
    from strandframe.sources import sam

    if o.words < 1:
        raise ValueError("-w must be a non-zero positive integer")
    spark = spark or _session()
    df, header, _ = _input(o, spark)
    lines = text.coverage_summary_text(commands.coverage_plan(spark, df, header, o.skip)) if o.summary else text.coverage_text(df, sam.refs_frame(spark, header), o.words, o.skip)
    text.write_lines(o.output, lines, compressed=True)


def _summary(o, arguments, spark) -> None:
    from strandframe.operators import summary
    from strandframe.plans import commands
    from strandframe.sinks import text

    summary.check_options(o.edge, o.stats, o.count)
    spark = spark or _session()
    df, header, _ = _input(o, spark)
    made = commands.summary_plan(spark, df, header, o.edge, o.stats, o.count)
    lines = [str(made.first()[0])] if o.count else text.histogram_text(made) if o.stats else text.summary_text(made)
    text.write_lines("-", lines)


def main() -> None:
    raise SystemExit(run(sys.argv[1:]))
