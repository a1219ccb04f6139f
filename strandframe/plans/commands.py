"""The four commands as plans: from a source through operators to a result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandframe.operators import coverage, filter as filters, profile as profiles, qname, summary
from strandframe.schema import ALIGNMENT, Header
from strandframe.sources import bam, sam, tables


def _sniffed(path: str) -> str:
    """bam or sam (gzipped or not), by the first bytes of the file or of the folder's first file."""
    import gzip

    from pyarrow.fs import FileSelector, FileType

    from strandframe.sources.files import filesystem

    fs, plain = filesystem(path)
    if fs.get_file_info(plain).type == FileType.Directory:
        inside = sorted(f.path for f in fs.get_file_info(FileSelector(plain)) if f.type == FileType.File and not f.base_name.startswith(("_", ".")))
        if not inside:
            raise ValueError(f"no file in {path}")
        plain = inside[0]
    with fs.open_input_stream(plain, compression=None) as f:
        head = f.read(2)
    if head != b"\x1f\x8b":
        return "sam"
    with fs.open_input_stream(plain, compression=None) as f, gzip.open(f) as g:
        return "bam" if g.read(4) == bam.MAGIC else "sam"


def received(spark: SparkSession) -> str:
    """Standard input as a file where all executors can read it: the folder of spark.checkpoint.dir, or here a temporary one."""
    import shutil
    import sys
    import tempfile
    import uuid

    from strandframe.sources.files import filesystem

    base = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="strandframe-")
    stream = sys.stdin.buffer
    head = stream.read(2)
    path = f"{base.rstrip('/')}/stdin-{uuid.uuid4().hex}" + (".gz" if head == b"\x1f\x8b" else ".sam")
    fs, plain = filesystem(path)
    fs.create_dir(plain.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(plain, compression=None) as out:
        out.write(head)
        shutil.copyfileobj(stream, out, 1 << 20)
    return path


def read(spark: SparkSession, path: str, sam_input: bool = False) -> tuple[DataFrame, Header]:
    """A SAM or BAM file or folder; without sam_input the first bytes tell."""
    if sam_input or _sniffed(path) == "sam":
        return sam.read_sam(spark, path)
    return bam.read_bam(spark, path)


def first_records(spark: SparkSession, path: str, header: Header, sam_input: bool = False, n: int = qname.ORDER_RECORDS) -> DataFrame:
    """The first alignments of what read() reads, without reading the rest."""
    if sam_input or _sniffed(path) == "sam":
        return sam.first_records(spark, path, header, n)
    return spark.createDataFrame(bam.first_records(path, n), ALIGNMENT)


def filter_plan(df: DataFrame, header: Header, options: filters.FilterOptions, first: DataFrame | None = None) -> tuple[DataFrame, qname.QNameCheck]:
    """first: the first records, if they are at hand; else all are read for them."""
    check = qname.check_grouping(df if first is None else first, header) if options.needs_grouping else qname.NOT_REQUIRED
    return filters.output_order(filters.filter_alignments(df, options), options), check


def profile_plan(spark: SparkSession, df: DataFrame, header: Header, genome_path: str | None = None, first: DataFrame | None = None, **options) -> tuple[profiles.Profile, qname.QNameCheck]:
    check = qname.check_grouping(df if first is None else first, header)
    genomes = tables.read_genomes(spark, genome_path) if genome_path else None
    return profiles.profile(df, sam.refs_frame(spark, header), genomes, **options), check


def filtered_profile(df: DataFrame, refs: DataFrame, options: filters.FilterOptions, **profile_options) -> profiles.Profile:
    """filter, then profile, as one plan: both group by read, on one shuffle."""
    return profiles.profile(filters.filter_alignments(df, options), refs, **profile_options)


def coverage_plan(spark: SparkSession, df: DataFrame, header: Header, skip_uncovered: bool = False) -> DataFrame:
    return coverage.summary(df, sam.refs_frame(spark, header), skip_uncovered)


def summary_plan(spark: SparkSession, df: DataFrame, header: Header, edge: int | None = None, stats: str | None = None, count: bool = False) -> DataFrame:
    summary.check_options(edge, stats, count)
    if count:
        return summary.count_inserts(df, grouped=False)
    refs = sam.refs_frame(spark, header)
    return summary.histogram(df, refs, stats, edge or 0) if stats else summary.rows(df, refs, edge or 0)
