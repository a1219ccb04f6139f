"""SAM text as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.schema import REFS, Header

_HEADER_LINE = r"^@[A-Z][A-Z]\t"


def parse_header(lines: list[str]) -> Header:
    refs = []
    for line in lines:
        if line.startswith("@SQ\t"):
            fields = dict(f.split(":", 1) for f in line.split("\t")[1:] if ":" in f)
            refs.append((fields["SN"], int(fields["LN"])))
    return Header(tuple(lines), tuple(refs))


def read_header(spark: SparkSession, path: str) -> Header:
    """The lines before the first record; only as much of the file is read as holds them."""
    text = spark.read.text(path)
    n = 1000
    while True:
        lines = [r.value for r in text.head(n)]
        header = []
        for line in lines:
            if not line.startswith("@"):
                return parse_header(header)
            header.append(line)
        if len(lines) < n:
            return parse_header(header)
        n *= 10


def refs_frame(spark: SparkSession, header: Header) -> DataFrame:
    return spark.createDataFrame([(tid, name, length) for tid, (name, length) in enumerate(header.refs)], REFS)


def input_order() -> Column:
    """A number that rises along a file: the split's place, then the line's place in its task."""
    line = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return F.shiftleft(F.shiftright(F.col("_metadata.file_block_start"), 16), 33).bitwiseOR(line)


def tag(name: str) -> Column:
    """The value of the first tag that begins with name (such as MD:Z:), or null."""
    return F.substring(F.get(F.filter("tags", lambda t: t.startswith(name)), F.lit(0)), len(name) + 1, 1 << 30)


def with_promoted_tags(df: DataFrame) -> DataFrame:
    return df.withColumns({"md": tag("MD:Z:"), "nm": tag("NM:i:").cast("int"), "as_score": tag("AS:i:").cast("int")})


def parsed(lines: DataFrame, spark: SparkSession, header: Header) -> DataFrame:
    """The alignments of lines (value, ord); header lines and empty ones are left out."""
    lines = lines.where(~F.col("value").rlike(_HEADER_LINE) & (F.col("value") != ""))
    # get and try_cast: a filter may be evaluated before header lines are gone
    f = F.split("value", "\t")
    text = lambda k: F.get(f, F.lit(k))
    number = lambda k, kind: text(k).try_cast(kind)
    rows = lines.select(
        "ord",
        text(0).alias("qname"),
        number(1, "int").alias("flag"),
        text(2).alias("rname"),
        (number(3, "bigint") - 1).alias("pos0"),
        number(4, "int").alias("mapq"),
        text(5).alias("cigar"),
        text(6).alias("rnext"),
        number(7, "bigint").alias("pnext"),
        number(8, "bigint").alias("tlen"),
        text(9).alias("seq"),
        text(10).alias("qual"),
        F.slice(f, 12, 1 << 30).alias("tags"),
    )
    named = refs_frame(spark, header).select(F.col("tid").alias("_tid"), F.col("rname").alias("_name"))
    joined = rows.join(named, F.col("rname") == F.col("_name"), "left")
    lost = F.raise_error(F.concat(F.lit("Sequence '"), F.col("rname"), F.lit("' is not in the header"))).cast("int")
    tid = F.when(F.col("rname") == "*", F.lit(None).cast("int")).when(F.col("_tid").isNull(), lost).otherwise(F.col("_tid"))
    out = with_promoted_tags(joined.withColumn("tid", tid))
    return out.select("ord", "qname", "flag", "tid", "rname", "pos0", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual", "tags", "md", "nm", "as_score")


def read_sam(spark: SparkSession, path: str, header: Header | None = None) -> tuple[DataFrame, Header]:
    """(alignments, header), of plain or gzipped text (a gzipped file is one task's work). A record of a sequence that the header lacks is an error when it is read."""
    header = header or read_header(spark, path)
    return parsed(spark.read.text(path).select("value", input_order().alias("ord")), spark, header), header


def first_records(spark: SparkSession, path: str, header: Header, n: int) -> DataFrame:
    """The first n alignments; only as much of the file is read as holds them."""
    lines = [r.value for r in spark.read.text(path).head(len(header.lines) + n)]
    return parsed(spark.createDataFrame(list(enumerate(lines)), "ord bigint, value string"), spark, header)


def record_line(row) -> str:
    """A row as a SAM line."""
    pos = 0 if row.pos0 is None else row.pos0 + 1
    fields = [row.qname, row.flag, row.rname or "*", pos, row.mapq, row.cigar or "*", row.rnext or "*", row.pnext, row.tlen, row.seq or "*", row.qual or "*", *(row.tags or [])]
    return "\t".join(map(str, fields))


def sam_lines(df: DataFrame) -> DataFrame:
    """value: the SAM line of each row, for a text sink."""
    text = lambda c, default: F.coalesce(F.col(c).cast("string"), F.lit(default))
    core = F.concat_ws("\t", text("qname", "*"), text("flag", "0"), text("rname", "*"), F.coalesce(F.col("pos0") + 1, F.lit(0)).cast("string"), text("mapq", "0"), text("cigar", "*"), text("rnext", "*"), text("pnext", "0"), text("tlen", "0"), text("seq", "*"), text("qual", "*"), F.concat_ws("\t", F.coalesce("tags", F.array().cast("array<string>"))))
    return df.select(F.rtrim(core, F.lit("\t")).alias("value"))
