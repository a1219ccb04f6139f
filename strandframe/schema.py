"""Schemas and flag bits of the alignment data model."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# FLAG bits.
PAIRED, UNMAPPED, READ1, READ2, SECONDARY, SUPPLEMENTARY = 0x1, 0x4, 0x40, 0x80, 0x100, 0x800

#: ord is the input order; tid is null for RNAME '*'; tags are "TG:T:VALUE" in input order.
ALIGNMENT = (
    "ord BIGINT, qname STRING, flag INT, tid INT, rname STRING, pos0 BIGINT, mapq INT, cigar STRING, rnext STRING, pnext BIGINT, tlen BIGINT, "
    "seq STRING, qual STRING, tags ARRAY<STRING>, md STRING, nm INT, as_score INT"
)
REFS = "tid INT, rname STRING, tlen BIGINT"
GENOMES = "line_no BIGINT, genome STRING, rname STRING"


@dataclass(frozen=True)
class Header:
    """Header lines of an alignment file and its reference dictionary, in file order."""

    lines: tuple[str, ...]
    refs: tuple[tuple[str, int], ...]

    @property
    def sort_order(self) -> str | None:
        for line in self.lines:
            if line.startswith("@HD"):
                for field in line.split("\t")[1:]:
                    if field.startswith("SO:"):
                        return field[3:]
        return None


def has(bits: int) -> Column:
    return F.col("flag").bitwiseAND(F.lit(bits)) != 0


def mate_bucket() -> Column:
    """The mate bits of FLAG: 0, READ1, READ2 or both."""
    return F.col("flag").bitwiseAND(F.lit(READ1 | READ2))
