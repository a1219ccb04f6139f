"""What made an output: the @PG line of SAM/BAM and the comments of a profile."""

from __future__ import annotations

import shlex
from dataclasses import replace

from strandframe import VERSION
from strandframe.operators.qname import QNameCheck
from strandframe.schema import Header

PROGRAM = "strandframe"
COMMIT = "unknown"


def command_line(arguments: list[str]) -> str:
    return " ".join([PROGRAM, *map(shlex.quote, arguments)])


def _programs(header: Header) -> list[dict[str, str]]:
    return [dict(f.split(":", 1) for f in line.split("\t")[1:] if ":" in f) for line in header.lines if line.startswith("@PG\t")]


def add_program(header: Header, arguments: list[str], check: QNameCheck) -> Header:
    """The header with one more @PG line, at the end of the chain of programs; the input's own isn't changed."""
    known = _programs(header)
    taken, name, n = {p.get("ID") for p in known}, PROGRAM, 0
    while name in taken:
        n += 1
        name = f"{PROGRAM}.{n}"
    followed = {p.get("PP") for p in known}
    last = [p["ID"] for p in known if "ID" in p and p["ID"] not in followed]
    fields = [f"ID:{name}", f"PN:{PROGRAM}", *([f"PP:{last[-1]}"] if last else []), f"VN:{VERSION}", f"CL:{command_line(arguments)}", f"DS:git={COMMIT}; {check.message}"]
    return replace(header, lines=(*header.lines, "@PG\t" + "\t".join(f.replace("\t", " ") for f in fields)))


def profile_comments(arguments: list[str], check: QNameCheck) -> list[str]:
    return [f"# {PROGRAM} version: {VERSION}", f"# {PROGRAM} git commit: {COMMIT}", f"# Command line: {command_line(arguments)}", f"# {check.message}"]
