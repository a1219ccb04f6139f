"""Small alignment files: qname flag rname pos cigar tags, and their reference lengths."""

FILES = {
    "filter": (
        "refA:1000",
        """
        clip80 0 refA 10 80M20S NM:i:0
        clip90 0 refA 20 90M10S NM:i:0
        del99 0 refA 30 50M1D49M NM:i:1
        id97 0 refA 40 100M NM:i:3
        id98 0 refA 50 100M NM:i:2
        ins99 0 refA 60 49M1I50M NM:i:1
        len80 0 refA 70 80M NM:i:0
        md99 0 refA 80 100M MD:Z:50A49
        md_precedence 0 refA 90 100M NM:i:10 MD:Z:100
        pairX 65 refA 100 100M NM:i:0
        pairX 129 refA 250 100M NM:i:3
        perfect100 0 refA 110 100M NM:i:0
        secondary98 256 refA 120 100M NM:i:2
        supp98 2048 refA 130 100M NM:i:2
        unmapped 4 * 0 *
        """,
    ),
    "cigar_eqx": (
        "A:1000",
        """
        md_eqx0 0 A 100 10X NM:i:10 MD:Z:0C0C0C0C0C0C0C0C0C0C0
        md_eqx100 0 A 200 100= NM:i:0 MD:Z:100
        md_eqx98 0 A 300 49=1X49=1X NM:i:2 MD:Z:49C49C0
        md_m0 0 A 400 10M NM:i:10 MD:Z:0C0C0C0C0C0C0C0C0C0C0
        md_m100 0 A 500 100M NM:i:0 MD:Z:100
        md_m98 0 A 600 100M NM:i:2 MD:Z:49C49C0
        nm_eqx90 256 A 700 10S44=1X44=1X NM:i:2
        nm_m90 256 A 800 10S90M NM:i:2
        """,
    ),
    "besthit": (
        "A:1000 B:1000 C:1000",
        """
        filterwin 0 A 100 100M AS:i:100 NM:i:10
        filterwin 256 B 200 100M AS:i:90 NM:i:0
        interleaved 65 A 100 100M AS:i:100 NM:i:0
        interleaved 129 A 300 100M AS:i:80 NM:i:0
        interleaved 321 B 200 100M AS:i:50 NM:i:0
        interleaved 385 B 400 100M AS:i:120 NM:i:0
        interleaved_tie 65 A 100 100M AS:i:100 NM:i:0
        interleaved_tie 129 A 300 100M AS:i:90 NM:i:0
        interleaved_tie 321 B 200 100M AS:i:100 NM:i:0
        interleaved_tie 385 B 400 100M AS:i:80 NM:i:0
        paired 65 A 100 100M AS:i:70 NM:i:0
        paired 321 B 200 100M AS:i:90 NM:i:0
        paired 129 A 300 100M AS:i:88 NM:i:0
        paired 385 B 400 100M AS:i:75 NM:i:0
        same_ref 0 A 100 100M AS:i:70 NM:i:0
        same_ref 256 A 200 100M AS:i:85 NM:i:0
        single 0 A 100 100M AS:i:80 NM:i:0
        tie2 0 A 100 100M AS:i:90 NM:i:0
        tie2 256 B 200 100M AS:i:90 NM:i:0
        tie3 0 A 100 100M AS:i:95 NM:i:0
        tie3 256 B 200 100M AS:i:95 NM:i:0
        tie3 256 C 300 100M AS:i:80 NM:i:0
        unique2 0 A 100 100M AS:i:80 NM:i:0
        unique2 256 B 200 100M AS:i:90 NM:i:0
        unique3 0 A 100 100M AS:i:70 NM:i:0
        unique3 256 B 200 100M AS:i:95 NM:i:0
        unique3 256 C 300 100M AS:i:80 NM:i:0
        """,
    ),
    "rescore": ("A:1000 B:1000", "rescore 0 A 100 100M AS:i:100 NM:i:10\nrescore 256 B 200 100M AS:i:50 NM:i:0"),
    "profile": (
        "A:1000 B:1000",
        """
        mmAB 0 A 500 10M
        mmAB 256 B 500 10M
        pairA 99 A 400 10M
        pairA 147 A 450 10M
        repA 0 A 100 10M
        repA 256 A 200 10M
        repA 256 A 300 10M
        uA1 0 A 10 10M
        uA2 0 A 20 10M
        uA3 0 A 30 10M
        uB1 0 B 40 10M
        """,
    ),
    "fractional": ("A:1000 B:1000 C:1000", "multi 0 A 100 10M\nmulti 256 B 100 10M\nmulti 256 C 100 10M\nuA 0 A 200 10M\nuB 0 B 300 10M"),
    "empty": ("A:1000 B:1000", ""),
    "unmapped": ("A:1000 B:1000", "unmapped1 4 * 0 *\nunmapped2 4 * 0 *"),
    "coverage": (
        "A:10 B:5 C:10 D:8",
        """
        a_first 0 A 1 1M NM:i:0
        a_last 0 A 10 1M NM:i:0
        a_mid1 0 A 3 4M NM:i:0
        a_mid2 0 A 5 3M NM:i:0
        c_last 0 C 10 1M NM:i:0
        d_del 0 D 1 2M1D2M NM:i:1
        d_ins 0 D 1 2M1I2M NM:i:1
        d_m 0 D 1 5M NM:i:0
        d_skip 0 D 1 2M1N2M NM:i:0
        unmapped 4 * 0 *
        """,
    ),
    "summary": (
        "A:1000",
        """
        edge 0 A 1 100M MD:Z:100 NM:i:0
        ins 0 A 401 50M2I48M MD:Z:98 NM:i:2
        mismatch 0 A 201 100M MD:Z:50A49 NM:i:1
        perfect 0 A 101 100M MD:Z:100 NM:i:0
        secondary 256 A 501 100M MD:Z:100 NM:i:0
        soft 0 A 301 10S90M MD:Z:90 NM:i:0
        supplementary 2048 A 601 100M MD:Z:100 NM:i:0
        """,
    ),
    "summary_edge": ("A:1000", "left_fail 0 A 10 100M MD:Z:100\nleft_pass 0 A 11 100M MD:Z:100\nright_pass 0 A 891 100M MD:Z:100\nright_fail 0 A 892 100M MD:Z:100"),
    "summary_count": ("A:1000", "mapped1 0 A 101 100M\nmulti 0 A 201 100M\nmulti 256 A 301 100M\npair 65 A 401 100M\npair 129 A 601 100M\nunmapped 4 * 0 *"),
    "integration": (
        "A:1000 B:1000",
        "filter_to_b 0 A 100 100M NM:i:10\nfilter_to_b 256 B 200 100M NM:i:0\nmulti 0 A 300 100M NM:i:0\nmulti 256 B 400 100M NM:i:0\nuA 0 A 500 100M NM:i:0\nuB 0 B 600 100M NM:i:0",
    ),
    "reopened": ("A:1000", "readA 0 A 10 10M\nreadB 0 A 20 10M\nreadA 256 A 30 10M"),
    "coordinate": ("A:1000", "read1 0 A 10 10M\nread2 0 A 20 10M"),
}
SORT_ORDER = {"reopened": None, "coordinate": "coordinate"}
_LONG = [f"{n:>03}_".ljust(n - 4, c) + e for n, c, e in ((127, "A", "AAAA"), (128, "B", "BBBB"), (254, "C", "CCCC"), (254, "C", "DDDD"))]
FILES["long_qname"] = ("A:1000 B:1000", "\n".join(f"{q} 0 {a} 100 10M AS:i:100\n{q} 256 {b} 200 10M AS:i:50" for q, (a, b) in zip(_LONG, ("AB", "AB", "AB", "BA"))))


def sam(name: str) -> str:
    refs, records = FILES[name]
    order = SORT_ORDER.get(name, "queryname")
    lines = ["@HD\tVN:1.6" + (f"\tSO:{order}" if order else "")]
    lines += [f"@SQ\tSN:{r.split(':')[0]}\tLN:{r.split(':')[1]}" for r in refs.split()]
    for record in records.split("\n"):
        if record.strip():
            qname, flag, rname, pos, cigar, *tags = record.split()
            lines.append("\t".join([qname, flag, rname, pos, "60" if rname != "*" else "0", cigar, "*", "0", "0", "*", "*", *tags]))
    return "\n".join(lines) + "\n"


def write(folder, name: str) -> str:
    path = folder / f"{name}.sam"
    path.write_text(sam(name))
    return str(path)
