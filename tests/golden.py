"""Thirteen invented reads, and the sites and output lines that they must give: these two are fixed golden values of the format."""

SITES = "chr1\t924730\t924730\nchr1\t930299\t930299\nchr1\t944753\t944753\n"
_R05, _R11 = "30x20 5x1 30x19 22x1 30x9", "30x20 5x1 30x9 22x1 30x19"
#: name, flag, POS, mapq, CIGAR, qualities, (index, base) other than A, NM, MD, SM.
READS = [
    ("r01", 0, 924696, 60, "50M", "23x50", (34, "T"), 1, "34C15", None), ("r02", 16, 930289, 60, "2S48M", "32x50", None, 1, "10C37", None),
    ("r03", 0, 930261, 60, "50M", "30x18 2x32", (38, "C"), 4, "20A0A3A4A19", None), ("r04", 19, 944720, 60, "50M", "32x50", None, 1, "33G16", 60),
    ("r05", 0, 944713, 60, "50M", _R05, (40, "G"), 1, "20A29", None), ("r06", 0, 944713, 60, "50M", _R05, (40, "G"), 1, "20A29", None), ("r07", 0, 944713, 60, "50M", _R05, (40, "G"), 1, "20A29", None),
    ("r08", 0, 944715, 60, "50M", "30x20 5x1 30x17 22x1 30x11", (38, "G"), 1, "20A29", None), ("r09", 16, 944745, 60, "50M", "2x1 30x7 22x1 30x11 5x1 30x29", (8, "G"), 1, "20A29", None),
    ("r10", 16, 944714, 60, "50M", "2x1 30x19 5x1 30x18 22x1 30x10", (39, "G"), 1, "20A29", None), ("r11", 16, 944723, 60, "50M", _R11, (30, "G"), 1, "20A29", None),
    ("r12", 16, 944723, 60, "50M", _R11, (30, "G"), 1, "20A29", None), ("r13", 16, 944723, 1, "50M", "30x20 4x1 30x9 25x1 30x19", (30, "G"), 1, "20A29", None),
]
RECORDS = [
    ("chr1\t924730\tC\t1", {"T": "T:1:60.00:23.00:60.00:1:0:0.64:0.02:23.00:1:0.28:50.00:0.28"}),
    ("chr1\t930299\tC\t2", {"A": "A:1:60.00:32.00:60.00:0:1:0.42:0.02:32.00:0:0.00:48.00:0.20", "C": "C:1:60.00:2.00:60.00:1:0:0.48:0.08:6.00:1:0.44:50.00:0.44"}),
    ("chr1\t944753\tG\t10", {"A": "A:1:60.00:32.00:60.00:0:1:0.68:0.02:32.00:0:0.00:50.00:0.66", "G": "G:9:53.44:22.33:53.44:4:5:0.54:0.02:4.89:6:0.27:50.00:0.38"}),
]
ZERO = ":0:0.00:0.00:0.00:0:0:0.00:0.00:0.00:0:0.00:0.00:0.00"


def lines() -> list[str]:
    return ["\t".join([lead, "=" + ZERO, *(by.get(b, b + ZERO) for b in "ACGTN")]) for lead, by in RECORDS]


def quals(text: str) -> list[int]:
    return [int(q) for part in text.split() for q, n in [part.split("x")] for _ in range(int(n))]


def rows() -> list[tuple]:
    out = []
    for i, (name, flag, pos, mapq, cigar, qual, other, nm, md, sm) in enumerate(sorted(READS, key=lambda r: r[2])):
        seq = ["A"] * 50
        if other:
            seq[other[0]] = other[1]
        out.append((i, name, flag, "chr1", pos - 1, mapq, cigar, "".join(seq), quals(qual), nm, md, sm))
    return out


def sam() -> str:
    head = "@HD\tVN:1.6\n@SQ\tSN:chr1\tLN:1000000\n"
    tag = lambda r: f"\tNM:i:{r[9]}\tMD:Z:{r[10]}" + (f"\tSM:i:{r[11]}" if r[11] is not None else "")
    return head + "".join("\t".join(map(str, (r[1], r[2], r[3], r[4] + 1, r[5], r[6], "*", 0, 0, r[7], "".join(chr(q + 33) for q in r[8])))) + tag(r) + "\n" for r in rows())
