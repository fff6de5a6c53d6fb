"""Per-read and per-observation expressions. All are built-in functions, so they run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DUPLICATE_SECONDARY_QCFAIL_UNMAPPED = 0x704
REVERSE, PROPER_PAIR = 0x10, 0x2
CIGAR = "([0-9]+)([MIDNSHP=X])"
MD = r"([0-9]+|\^[A-Za-z]+|[A-Za-z])"


def cigar_ops(cigar: Column) -> Column:
    """Array of (op, len)."""
    return F.arrays_zip(F.regexp_extract_all(cigar, F.lit(CIGAR), F.lit(2)).alias("op"), F.transform(F.regexp_extract_all(cigar, F.lit(CIGAR), F.lit(1)), lambda n: n.cast("int")).alias("len"))


def soft_clip(ops: Column, left: bool) -> Column:
    """Length of the soft clip at one end, which a hard clip may precede. A lone S counts at both ends."""
    end, next_ = (F.try_element_at(ops, F.lit(i if left else -i)) for i in (1, 2))
    return F.when(end["op"] == "S", end["len"]).when((end["op"] == "H") & (next_["op"] == "S"), next_["len"]).otherwise(0)


def segments(ops: Column, pos0: Column) -> Column:
    """Aligned stretches: array of (ref0, q0, len, a0), a0 being the number of aligned bases before."""
    start = F.struct(F.lit(0).alias("q"), pos0.cast("long").alias("r"), F.lit(0).alias("a"), F.array().cast("array<struct<ref0:bigint,q0:int,len:int,a0:int>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        match, read, ref = x["op"].isin("M", "=", "X"), x["op"].isin("I", "S"), x["op"].isin("D", "N")
        return F.struct(
            F.when(match | read, s["q"] + x["len"]).otherwise(s["q"]).alias("q"),
            F.when(match | ref, s["r"] + x["len"]).otherwise(s["r"]).alias("r"),
            F.when(match, s["a"] + x["len"]).otherwise(s["a"]).alias("a"),
            F.when(match, F.concat(s["out"], F.array(F.struct(s["r"].alias("ref0"), s["q"].alias("q0"), x["len"].alias("len"), s["a"].alias("a0"))))).otherwise(s["out"]).alias("out"),
        )

    return F.aggregate(ops, start, step, lambda s: s["out"])


def reference_span(ops: Column) -> Column:
    return F.aggregate(F.filter(ops, lambda x: x["op"].isin("M", "=", "X", "D", "N")), F.lit(0).cast("long"), lambda s, x: s + x["len"])


def is_reverse(flag: Column) -> Column:
    return flag.bitwiseAND(REVERSE) != 0


def q2_pos(qual: Column, reverse: Column) -> Column:
    """One before the first quality that is not 2, seen from the 3' end: -1 where there is none (or it is the first base)."""
    not2 = lambda q: F.array_position(F.transform(q, lambda x: x != 2), True).cast("int")
    fwd, rev = not2(F.reverse(qual)), not2(qual)
    return F.when(reverse, F.when(rev == 0, -1).otherwise(rev - 2)).otherwise(F.when(fwd == 0, -1).otherwise(F.size(qual) - fwd - 1))


def three_prime_index(reverse: Column, l_qseq: Column, left: Column, right_edge: Column, q2: Column) -> Column:
    t = F.least(l_qseq - 1, right_edge)
    return F.when(reverse, F.greatest(F.lit(0), left, q2)).otherwise(F.when((q2 != -1) & (t > q2), q2).otherwise(t))


def se_mapq(flag: Column, mapq: Column, sm: Column) -> Column:
    return F.when(flag.bitwiseAND(PROPER_PAIR) != 0, F.when(sm.isNotNull(), F.least(F.greatest(sm, F.lit(0)), F.lit(255)))).otherwise(mapq)


def mismatch_indices(md: Column) -> Column:
    """Aligned-base numbers of an MD tag's mismatches."""
    start = F.struct(F.lit(0).alias("a"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, t: Column) -> Column:
        number, gap = t.rlike("^[0-9]"), t.startswith("^")
        return F.struct(
            F.when(number, s["a"] + F.when(number, t).otherwise("0").cast("int")).when(gap, s["a"]).otherwise(s["a"] + 1).alias("a"),
            F.when(number | gap, s["out"]).otherwise(F.concat(s["out"], F.array(s["a"]))).alias("out"),
        )

    return F.aggregate(F.regexp_extract_all(F.coalesce(md, F.lit("")), F.lit(MD), F.lit(1)), start, step, lambda s: s["out"])


def sum_mismatch_quals(md: Column, segs: Column, qual: Column) -> Column:
    """Sum, over runs of mismatches at neighbouring read positions, of the run's greatest quality."""
    at = F.flatten(F.transform(mismatch_indices(md), lambda m: F.transform(F.filter(segs, lambda g: (g["a0"] <= m) & (m < g["a0"] + g["len"])), lambda g: g["q0"] + m - g["a0"])))
    start = F.struct(F.lit(-2).alias("last"), F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("done"))

    def step(s: Column, i: Column) -> Column:
        q = F.coalesce(F.get(qual, i), F.lit(0)).cast("long")
        joined = i == s["last"] + 1
        return F.struct(i.alias("last"), F.when(joined, F.greatest(s["run"], q)).otherwise(q).alias("run"), F.when(joined, s["done"]).otherwise(s["done"] + s["run"]).alias("done"))

    return F.when(md.isNull() | (md == ""), F.lit(0).cast("long")).otherwise(F.aggregate(at, start, step, lambda s: s["done"] + s["run"]))


def pos_as_fraction(qpos: Column, left: Column, clipped: Column) -> Column:
    half = clipped.cast("double") / 2
    return F.when(clipped == 0, F.lit(0.0)).otherwise(1 - F.abs((qpos - left) - half) / half)


def mismatch_fraction(nm: Column, clipped: Column) -> Column:
    return F.when(clipped == 0, F.lit(0.0)).otherwise(nm.cast("double") / clipped)


def q2_distance(qpos: Column, q2: Column, l_qseq: Column) -> Column:
    return F.when(q2 > -1, F.abs(qpos - q2).cast("double") / F.greatest(F.lit(1), l_qseq))


def distance_to_3p_end(qpos: Column, index: Column, l_qseq: Column) -> Column:
    return F.abs(qpos - index).cast("double") / F.greatest(F.lit(1), l_qseq)


def base_label(base: Column) -> Column:
    up = F.upper(base)
    return F.when(up.isin("A", "C", "G", "T"), up).otherwise("N")
