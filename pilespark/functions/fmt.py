"""Text output: exact two-decimal numbers and the colon-delimited records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import BASES, METRICS

_SCALE = float(1 << 20)


def fmt2(x: Column) -> Column:
    """Two decimals of a double's exact binary value, ties to even, as C prints it; for 0 <= x < 2**25.

    The double is split into a multiple of 2**-20 and a rest, whose hundredfolds are exact, so no decimal shortening comes between.
    """
    x = x.cast("double")
    high = F.floor(x * _SCALE) / F.lit(_SCALE)
    n = F.floor(high * 100)
    excess, rest = F.lit(0.5) - (high * 100 - n), (x - high) * 100
    n = F.when(rest > excess, n + 1).when(rest < excess, n).otherwise(n + n % 2)
    return F.concat(((n - n % 100) / 100).cast("long").cast("string"), F.lit("."), F.lpad((n % 100).cast("string"), 2, "0"))


def _zero(label: Column) -> Column:
    return F.concat_ws(":", label, *[F.lit("0" if whole else "0.00") for whole in METRICS.values()])


def record(label: Column, metrics: Column) -> Column:
    """``label`` and the metrics of a struct, joined by colons; the constant zero record where the count is 0."""
    parts = [metrics[m].cast("string") if whole else fmt2(metrics[m]) for m, whole in METRICS.items()]
    return F.when(F.coalesce(metrics["count"], F.lit(0)) == 0, _zero(label)).otherwise(F.concat_ws(":", label, *parts))


def line() -> Column:
    """One output line of a wide row: chrom, pos, ref_base, depth, the constant zero record and one for each base.

    The records are formatted by one lambda over the five bases, which keeps generated code small.
    """
    lead = [F.col("chrom"), F.col("pos").cast("string"), F.col("ref_base"), F.col("depth").cast("string"), _zero(F.lit("="))]
    bases = F.array(*[F.struct(F.lit(b).alias("label"), F.col(b).alias("metrics")) for b in BASES])
    return F.concat_ws("\t", *lead, F.transform(bases, lambda x: record(x["label"], x["metrics"])))


def human_count(n: Column) -> Column:
    """A count as report tables show it: whole below a thousand, else in k, M (one decimal) or B (two)."""
    scaled = [(1e9, "%.2fB"), (1e6, "%.1fM"), (1e3, "%.0fk")]
    return F.coalesce(*[F.when(n >= unit, F.format_string(form, n / unit)) for unit, form in scaled], n.cast("string"))
