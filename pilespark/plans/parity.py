"""Comparing two result texts: parse to long form, join, and measure agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import METRICS

KEYS = ("chrom", "pos", "base")


def parse_long(lines: DataFrame, value: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Result lines to rows chrom, pos, base and 13 doubles. Short lines and records, the '=' record and empty bases are left out."""
    parts = lines.withColumn("_p", F.split(value, "\t")).where(F.size("_p") >= 5)
    each = parts.select(*keep, F.get("_p", F.lit(0)).alias("chrom"), F.get("_p", F.lit(1)).cast("long").alias("pos"), F.explode(F.expr("slice(_p, 5, greatest(size(_p) - 4, 0))")).alias("_r"))
    fields = each.withColumn("_f", F.split("_r", ":")).where((F.size("_f") >= 14) & (F.get("_f", F.lit(0)) != "="))
    out = fields.select(*keep, "chrom", "pos", F.get("_f", F.lit(0)).alias("base"), *[F.get("_f", F.lit(i)).cast("double").alias(m) for i, m in enumerate(METRICS, 1)])
    return out.where(F.col("count") > 0)


def dedupe_first(long: DataFrame, keys: tuple[str, ...] = KEYS, order: tuple[str, ...] = ()) -> DataFrame:
    """One row for each key: the first by ``order``, or any where equal keys mean equal rows."""
    if not order:
        return long.dropDuplicates(list(keys))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return long.withColumn("_n", rank).where("_n = 1").drop("_n")


def joined(ours: DataFrame, theirs: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Inner join on the keys, with metrics prefixed rs_ and ref_; theirs is deduplicated, so that rows stay one to one."""
    name = lambda df, p: df.select(*keys, *[F.col(m).alias(p + m) for m in METRICS])
    return name(dedupe_first(theirs, keys), "ref_").join(name(ours, "rs_"), list(keys))


def _finite(m: str) -> Column:
    a, b = F.col("ref_" + m), F.col("rs_" + m)
    return a.isNotNull() & b.isNotNull() & ~F.isnan(a) & ~F.isnan(b) & (F.abs(a) < float("inf")) & (F.abs(b) < float("inf"))


def _half_even(x: Column) -> Column:
    return F.rint(x * 100) / 100


def statistics(pairs: DataFrame) -> DataFrame:
    """Agreement for each metric, from one scan: exact share, printed equality, deviation, bias and limits of agreement."""
    aggs = []
    for m, whole in METRICS.items():
        a, b = F.col("ref_" + m), F.col("rs_" + m)
        diff = F.when(_finite(m), a - b)
        same = F.when(_finite(m), ((a == b) if whole else (_half_even(a) == _half_even(b))).cast("double"))
        aggs.append(F.struct(
            F.lit(m).alias("metric"), F.lit("int" if whole else "float").alias("kind"), F.count(diff).alias("n_full"),
            (F.avg((diff == 0).cast("double")) * 100).alias("pct_delta_zero"), F.coalesce(F.avg(same) * 100, F.lit(100.0)).alias("pct_printed_eq"),
            F.max(F.abs(diff)).alias("max_abs_dev"), F.avg(F.abs(diff)).alias("mae"), F.avg(diff).alias("bias"),
            (F.coalesce(F.stddev_samp(diff), F.lit(0.0)) * 1.96).alias("loa_95"),
        ))
    return pairs.agg(F.array(*aggs).alias("rows")).select(F.explode("rows").alias("r")).select("r.*")


def pearson(pairs: DataFrame) -> DataFrame:
    """The older table: n, Pearson's r, MAE and the shares within 0.01 and exact."""
    aggs = []
    for m in METRICS:
        a, b = F.col("ref_" + m), F.col("rs_" + m)
        aggs.append(F.struct(F.lit(m).alias("metric"), F.count("*").alias("n"), F.corr(a, b).alias("pearson_r"), F.avg(F.abs(a - b)).alias("mae"), (F.avg((F.abs(a - b) <= 0.01).cast("double")) * 100).alias("pct_within_001"), (F.avg((a == b).cast("double")) * 100).alias("pct_exact")))
    return pairs.agg(F.array(*aggs).alias("rows")).select(F.explode("rows").alias("r")).select("r.*")


def density(pairs: DataFrame, x: str, y: str, low: float, high: float, bins: int = 120) -> DataFrame:
    """Counts of a two-dimensional histogram over [low, high); values at the upper edge fall in the last bin."""
    cell = lambda c: F.least(F.floor((F.col(c) - low) / ((high - low) / bins)), F.lit(bins - 1))
    return pairs.where(F.col(x).between(low, high) & F.col(y).between(low, high)).groupBy(cell(x).cast("long").alias("bx"), cell(y).cast("long").alias("by")).agg(F.count("*").alias("n"))


def sample_per_group(rows: DataFrame, group: str, keys: tuple[str, ...], size: int = 50, seed: int = 42) -> DataFrame:
    """``size`` rows of each group (all of a smaller one), drawn by a seeded hash of the keys."""
    drawn = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(drawn, *keys))
    return rows.withColumn("_n", rank).where(F.col("_n") <= size).drop("_n")


def missing(sites: DataFrame, results: DataFrame) -> DataFrame:
    """Sites without a result row."""
    return sites.select("chrom", "pos").distinct().join(results.select("chrom", "pos"), ["chrom", "pos"], "left_anti")
