"""Observations to metrics. All metrics are sums and counts, so tasks aggregate partially before the shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import BASES, METRICS, PileupConfig
from . import observe
from .overlay import DOUBLES, WHOLE

def per_base(reads: DataFrame, sites: DataFrame, config: PileupConfig) -> DataFrame:
    """Metrics for each (chrom, pos, base) that has observations."""
    parts = observe.sums(reads, sites, config)
    t = parts.groupBy("chrom", "pos", "base").agg(*[F.sum(c).alias(c) for c in (*WHOLE, *DOUBLES)])
    mean = lambda c: F.col(c) / F.col("n")
    values = {
        "count": F.col("n"),
        "avg_mapping_quality": mean("mapq"),
        "avg_basequality": mean("base_qual"),
        "avg_se_mapping_quality": mean("se_mapq"),
        "num_plus_strand": F.col("n") - F.col("minus"),
        "num_minus_strand": F.col("minus"),
        "avg_pos_as_fraction": mean("pos_as_fraction"),
        "avg_num_mismatches_as_fraction": mean("mismatch_fraction"),
        "avg_sum_mismatch_qualities": mean("sum_mismatch_quals"),
        "num_q2_containing_reads": F.col("q2"),
        "avg_distance_to_q2_start_in_q2_reads": F.when(F.col("q2") == 0, 0.0).otherwise(F.col("q2_distance") / F.greatest("q2", F.lit(1))),
        "avg_clipped_length": mean("clipped_len"),
        "avg_distance_to_effective_3p_end": mean("distance_to_3p_end"),
    }
    return t.select("chrom", "pos", "base", *[values[m].alias(m) for m in METRICS])


def wide(metrics: DataFrame) -> DataFrame:
    """One row per (chrom, pos): depth and a struct of metrics for each of A, C, G, T, N, null where there are none."""
    pick = [F.max(F.when(F.col("base") == b, F.struct(*METRICS))).alias(b) for b in BASES]
    return metrics.groupBy("chrom", "pos").agg(F.sum("count").alias("depth"), *pick)


def fill(wide_rows: DataFrame) -> DataFrame:
    """Zero metrics for bases and sites without observations."""
    zero = F.struct(*[(F.lit(0).cast("long") if whole else F.lit(0.0)).alias(m) for m, whole in METRICS.items()])
    return wide_rows.withColumns({"depth": F.coalesce("depth", F.lit(0)), **{b: F.coalesce(b, zero) for b in BASES}})
