"""Counts over shards of reads that keep arriving: each batch adds partial sums, which merge because all metrics are sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import observe
from ..schema import PileupConfig

SUMS = ("mapq", "base_qual", "se_mapq", "pos_as_fraction", "mismatch_fraction", "sum_mismatch_quals", "q2_distance", "clipped_len", "distance_to_3p_end")


def partial_sums(reads: DataFrame, sites: DataFrame, config: PileupConfig) -> DataFrame:
    obs = observe.observations(reads, sites, config)
    return obs.groupBy("chrom", "pos", "base").agg(F.count("*").alias("n"), F.count_if("is_reverse").alias("minus"), F.count("q2_distance").alias("q2"), *[F.coalesce(F.sum(c), F.lit(0)).cast("double").alias(c) for c in SUMS])


def start(reads: DataFrame, sites: DataFrame, path: str, checkpoint: str, config: PileupConfig = PileupConfig()):  # noqa: ANN201, B008
    """Streams reads to partial sums under path, one folder for each batch, so a repeated batch overwrites itself. No depth cap: it needs file order."""
    write = lambda batch, epoch: partial_sums(batch, sites, config).write.mode("overwrite").parquet(f"{path}/batch={epoch}")
    return reads.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()


def merged(partials: DataFrame) -> DataFrame:
    """Metrics of all batches so far."""
    t = partials.groupBy("chrom", "pos", "base").agg(*[F.sum(c).alias(c) for c in ("n", "minus", "q2", *SUMS)])
    mean = lambda c: (F.col(c) / F.col("n"))
    return t.select(
        "chrom", "pos", "base", F.col("n").alias("count"), mean("mapq").alias("avg_mapping_quality"), mean("base_qual").alias("avg_basequality"), mean("se_mapq").alias("avg_se_mapping_quality"),
        (F.col("n") - F.col("minus")).alias("num_plus_strand"), F.col("minus").alias("num_minus_strand"), mean("pos_as_fraction").alias("avg_pos_as_fraction"), mean("mismatch_fraction").alias("avg_num_mismatches_as_fraction"),
        mean("sum_mismatch_quals").alias("avg_sum_mismatch_qualities"), F.col("q2").alias("num_q2_containing_reads"), F.when(F.col("q2") == 0, 0.0).otherwise(F.col("q2_distance") / F.greatest("q2", F.lit(1))).alias("avg_distance_to_q2_start_in_q2_reads"),
        mean("clipped_len").alias("avg_clipped_length"), mean("distance_to_3p_end").alias("avg_distance_to_effective_3p_end"),
    )
