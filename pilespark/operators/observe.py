"""Reads to observations: filters, per-read columns and the join of reads with sites, which overlay.py ends in Arrow batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernel as K
from ..schema import PileupConfig
from . import overlay
from .overlay import BIN, WORDS

#: Bins of sites up to which they are broadcast: about 100 bytes each.
BROADCAST_BINS = 1_000_000


def usable(reads: DataFrame, config: PileupConfig) -> DataFrame:
    """Drops unmapped, secondary, failed and duplicate reads, those of low mapping quality and those without a position. Supplementary ones stay."""
    return reads.where((F.col("flag").bitwiseAND(K.DUPLICATE_SECONDARY_QCFAIL_UNMAPPED) == 0) & (F.col("mapq") >= config.min_mapq) & (F.col("pos0") >= 0))


def scan(reads: DataFrame) -> DataFrame:
    """The per-read columns, computed once before reads are joined with sites."""
    base = reads.withColumn("ops", K.cigar_ops(F.col("cigar"))).withColumn("l_qseq", F.when(F.col("seq") == "*", 0).otherwise(F.length("seq")))
    base = base.withColumn("is_reverse", K.is_reverse(F.col("flag"))).withColumn("left_clip", K.soft_clip(F.col("ops"), True)).withColumn("right_clip", K.soft_clip(F.col("ops"), False))
    base = base.withColumn("clipped_length", F.greatest(F.lit(0), F.col("l_qseq") - F.col("left_clip") - F.col("right_clip"))).withColumn("right_edge", F.greatest(F.lit(0), F.col("l_qseq") - F.col("right_clip")))
    base = base.withColumn("segs", K.segments(F.col("ops"), F.col("pos0"))).withColumn("q2_pos", K.q2_pos(F.col("qual"), F.col("is_reverse")))
    return base.select(
        "ord", "chrom", "pos0", "mapq", "flag", "seq", "qual", "l_qseq", "left_clip", "right_clip", "clipped_length", "q2_pos", "is_reverse", "segs",
        F.greatest(F.coalesce("nm", F.lit(0)), F.lit(0)).cast("long").alias("nm"),
        K.three_prime_index(F.col("is_reverse"), F.col("l_qseq"), F.col("left_clip"), F.col("right_edge"), F.col("q2_pos")).alias("three_prime_index"),
        K.sum_mismatch_quals(F.col("md"), F.col("segs"), F.col("qual")).alias("sum_mismatch_quals"),
        K.se_mapq(F.col("flag"), F.col("mapq"), F.col("sm")).alias("se_mapq"),
    )


def over_bins(reads: DataFrame, sites: DataFrame, config: PileupConfig) -> DataFrame:
    """Usable reads, once for each bin of positions that they span and that has sites, with the bin's sites as bits. Equal sites count once."""
    rows = usable(reads, config).select("ord", "chrom", F.col("pos0").cast("long").alias("pos0"), "mapq", "flag", "cigar", "seq", "qual", "nm", "md", "sm")
    span = F.expr("aggregate(regexp_extract_all(cigar, '([0-9]+)[MDN=X]', 1), 0L, (s, n) -> s + cast(n AS bigint))")
    # No filter on the span, and no explode, which Spark would give one: pushed down, it has CIGAR texts made and read twice. A read without a span has no bin.
    each = rows.withColumn("_span", span).withColumn("bin", F.explode_outer(F.expr(f"if(_span > 0, sequence(pos0 div {BIN}, (pos0 + _span - 1) div {BIN}), NULL)"))).drop("_span")
    at = sites.where("pos > 0").select("chrom", F.expr(f"(pos - 1) div {BIN}").alias("bin"), F.expr(f"(pos - 1) % {BIN}").alias("_at"))
    bits = at.groupBy("chrom", "bin").agg(*[F.expr(f"bit_or(if(_at div 64 = {i}, shiftleft(1L, cast(_at % 64 AS int)), 0L))").alias(w) for i, w in enumerate(WORDS)])
    # Counted, not estimated: a list of many repeated sites looks large, and all reads would be exchanged for it.
    few = bits.limit(BROADCAST_BINS + 1).count() <= BROADCAST_BINS
    return each.join(F.broadcast(bits) if few else bits, ["chrom", "bin"])


def records(reads: DataFrame, sites: DataFrame, config: PileupConfig) -> DataFrame:
    """What each read has over sites, gathered by small bins of positions and sorted there in file order."""
    rows = over_bins(reads, sites, config).mapInArrow(overlay.pack(config), overlay.RECORD_SCHEMA)
    return rows.repartition("chrom", "small").sortWithinPartitions("chrom", "small", "ord", "record")


def in_order(config: PileupConfig) -> bool:
    """Whether results depend on the order of reads."""
    return config.exact or config.max_depth < PileupConfig.max_depth


def sums(reads: DataFrame, sites: DataFrame, config: PileupConfig) -> DataFrame:
    """Counts and sums over observations, of which each (chrom, pos, base) may have several rows."""
    if in_order(config):
        return records(reads, sites, config).mapInArrow(overlay.ordered_sums(config), overlay.SUMS_SCHEMA)
    return over_bins(reads, sites, config).mapInArrow(overlay.sums(config), overlay.SUMS_SCHEMA)


def observations(reads: DataFrame, sites: DataFrame, config: PileupConfig, columns: tuple[str, ...] = tuple(overlay.ROW)) -> DataFrame:
    """One row for each read and site that one of its bases is aligned to, with ``columns``; deletions and skips give none."""
    schema = ", ".join(f"{c} {overlay.ROW[c]}" for c in columns)
    if config.max_depth < PileupConfig.max_depth:
        return records(reads, sites, config).mapInArrow(overlay.rows("records", config, list(columns)), schema)
    return over_bins(reads, sites, config).mapInArrow(overlay.rows("reads", config, list(columns)), schema)
