"""The query: sites, reads and reference in, metrics or text lines out. All is lazy; Catalyst plans it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fmt
from ..operators import aggregate, reference, sites as S
from ..schema import BASES, PileupConfig


def pileup(reads: DataFrame, sites: DataFrame, contigs: DataFrame, tiles: DataFrame, config: PileupConfig = PileupConfig()) -> DataFrame:  # noqa: B008
    """One row per site of a known contig: chrom, pos, ref_base, depth and a metrics struct for each base, unordered."""
    wanted = S.known(sites, contigs)
    once = S.distinct(wanted)
    found = aggregate.wide(aggregate.per_base(reads, once, config))
    if config.duplicates == "last":
        rows = S.counted(S.chunks(wanted)).select("chrom", "pos", "bed_line", "within_line", "counted")
    else:
        rows = once.withColumn("counted", F.lit(True))
    joined = rows.join(found, ["chrom", "pos"], "left")
    if config.duplicates == "last":
        joined = joined.withColumns({c: F.when(F.col("counted"), F.col(c)) for c in ("depth", *BASES)})
    return reference.with_ref_base(aggregate.fill(joined), tiles)


def lines(wide: DataFrame) -> DataFrame:
    """Text lines in order of contig (bytewise) and position."""
    return wide.orderBy("chrom", "pos", "bed_line", "within_line").select(fmt.line().alias("value"))
