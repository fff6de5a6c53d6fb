"""Reference bases from tiles of the genome."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TILE = 4096


def with_ref_base(sites: DataFrame, tiles: DataFrame, tile: int = TILE) -> DataFrame:
    """Adds ref_base, ASCII letters in upper case; N past the end. Sites of contigs that the reference lacks go without an error."""
    placed = sites.join(tiles.select("chrom").distinct(), "chrom", "left_semi").withColumn("_tile", F.expr(f"(pos - 1) div {tile} * {tile}L"))
    found = placed.join(tiles.withColumnRenamed("start0", "_tile"), ["chrom", "_tile"], "left")
    base = F.expr("CASE WHEN pos < 1 THEN NULL ELSE nullif(translate(substring(seq, cast(pos - _tile AS int), 1), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '') END")
    return found.withColumn("ref_base", F.coalesce(base, F.lit("N"))).drop("_tile", "seq")
