"""Site lists: expansion of ranges, contig filter, chunks and duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Positions of a span in which sites are ranked on their own.
SPAN = 1 << 16


def expand(ranges: DataFrame) -> DataFrame:
    """chrom, start, end, bed_line -> sites: start = end is that 1-based position, else start+1 to end; none if start > end."""
    low = F.when(F.col("start") == F.col("end"), F.col("end")).otherwise(F.col("start") + 1)
    return ranges.where("start <= end").select("chrom", "bed_line", F.posexplode(F.sequence(low, F.col("end"))).alias("within_line", "pos")).selectExpr("chrom", "cast(pos AS bigint) pos", "bed_line", "cast(within_line AS bigint) within_line")


def known(sites: DataFrame, contigs: DataFrame) -> DataFrame:
    """Sites on contigs that the alignment header names; the others go without an error."""
    return sites.join(contigs.select("chrom"), "chrom", "left_semi")


def distinct(sites: DataFrame) -> DataFrame:
    return sites.groupBy("chrom", "pos").agg(F.min("bed_line").alias("bed_line"), F.min("within_line").alias("within_line"))


def chunks(sites: DataFrame, size: int = 200, gap: int = 50_000) -> DataFrame:
    """Adds island and chunk: a chunk ends at a contig's end, at ``size`` sites, or before a gap of more than ``gap``.

    Chunks plan file access and decide how duplicates share counts. Positions are counted in spans of a contig, spans along it, and sites
    ranked at their own position, so a task has a contig's spans or the positions of one, not a contig's sites.
    """
    inside, along = Window.partitionBy("chrom", "_span").orderBy("pos"), Window.partitionBy("chrom").orderBy("_span")
    upto = lambda c, w, end: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, end)), F.lit(0))
    far = lambda first, last, w: F.coalesce((F.col(first) - F.lag(last).over(w) > gap).cast("int"), F.lit(0))
    counted_ = sites.groupBy("chrom", "pos").agg(F.count("*").alias("_n")).withColumn("_span", F.expr(f"pos div {SPAN}")).withColumn("_far", far("pos", "pos", inside))
    spans = counted_.groupBy("chrom", "_span").agg(F.min("pos").alias("_first"), F.max("pos").alias("_last"), F.sum("_n").alias("_sites"), F.sum("_far").alias("_fars")).withColumn("_gap", far("_first", "_last", along))
    spans = spans.select("chrom", "_span", upto("_sites", along, -1).alias("_sites"), (upto("_gap", along, 0) + upto("_fars", along, -1)).alias("_islands"))
    placed = counted_.select("chrom", "_span", "pos", upto("_n", inside, -1).alias("_inside"), upto("_far", inside, 0).alias("_far")).join(spans, ["chrom", "_span"])
    placed = placed.select("chrom", "pos", (F.col("_islands") + F.col("_far")).alias("island"), (F.col("_sites") + F.col("_inside")).alias("_before"))
    starts = placed.groupBy("chrom", "island").agg(F.min("_before").alias("_start"))
    placed = placed.join(starts, ["chrom", "island"]).select("chrom", "pos", "island", (F.col("_before") - F.col("_start")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("chrom", "pos").orderBy("bed_line", "within_line"))
    return sites.join(placed, ["chrom", "pos"]).withColumn("_rank", F.col("_before") + rank - 1).select(*sites.columns, "island", F.expr(f"_rank div {size}").alias("chunk"))


def extents(chunked: DataFrame) -> DataFrame:
    """chrom, island, chunk, first, last: the least and greatest position of each chunk."""
    return chunked.groupBy("chrom", "island", "chunk").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))


def counted(chunked: DataFrame) -> DataFrame:
    """Adds counted: of equal sites in a chunk only the last gets counts, the others print as empty."""
    last = F.row_number().over(Window.partitionBy("chrom", "island", "chunk", "pos").orderBy(F.desc("bed_line"), F.desc("within_line")))
    return chunked.withColumn("counted", last == 1)
