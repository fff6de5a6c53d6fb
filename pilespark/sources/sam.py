"""SAM text: header contigs and reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def contigs(lines: DataFrame) -> DataFrame:
    """chrom, tid, len of the @SQ lines of a header; rows are (ord, value)."""
    sq = lines.where(F.col("value").startswith("@SQ"))
    rows = sq.select("ord", F.regexp_extract("value", "\tSN:([^\t]+)", 1).alias("chrom"), F.regexp_extract("value", "\tLN:([0-9]+)", 1).cast("long").alias("len"))
    from pyspark.sql.window import Window

    return rows.select("chrom", (F.row_number().over(Window.orderBy("ord")) - 1).alias("tid"), "len")


def reads(lines: DataFrame) -> DataFrame:
    """Read rows of (ord, value) lines; ord is the file order. Missing qualities become 255 for every base; unusable NM counts as absent."""
    f = F.split("value", "\t")
    rows = lines.where(~F.col("value").startswith("@") & (F.col("value") != "")).select("ord", f.alias("f"))
    at = lambda i: F.get("f", F.lit(i))
    tags = F.slice("f", 12, 1_000_000)
    tag = lambda p: F.regexp_extract(F.coalesce(F.get(F.filter(tags, lambda t: t.startswith(p)), F.lit(0)), F.lit("")), "^..:.:(.*)$", 1)
    number = lambda p: F.when(tag(p + ":i:") != "", tag(p + ":i:").try_cast("long"))
    quals = F.when(at(10) == "*", F.array_repeat(F.lit(255), F.when(at(9) == "*", 0).otherwise(F.length(at(9))))).otherwise(F.transform(F.filter(F.split(at(10), ""), lambda c: c != ""), lambda c: F.ascii(c) - 33))
    return rows.select(
        "ord", at(0).alias("qname"), at(1).cast("int").alias("flag"), at(2).alias("chrom"), (at(3).cast("long") - 1).alias("pos0"), at(4).cast("int").alias("mapq"), at(5).alias("cigar"), at(9).alias("seq"),
        quals.alias("qual"), number("NM").alias("nm"), F.when(tag("MD:Z:") != "", tag("MD:Z:")).alias("md"), number("SM").cast("int").alias("sm"),
    )


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(ord, value): lines of one or more files, numbered so that order within a file holds."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("ord"), "value")
