"""Site lists in BED: TAB-separated chrom, start, end; comment, track and browser lines are skipped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sites import expand

_U32 = r"^\+?[0-9]+$"


def ranges(lines: DataFrame) -> DataFrame:
    """(bed_line, value) rows to chrom, start, end, bed_line. A line without three fields or whole numbers of 32 bits fails the query, naming the line."""
    kept = lines.where(~(F.col("value") == "") & ~F.col("value").rlike("^(?:#|track|browser)")).withColumn("_f", F.split("value", "\t"))
    field = lambda i: F.get("_f", F.lit(i))
    number = lambda i: F.when(F.coalesce(field(i), F.lit("")).rlike(_U32), F.regexp_replace(field(i), r"^\+", "").try_cast("long"))
    bad = number(1).isNull() | number(2).isNull() | (number(1) > 4294967295) | (number(2) > 4294967295)
    checked = lambda x: F.when(bad, F.raise_error(F.concat(F.lit("malformed site list at line "), F.col("bed_line").cast("string")))).otherwise(x)
    return kept.select(field(0).alias("chrom"), checked(number(1)).cast("long").alias("start"), checked(number(2)).cast("long").alias("end"), "bed_line")


def read_sites(spark: SparkSession, path: str) -> DataFrame:
    """Sites of a BED file, with 1-based line numbers. The file is one partition's work: a list of positions is small against the reads."""
    numbered = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("i", "value"))
    lines = numbered.select((F.col("i") + 1).cast("long").alias("bed_line"), F.regexp_replace("value", "\r$", "").alias("value"))
    return expand(ranges(lines))
