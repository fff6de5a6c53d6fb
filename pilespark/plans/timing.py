"""Run times: durations in text, scheduler traces and cohort summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def seconds(text: Column) -> Column:
    """Sum of a duration's parts (ms, s, m, h) in seconds; null where there are none."""
    part = r"([0-9.]+)\s*(ms|s|m|h)"
    numbers, units = F.regexp_extract_all(text, F.lit(part), F.lit(1)), F.regexp_extract_all(text, F.lit(part), F.lit(2))
    scale = lambda u: F.when(u == "ms", 0.001).when(u == "s", 1.0).when(u == "m", 60.0).otherwise(3600.0)
    total = F.aggregate(F.zip_with(numbers, units, lambda n, u: n.try_cast("double") * scale(u)), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(numbers) > 0, total)


def trace_max(trace: DataFrame, token: str) -> DataFrame:
    """sample_id and the longest realtime of its finished tasks whose name holds ``token``; the id stands in parentheses."""
    rows = trace.select(F.regexp_extract("name", r"\(([^)]+)\)", 1).alias("sample_id"), seconds(F.col("realtime")).alias("s"), "name", "status")
    kept = rows.where(F.col("name").contains(token) & F.col("status").isin("COMPLETED", "CACHED") & (F.col("sample_id") != "") & F.col("s").isNotNull())
    return kept.groupBy("sample_id").agg(F.max("s").alias("realtime_s"))


def anonymised(rows: DataFrame, cohort: str = "cohort") -> DataFrame:
    """Adds label cohort_1.. in alphabetical order. Ranks run over the distinct names, a row for each cohort."""
    names = rows.select(cohort).where(F.col(cohort).isNotNull()).distinct()
    labels = names.withColumn("label", F.concat(F.lit("cohort_"), F.dense_rank().over(Window.orderBy(cohort)).cast("string")))
    return rows.join(labels, cohort, "left")


def label_number(label: Column) -> Column:
    """The number that a label ends with, by which labels are listed: cohort_2 before cohort_10."""
    return F.regexp_extract(label, "([0-9]+)$", 1).try_cast("long")


def cohort_summary(rows: DataFrame, cohort: str, slow: str, fast: str) -> DataFrame:
    """Medians, linear quartiles and sizes by cohort, and the median of the rows' ratios (not the ratio of medians)."""
    a, b = F.col(slow), F.col(fast)
    return rows.where(a.isNotNull() & b.isNotNull()).groupBy(cohort).agg(
        F.count("*").alias("n"), F.median(a).alias("slow_median"), F.median(b).alias("fast_median"),
        F.percentile(a, 0.25).alias("slow_q1"), F.percentile(a, 0.75).alias("slow_q3"), F.median(a / b).alias("median_speedup"),
    ).orderBy(F.desc("slow_median"))
