"""Tables of the comparison toolkit: result pairs by sample, run metrics, traces and their sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUN_METRICS = "sample_id string, bed_lines long, ref_lines long, rs_lines long, rs_bytes long, rs_wall_s double, rs_peak_rss_kb double, cohort string"


def sources(spark: SparkSession) -> None:
    """Registers the bam and fasta formats."""
    from .bam import BamDataSource
    from .fasta import FastaDataSource

    spark.dataSource.register(BamDataSource)
    spark.dataSource.register(FastaDataSource)


def result_lines(spark: SparkSession, pattern: str) -> DataFrame:
    """(sample_id, value): lines of the files that a glob names; the sample is the file's folder."""
    lines = spark.read.text(pattern)
    return lines.select(F.regexp_extract(F.input_file_name(), "([^/]+)/[^/]+$", 1).alias("sample_id"), "value")


def listing(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, size) of the files that a glob names, in order of their paths."""
    files = spark.read.format("binaryFile").load(pattern).select("path", F.col("length").alias("size"))
    return files.orderBy("path")


def status(samples: DataFrame, done: DataFrame, excluded: DataFrame) -> DataFrame:
    """sample_id and status: excluded, done or pending, the first that holds."""
    mark = lambda df, name: df.select("sample_id").distinct().withColumn(name, F.lit(True))
    rows = samples.select("sample_id").join(mark(excluded, "out"), "sample_id", "left").join(mark(done, "made"), "sample_id", "left")
    return rows.select("sample_id", F.when(F.col("out"), "excluded").when(F.col("made"), "done").otherwise("pending").alias("status"))


def parse_samples(spark: SparkSession, ours: str, theirs: str, path: str, excluded: DataFrame) -> DataFrame:
    """Joins the result texts of all samples that two globs name and writes the pairs by sample; returns the samples' status before.

    Samples that are excluded, or whose pairs lie under ``path`` already, are left out. A sample that only one side has gives no pairs.
    """
    from ..plans import parity

    lines = {"ours": result_lines(spark, ours), "theirs": result_lines(spark, theirs)}
    samples = lines["ours"].select("sample_id").union(lines["theirs"].select("sample_id")).distinct()
    made = listing(spark, f"{path}/sample_id=*/*.parquet").select(F.regexp_extract("path", "sample_id=([^/]+)/", 1).alias("sample_id")) if _exists(spark, path) else samples.limit(0)
    # Written before the pairs, which would change it.
    states = spark.createDataFrame(status(samples, made, excluded).collect(), "sample_id string, status string")  # a row for each sample folder
    todo = states.where("status = 'pending'").select("sample_id")
    long = {k: parity.parse_long(v.join(F.broadcast(todo), "sample_id"), keep=("sample_id",)) for k, v in lines.items()}
    pairs = parity.joined(long["ours"], long["theirs"], ("sample_id", *parity.KEYS))
    pairs.write.mode("append").partitionBy("sample_id").option("compression", "zstd").parquet(path)
    return states


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def pending(samples: DataFrame, done: DataFrame, excluded: DataFrame) -> DataFrame:
    """Samples neither done nor excluded."""
    return samples.join(done.select("sample_id"), "sample_id", "left_anti").join(excluded.select("sample_id"), "sample_id", "left_anti")


def write_pairs(pairs: DataFrame, path: str) -> None:
    """Parquet by sample; Spark's commit publishes files only when they are whole."""
    pairs.write.mode("overwrite").partitionBy("sample_id").option("compression", "zstd").parquet(path)


def run_metrics(spark: SparkSession, *paths: str) -> DataFrame:
    """Run metrics of one or many TSV files with headers."""
    return spark.read.csv(list(paths), sep="\t", header=True, schema=RUN_METRICS, enforceSchema=False) if len(paths) > 1 else spark.read.csv(paths[0], sep="\t", header=True, schema=RUN_METRICS)


def traces(spark: SparkSession, folder: str) -> DataFrame:
    """name, status, realtime of all trace*.txt below a folder, by each file's own header; a column that a file lacks is null there.

    A header is a file's first line, so files stay whole in reading: a trace has a line for each task of one run. Empty files give no rows.
    """
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "trace*.txt").text(folder, wholetext=True)
    lines = files.select(F.filter(F.transform(F.split("value", "\n"), lambda x: F.rtrim(x, F.lit("\r"))), lambda x: x != "").alias("lines"))
    rows = lines.where(F.size("lines") > 1).select(F.split(F.col("lines")[0], "\t").alias("header"), F.explode(F.slice("lines", 2, F.size("lines"))).alias("line"))
    fields = rows.select("header", F.split("line", "\t").alias("f"))
    place = lambda c: F.array_position("header", c).cast("int")
    return fields.select(*[F.when(place(c) > 0, F.get("f", place(c) - 1)).alias(c) for c in ("name", "status", "realtime")])


def with_timings(metrics: DataFrame, timings: DataFrame) -> DataFrame:
    """Run metrics with each sample's longest task: null where no trace names the sample."""
    return metrics.join(timings.select("sample_id", "realtime_s"), "sample_id", "left")


def write_tsv(rows: DataFrame, path: str) -> None:
    rows.coalesce(1).write.mode("overwrite").csv(path, sep="\t", header=True)
