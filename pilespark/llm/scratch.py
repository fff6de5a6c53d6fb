"""Cutting lineage through the cluster's shared folder, and connected components.

Every intermediate table is written as Parquet under ``spark.checkpoint.dir`` (a folder that the
driver and all executors share), so a lost executor costs only the tasks that read it.
"""

from __future__ import annotations

import gc
import itertools
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
#: Spark's setting that removes the shuffle files of a query as it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``. Where it is unset, a folder of our own in local mode (tests), an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="pilespark-")
    return _OWN[app]


class Scratch:
    """Tables of one operator call; ``drop`` removes those that the result does not read."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str, free: bool = False, **options: str) -> DataFrame:
        """Writes df and returns it as read back, with the schema that it was written with. Its own shuffles go as it ends; ``free``: gives back the disk of other finished ones."""
        writer = df.write.mode("overwrite")
        for key, value in options.items():
            writer = writer.option(key, value)
        before = self.spark.conf.get(_CLEANUP, None)
        self.spark.conf.set(_CLEANUP, "true")
        try:
            writer.parquet(self.path(name))
        finally:
            self.spark.conf.unset(_CLEANUP) if before is None else self.spark.conf.set(_CLEANUP, before)
        if free:  # shuffle files of other jobs go only when their handles are collected on the driver, which a cluster's event queue may hold for a while
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            target = jvm.org.apache.hadoop.fs.Path(self.path(name))
            target.getFileSystem(conf).delete(target, True)


def components(scratch: Scratch, edges: DataFrame, label: str = "cc") -> DataFrame:
    """Connected components of edges (u, v): one row (node, root) per node named by an edge, root the least node reachable.

    Large-star and small-star steps on (child, parent) rows until nothing changes. Each step is a partial-aggregated minimum and a
    join back, so a node with very many neighbours is never gathered into one task.
    """
    links = scratch.write(edges.where("u <> v").selectExpr("greatest(u, v) AS c", "least(u, v) AS p").distinct(), f"{label}0")
    before = None
    for step in itertools.count(1):
        both = links.selectExpr("c AS n", "p AS m").union(links.selectExpr("p", "c"))
        least = both.groupBy("n").agg(F.min("m").alias("low")).selectExpr("n", "least(n, low) AS low")
        large = both.join(least, "n").where("m > n").selectExpr("m AS c", "low AS p")
        low = large.groupBy("c").agg(F.min("p").alias("low"))
        small = large.join(low, "c").selectExpr("explode(array(struct(c AS c, low AS p), struct(p AS c, low AS p))) AS e").select("e.*").where("c <> p").distinct()
        new = scratch.write(small, f"{label}{step}")
        state = new.agg(F.count("*"), F.coalesce(F.sum(F.expr("cast(xxhash64(c, p) AS decimal(20, 0))")), F.lit(0))).first()
        scratch.drop(f"{label}{step - 1}")
        links = new
        if tuple(state) == before:
            break
        before = tuple(state)
    roots = links.groupBy("c").agg(F.min("p").alias("root")).selectExpr("c AS node", "root")
    return roots.union(links.selectExpr("p AS node", "p AS root").distinct())
