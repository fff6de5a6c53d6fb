"""Reads, sites and a reference derived by integer arithmetic from the driver's tables, so that SQL can derive the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TILE = 500
LENGTH = 2100


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One read per lineitem (its keys taken once): clips, insertions, deletions, skips, mismatches, tags and Q2 tails by remainders of a hash h."""
    base = table(spark, sf_dir, "lineitem").selectExpr("(l_orderkey * 10 + l_linenumber) * 100000 + l_partkey AS ord").distinct().withColumn("h", F.expr("ord % 1000003 * 7919 % 1000003"))
    d = base.selectExpr("*", "cast(20 + h % 11 AS int) l", "cast(h % 4 AS int) lc", "cast(h div 4 % 3 AS int) rc", "cast(h % 5 AS int) m", "h % 3 <> 1 AS mm")
    d = d.selectExpr("*", "l - lc - rc - if(m = 1, 2, 0) AS a").selectExpr("*", "a div 2 AS a1", "a - a div 2 AS a2")
    d = d.selectExpr("*", "cast(h % a1 AS int) x1", "cast(a1 + h div 7 % a2 AS int) x2")
    middle = "CASE m WHEN 1 THEN a1 || 'M2I' || a2 || 'M' WHEN 2 THEN a1 || 'M3D' || a2 || 'M' WHEN 3 THEN a1 || 'M40N' || a2 || 'M' ELSE a || 'M' END"
    halves = "if(mm, x1 || 'A' || (a1 - 1 - x1), cast(a1 AS string)) || '^GGG' || if(mm, (x2 - a1) || 'C' || (a - 1 - x2), cast(a2 AS string))"
    # Bases by (h + k * k) % 5 and qualities by (h + 3 * k * k) % 39 are cut out of as many constants.
    letters = ["".join("ACGTN"[(r + k * k) % 5] for k in range(30)) for r in range(5)]
    quals = f"get(array({', '.join('array(' + ', '.join(str(2 + (r + 3 * k * k) % 39) for k in range(30)) + ')' for r in range(39))}), cast(h % 39 AS int))"
    return d.selectExpr(
        "ord", "cast(ord AS string) qname", "cast(h % 2 * 16 + if(h % 13 = 0, 1024, 0) + if(h % 3 = 0, 2, 0) + if(h % 17 = 0, 2048, 0) AS int) flag", "'chr' || (1 + h % 3) chrom", "h * 31 % 2000 pos0",
        "cast(h % 61 AS int) mapq", f"if(lc > 0, lc || 'S', '') || {middle} || if(rc > 0, rc || 'S', '') AS cigar",
        f"substring(get(array({', '.join(map(repr, letters))}), cast(h % 5 AS int)), 1, l) AS seq",
        f"CASE h % 7 WHEN 0 THEN concat(slice({quals}, 1, l - 3), array(2, 2, 2)) WHEN 1 THEN concat(array(2, 2, 2), slice({quals}, 4, l - 3)) ELSE slice({quals}, 1, l) END AS qual",
        "CASE WHEN h % 11 <> 0 THEN cast(if(mm, 2, 0) + CASE m WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 0 END AS bigint) END AS nm",
        f"CASE WHEN h % 19 = 0 THEN NULL WHEN m = 2 THEN {halves} WHEN mm THEN x1 || 'A' || (x2 - x1 - 1) || 'C' || (a - 1 - x2) ELSE cast(a AS string) END AS md",
        "CASE WHEN h % 4 <> 1 THEN cast(h % 300 AS int) END AS sm",
    )


def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Site ranges from orders: points, ranges and reversed ones, on four contigs of which the header knows three."""
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS bed_line", "'chr' || (1 + o_orderkey % 4) AS chrom", "o_orderkey * 37 % 2090 + 1 AS start")
    return rows.selectExpr("chrom", "start", "start + CASE WHEN bed_line % 11 = 0 THEN -1 ELSE bed_line % 3 END AS end", "bed_line")


def contigs(spark: SparkSession) -> DataFrame:
    return spark.range(3).selectExpr("'chr' || (id + 1) AS chrom", "cast(id AS int) AS tid", f"{LENGTH}L AS len")


def tiles(spark: SparkSession) -> DataFrame:
    """Bases acgt by (p*p + contig) % 4 up to LENGTH, in lower case."""
    n = -(-LENGTH // TILE)
    return spark.range(3 * n).selectExpr("1 + id div " + str(n) + " AS c", f"id % {n} * {TILE} AS start0").selectExpr(
        "'chr' || c AS chrom", "start0", f"array_join(transform(sequence(start0 + 1, least(start0 + {TILE}, {LENGTH}L)), p -> substring('acgt', cast(1 + (p * p + c) % 4 AS int), 1)), '') AS seq")
