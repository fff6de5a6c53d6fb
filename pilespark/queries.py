"""Queries for each operator over the driver's tables, and SQL that says the same another way."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import synthetic as X
from .functions import fmt, kernel as K
from .operators import aggregate, observe, reference, sites as S
from .plans import parity, timing
from .schema import BASES, METRICS, PileupConfig

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# --- SQL of the synthetic inputs: reads as one row for each base, with no use of CIGAR or MD text.
READS = """ri AS (SELECT DISTINCT (l_orderkey * 10 + l_linenumber) * 100000 + l_partkey AS ord FROM lineitem), r0 AS (SELECT ord, ((ord % 1000003) * 7919) % 1000003 AS h FROM ri),
r1 AS (SELECT *, 20 + h % 11 AS l, h % 4 AS lc, (h // 4) % 3 AS rc, h % 5 AS m, h % 3 <> 1 AS mm, 'chr' || (1 + h % 3) AS chrom, (h * 31) % 2000 AS pos0, h % 61 AS mapq, h % 2 = 1 AS rev,
  h % 13 = 0 AS dup, CASE WHEN h % 11 <> 0 THEN CASE WHEN h % 3 <> 1 THEN 2 ELSE 0 END + CASE h % 5 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 0 END END AS nm, CASE WHEN h % 4 <> 1 THEN h % 300 END AS sm FROM r0),
r2 AS (SELECT *, l - lc - rc - CASE WHEN m = 1 THEN 2 ELSE 0 END AS a, l - lc - rc AS cl FROM r1),
r3 AS (SELECT *, a // 2 AS a1, a - a // 2 AS a2 FROM r2),
r4 AS (SELECT *, h % a1 AS x1, a1 + (h // 7) % a2 AS x2 FROM r3),
b0 AS (SELECT *, unnest(range(0, l)) AS k FROM r4),
b1 AS (SELECT *, substr('ACGTN', CAST(1 + (h + k * k) % 5 AS INTEGER), 1) AS base,
  CASE WHEN h % 7 = 0 AND k >= l - 3 THEN 2 WHEN h % 7 = 1 AND k < 3 THEN 2 ELSE 2 + (h + 3 * k * k) % 39 END AS q,
  CASE WHEN k < lc OR k >= l - rc OR (m = 1 AND k IN (lc + a1, lc + a1 + 1)) THEN NULL WHEN m = 1 AND k > lc + a1 THEN k - lc - 2 ELSE k - lc END AS j FROM b0),
b2 AS (SELECT *, pos0 + j + 1 + CASE WHEN j >= a1 THEN CASE m WHEN 2 THEN 3 WHEN 3 THEN 40 ELSE 0 END ELSE 0 END AS pos FROM b1),
p0 AS (SELECT ord, coalesce(CASE WHEN any_value(rev) THEN min(k) FILTER (q <> 2) ELSE max(k) FILTER (q <> 2) END, 0) - 1 AS q2,
  CASE WHEN any_value(h) % 19 = 0 OR NOT any_value(mm) THEN 0 ELSE coalesce(sum(q) FILTER (j IN (x1, x2)), 0)
    - CASE WHEN max(k) FILTER (j = x2) = max(k) FILTER (j = x1) + 1 THEN min(q) FILTER (j IN (x1, x2)) ELSE 0 END END AS smq FROM b1 GROUP BY ord),
sc AS (SELECT r4.*, p0.q2, p0.smq, CASE WHEN rev THEN greatest(0, lc, q2) WHEN q2 <> -1 AND least(l - 1, l - rc) > q2 THEN q2 ELSE least(l - 1, l - rc) END AS t3,
  CASE WHEN h % 3 > 0 THEN mapq WHEN sm IS NOT NULL THEN least(sm, 255) END AS se FROM r4 JOIN p0 USING (ord))"""
SITES = f"""g0 AS (SELECT o_orderkey AS bed_line, 'chr' || (1 + o_orderkey % 4) AS chrom, (o_orderkey * 37) % 2090 + 1 AS s, CASE WHEN o_orderkey % 11 = 0 THEN -1 ELSE o_orderkey % 3 END AS w FROM orders),
g1 AS (SELECT chrom, bed_line, CASE WHEN w = 0 THEN s ELSE s + 1 + i END AS pos, i AS within_line FROM (SELECT *, unnest(CASE WHEN w < 0 THEN [] WHEN w = 0 THEN [0] ELSE range(0, w) END) AS i FROM g0)),
g2 AS (SELECT DISTINCT chrom, pos FROM g1 WHERE chrom <> 'chr4')"""
OBS = """ob AS (SELECT b2.chrom, b2.pos, b2.base, b2.q, b2.mapq, sc.se, b2.rev, 1 - abs((b2.k - b2.lc) - b2.cl / 2) / (b2.cl / 2) AS pf, coalesce(b2.nm, 0) / b2.cl AS mf, sc.smq,
  CASE WHEN sc.q2 > -1 THEN abs(b2.k - sc.q2) / b2.l END AS qd, b2.cl, abs(b2.k - sc.t3) / b2.l AS d3, b2.ord, b2.k
  FROM b2 JOIN sc USING (ord) JOIN g2 ON b2.chrom = g2.chrom AND b2.pos = g2.pos WHERE b2.j IS NOT NULL AND NOT b2.dup)"""
ALL = f"WITH {READS}, {SITES}, {OBS}"
_VALUES = {
    "count": "count(*)", "avg_mapping_quality": "sum(mapq) / count(*)", "avg_basequality": "sum(q) / count(*)", "avg_se_mapping_quality": "coalesce(sum(se), 0) / count(*)",
    "num_plus_strand": "count(*) FILTER (NOT rev)", "num_minus_strand": "count(*) FILTER (rev)", "avg_pos_as_fraction": "sum(pf) / count(*)", "avg_num_mismatches_as_fraction": "sum(mf) / count(*)",
    "avg_sum_mismatch_qualities": "sum(smq) / count(*)", "num_q2_containing_reads": "count(qd)", "avg_distance_to_q2_start_in_q2_reads": "coalesce(avg(qd), 0)", "avg_clipped_length": "sum(cl) / count(*)", "avg_distance_to_effective_3p_end": "sum(d3) / count(*)",
}
_SQL13 = ", ".join(f"{v if METRICS[m] else f'round({v}, 6)'} AS {m}" for m, v in _VALUES.items())
AGG = "ag AS (SELECT chrom, pos, base, " + ", ".join(f"{v} AS {m}" for m, v in _VALUES.items()) + " FROM ob GROUP BY ALL)"


def _metrics(spark: SparkSession, d: str, config: PileupConfig = PileupConfig()) -> DataFrame:  # noqa: B008
    sites = S.distinct(S.known(S.expand(X.ranges(spark, d)), X.contigs(spark)))
    return aggregate.per_base(X.reads(spark, d), sites, config)


@query(f"{ALL} SELECT chrom, pos, base, count(*) AS count, count(*) FILTER (NOT rev) AS num_plus_strand, count(*) FILTER (rev) AS num_minus_strand FROM ob GROUP BY ALL")
def base_counts(spark, d):
    return _metrics(spark, d).select("chrom", "pos", "base", "count", "num_plus_strand", "num_minus_strand")


@query(f"{ALL} SELECT chrom, pos, base, {_SQL13} FROM ob GROUP BY ALL")
def full_metrics(spark, d):
    return _rounded(_metrics(spark, d))


@query(f"{ALL} SELECT chrom, pos, base, {_SQL13} FROM ob GROUP BY ALL")
def full_metrics_exact(spark, d):
    return _rounded(_metrics(spark, d, PileupConfig(exact=True, strategy="explode")))


_WIDE = ", ".join(f"coalesce(max(count) FILTER (base = '{b}'), 0) AS {b.lower()}_count, round(coalesce(max(avg_basequality) FILTER (base = '{b}'), 0), 6) AS {b.lower()}_bq" for b in BASES)


@query(f"{ALL}, {AGG} SELECT g2.chrom, g2.pos, CASE WHEN g2.pos > 2100 THEN 'N' ELSE substr('ACGT', CAST(1 + (g2.pos * g2.pos + CAST(substr(g2.chrom, 4) AS BIGINT)) % 4 AS INTEGER), 1) END AS ref_base, CAST(coalesce(sum(count), 0) AS BIGINT) AS depth, {_WIDE} FROM g2 LEFT JOIN ag ON g2.chrom = ag.chrom AND g2.pos = ag.pos GROUP BY g2.chrom, g2.pos")
def wide_pivot(spark, d):
    w = _wide(spark, d)
    return w.select("chrom", "pos", "ref_base", "depth", *[c for b in BASES for c in (F.col(b)["count"].alias(f"{b.lower()}_count"), F.round(F.col(b)["avg_basequality"], 6).alias(f"{b.lower()}_bq"))])


def _wide(spark: SparkSession, d: str, config: PileupConfig = PileupConfig()) -> DataFrame:  # noqa: B008
    tiles = X.tiles(spark)
    sites = S.known(S.expand(X.ranges(spark, d)), X.contigs(spark))
    rows = S.distinct(sites).join(aggregate.wide(_metrics(spark, d, config)), ["chrom", "pos"], "left")
    return reference.with_ref_base(aggregate.fill(rows), tiles, X.TILE)


@query(f"WITH {SITES} SELECT chrom, pos, bed_line, within_line FROM g1")
def site_expand(spark, d):
    return S.expand(X.ranges(spark, d))


@query("""WITH p AS (SELECT 'chr' || (1 + event_id % 3) AS chrom, (event_id * 7919 * 131) % 30000000 AS pos, event_id AS bed_line FROM events),
m AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY chrom ORDER BY pos, bed_line) > 50000 THEN 1 ELSE 0 END AS far FROM p),
i AS (SELECT *, CAST(sum(far) OVER (PARTITION BY chrom ORDER BY pos, bed_line ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM m)
SELECT chrom, pos, bed_line, island, (row_number() OVER (PARTITION BY chrom, island ORDER BY pos, bed_line) - 1) // 200 AS chunk FROM i""")
def site_chunks(spark, d):
    p = X.table(spark, d, "events").selectExpr("'chr' || (1 + event_id % 3) AS chrom", "event_id * 7919 * 131 % 30000000 AS pos", "event_id AS bed_line", "0L AS within_line")
    return S.chunks(p).select("chrom", "pos", "bed_line", F.col("island").cast("long").alias("island"), "chunk")


@query(f"""WITH {SITES}, s AS (SELECT * FROM g1 WHERE chrom <> 'chr4'), c AS (SELECT *, (row_number() OVER (PARTITION BY chrom ORDER BY pos, bed_line, within_line) - 1) // 200 AS chunk FROM s)
SELECT chrom, pos, bed_line, within_line, bed_line * 10 + within_line = max(bed_line * 10 + within_line) OVER (PARTITION BY chrom, chunk, pos) AS counted FROM c""")
def site_duplicates(spark, d):
    return S.counted(S.chunks(S.known(S.expand(X.ranges(spark, d)), X.contigs(spark)))).select("chrom", "pos", "bed_line", "within_line", "counted")


@query(f"WITH {READS} SELECT ord, chrom, pos0, mapq, rev AS is_reverse FROM r1 WHERE NOT dup AND mapq >= 20")
def read_filters(spark, d):
    r = observe.usable(X.reads(spark, d), PileupConfig(min_mapq=20))
    return r.select("ord", "chrom", "pos0", F.col("mapq").cast("long").alias("mapq"), K.is_reverse(F.col("flag")).alias("is_reverse"))


@query(f"{ALL} SELECT chrom, pos, base, count(*) AS count, round(sum(q) / count(*), 6) AS avg_basequality FROM ob WHERE q >= 20 GROUP BY ALL")
def baseq_threshold(spark, d):
    return _rounded(_metrics(spark, d, PileupConfig(min_baseq=20)).select("chrom", "pos", "base", "count", "avg_basequality"))


@query(f"{ALL}, n AS (SELECT *, row_number() OVER (PARTITION BY chrom, pos ORDER BY ord, k) AS n FROM ob WHERE q >= 10) SELECT chrom, pos, base, count(*) AS count, round(sum(mapq) / count(*), 6) AS avg_mapping_quality FROM n WHERE n <= 5 GROUP BY ALL")
def depth_cap(spark, d):
    return _rounded(_metrics(spark, d, PileupConfig(min_baseq=10, max_depth=5)).select("chrom", "pos", "base", "count", "avg_mapping_quality"))


@query(f"""WITH {READS} SELECT ord, min(pos) - 1 AS ref0, min(k) AS q0, count(*) AS len FROM b2 WHERE j IS NOT NULL GROUP BY ord, m IN (1, 2, 3) AND j >= a1""")
def cigar_segments(spark, d):
    s = X.reads(spark, d).select("ord", F.explode(K.segments(K.cigar_ops(F.col("cigar")), F.col("pos0"))).alias("g"))
    return s.select("ord", "g.ref0", F.col("g.q0").cast("long").alias("q0"), F.col("g.len").cast("long").alias("len"))


@query(f"WITH {READS} SELECT ord, lc AS left_clip, rc AS right_clip, cl AS clipped_length, a + CASE m WHEN 2 THEN 3 WHEN 3 THEN 40 ELSE 0 END AS ref_span FROM r2")
def soft_clips(spark, d):
    r = X.reads(spark, d).withColumn("ops", K.cigar_ops(F.col("cigar")))
    left, right = K.soft_clip(F.col("ops"), True), K.soft_clip(F.col("ops"), False)
    return r.select("ord", left.cast("long").alias("left_clip"), right.cast("long").alias("right_clip"), F.greatest(F.lit(0), F.length("seq") - left - right).cast("long").alias("clipped_length"), K.reference_span(F.col("ops")).alias("ref_span"))


def _scan(spark: SparkSession, d: str) -> DataFrame:
    return observe.scan(X.reads(spark, d))


@query(f"WITH {READS} SELECT ord, q2 AS q2_pos FROM p0")
def q2_pos(spark, d):
    return _scan(spark, d).select("ord", F.col("q2_pos").cast("long").alias("q2_pos"))


@query(f"WITH {READS} SELECT ord, t3 AS three_prime_index FROM sc")
def three_prime(spark, d):
    return _scan(spark, d).select("ord", F.col("three_prime_index").cast("long").alias("three_prime_index"))


@query(f"WITH {READS} SELECT ord, CAST(smq AS BIGINT) AS sum_mismatch_quals FROM p0")
def md_mismatch_quals(spark, d):
    return _scan(spark, d).select("ord", "sum_mismatch_quals")


@query(f"WITH {READS} SELECT ord, se AS se_mapq, CAST(coalesce(nm, 0) AS BIGINT) AS nm FROM sc")
def se_mapq(spark, d):
    return _scan(spark, d).select("ord", F.col("se_mapq").cast("long").alias("se_mapq"), "nm")


@query(f"{ALL} SELECT ord, chrom, pos, k AS qpos, round(pf, 6) AS pos_as_fraction, round(mf, 6) AS mismatch_fraction, round(qd, 6) AS q2_distance, round(d3, 6) AS distance_to_3p_end FROM ob")
def read_distances(spark, d):
    sites = S.distinct(S.known(S.expand(X.ranges(spark, d)), X.contigs(spark)))
    columns = ("ord", "chrom", "pos", "qpos", "pos_as_fraction", "mismatch_fraction", "q2_distance", "distance_to_3p_end")
    o = observe.observations(X.reads(spark, d), sites, PileupConfig(strategy="explode"), columns)
    # One row for each aligned base: round() goes through decimal text and takes longer than all the rest.
    scaled = lambda c: F.abs(F.col(c)) * 1e6
    near = lambda c: F.signum(c) * (F.floor(scaled(c)) + F.when(scaled(c) - F.floor(scaled(c)) >= 0.5, 1).otherwise(0)) / 1e6
    return o.select("ord", "chrom", "pos", F.col("qpos").cast("long").alias("qpos"), *[near(c).alias(c) for c in columns[4:]])


@query("WITH c AS (SELECT unnest(string_split(text, '')) AS c FROM documents) SELECT CASE WHEN c IN ('a', 'A') THEN 'A' WHEN c IN ('c', 'C') THEN 'C' WHEN c IN ('g', 'G') THEN 'G' WHEN c IN ('t', 'T') THEN 'T' ELSE 'N' END AS base, count(*) AS n FROM c WHERE c <> '' GROUP BY ALL")
def base_label(spark, d):
    c = X.table(spark, d, "documents").select(F.explode(F.split("text", "")).alias("c")).where("c <> ''")
    return c.groupBy(K.base_label(F.col("c")).alias("base")).agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT doc_id, 1 + (doc_id * 7919 + i * 104729) % (n_chars + 50) AS pos FROM documents, range(0, 20) t(i))
SELECT DISTINCT 'd' || s.doc_id AS chrom, s.pos, CASE WHEN s.pos > length(text) THEN 'N' ELSE translate(substr(text, s.pos, 1), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') END AS ref_base FROM s JOIN documents USING (doc_id)""")
def ref_base(spark, d):
    docs = X.table(spark, d, "documents")
    tiles = docs.select(F.concat(F.lit("d"), "doc_id").alias("chrom"), "text", F.explode(F.expr("sequence(0L, cast(greatest(length(text) - 1, 0) AS bigint), 4096L)")).alias("start0")).selectExpr("chrom", "start0", "substring(text, cast(start0 + 1 AS int), 4096) AS seq")
    sites = docs.select("doc_id", "n_chars", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("i")).selectExpr("'d' || doc_id AS chrom", "1 + (doc_id * 7919 + i * 104729) % (n_chars + 50) AS pos").distinct()
    return reference.with_ref_base(sites, tiles).select("chrom", "pos", "ref_base")


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 2)")
def contig_semi(spark, d):
    nations = X.table(spark, d, "nation").where("n_regionkey < 2").select(F.col("n_nationkey").alias("chrom"))
    return S.known(X.table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("chrom")), nations).select("c_custkey", F.col("chrom").alias("c_nationkey"))


@query("SELECT c_custkey AS sample_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AND c_nationkey <> 3")
def exclude_anti(spark, d):
    from .sources.tables import pending

    c = X.table(spark, d, "customer").withColumnRenamed("c_custkey", "sample_id")
    done = X.table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("sample_id"))
    return pending(c, done, c.where("c_nationkey = 3")).select("sample_id")


_RECORD = lambda b: f"""CASE WHEN coalesce(max(count) FILTER (base = '{b}'), 0) = 0 THEN '{b}:0:0.00:0.00:0.00:0:0:0.00:0.00:0.00:0:0.00:0.00:0.00' ELSE concat_ws(':', '{b}', """ + ", ".join(f"max({m}) FILTER (base = '{b}')" if w else f"printf('%.2f', max({m}) FILTER (base = '{b}'))" for m, w in METRICS.items()) + ") END"
LINES = f"""ln AS (SELECT concat_ws(chr(9), g2.chrom, g2.pos, CASE WHEN g2.pos > 2100 THEN 'N' ELSE substr('ACGT', CAST(1 + (g2.pos * g2.pos + CAST(substr(g2.chrom, 4) AS BIGINT)) % 4 AS INTEGER), 1) END,
 CAST(coalesce(sum(count), 0) AS BIGINT), '=:0:0.00:0.00:0.00:0:0:0.00:0.00:0.00:0:0.00:0.00:0.00', {", ".join(_RECORD(b) for b in BASES)}) AS value FROM g2 LEFT JOIN ag ON g2.chrom = ag.chrom AND g2.pos = ag.pos GROUP BY g2.chrom, g2.pos)"""
#: The double sums in file order, as the exact mode adds them; DuckDB adds a list in its order.
_ORDERED = {m: (f"list_sum(list({c} ORDER BY ord, k) FILTER ({c} IS NOT NULL))", c) for m, c in {"avg_pos_as_fraction": "pf", "avg_num_mismatches_as_fraction": "mf", "avg_distance_to_q2_start_in_q2_reads": "qd", "avg_distance_to_effective_3p_end": "d3"}.items()}
EXACT = "ag AS (SELECT chrom, pos, base, " + ", ".join((f"coalesce({_ORDERED[m][0]} / count({_ORDERED[m][1]}), 0)" if m in _ORDERED else v) + f" AS {m}" for m, v in _VALUES.items()) + " FROM ob GROUP BY ALL)"


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return _wide(spark, d, PileupConfig(exact=True)).select(fmt.line().alias("value"))


@query(f"{ALL}, {EXACT}, {LINES} SELECT value FROM ln")
def format_line(spark, d):
    return _lines(spark, d)


_PARSED = ", ".join(f"CAST(f[{i}] AS DOUBLE) AS {m}" for i, m in enumerate(METRICS, 2))
PARSED = f"pl AS (SELECT split(value, chr(9)) AS p FROM ln), pr AS (SELECT p[1] AS chrom, CAST(p[2] AS BIGINT) AS pos, split(unnest(p[5:]), ':') AS f FROM pl), lg AS (SELECT chrom, pos, f[1] AS base, {_PARSED} FROM pr WHERE f[1] <> '=' AND CAST(f[2] AS DOUBLE) > 0)"


@query(f"{ALL}, {EXACT}, {LINES}, {PARSED} SELECT * FROM lg")
def parse_long(spark, d):
    return parity.parse_long(_lines(spark, d))


@query("SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey")
def dedupe_first(spark, d):
    o = X.table(spark, d, "orders").select("o_custkey", "o_orderkey")
    return parity.dedupe_first(o.union(o), ("o_custkey",), ("o_orderkey",))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Metrics against a copy that differs at every seventh position."""
    ours = _rounded(_metrics(spark, d))
    off = F.when(F.col("pos") % 7 == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    theirs = ours.select("chrom", "pos", "base", *[(F.col(m) + off * (1 if w else 0.01)).cast("double").alias(m) for m, w in METRICS.items()]).where("pos % 11 <> 0")
    ours = ours.select("chrom", "pos", "base", *[F.col(m).cast("double").alias(m) for m in METRICS])
    return parity.joined(ours, theirs.union(theirs))


_OURS = f"ou AS (SELECT chrom, pos, base, {_SQL13} FROM ob GROUP BY ALL)"
_JOINED = f"{ALL}, {_OURS}, jn AS (SELECT chrom, pos, base, " + ", ".join(f"CAST({m} AS DOUBLE) + CASE WHEN pos % 7 = 0 THEN {1.0 if w else 0.01} ELSE 0 END AS ref_{m}, CAST({m} AS DOUBLE) AS rs_{m}" for m, w in METRICS.items()) + " FROM ou WHERE pos % 11 <> 0)"


@query(f"{_JOINED} SELECT chrom, pos, base, " + ", ".join(f"round({p}{m}, 6) AS {p}{m}" for p in ("ref_", "rs_") for m in METRICS) + " FROM jn")
def parity_join(spark, d):
    return _rounded(_pairs(spark, d))


def _stats_sql(m: str, whole: bool) -> str:
    a, b = f"ref_{m}", f"rs_{m}"
    same = f"{a} = {b}" if whole else f"round_even({a} * 100, 0) = round_even({b} * 100, 0)"
    return f"SELECT '{m}' AS metric, '{'int' if whole else 'float'}' AS kind, count(*) AS n_full, round(avg(CASE WHEN {a} - {b} = 0 THEN 100.0 ELSE 0 END), 4) AS pct_delta_zero, round(avg(CASE WHEN {same} THEN 100.0 ELSE 0 END), 4) AS pct_printed_eq, round(max(abs({a} - {b})), 6) AS max_abs_dev, round(avg(abs({a} - {b})), 6) AS mae, round(avg({a} - {b}), 6) AS bias, round(1.96 * coalesce(stddev_samp({a} - {b}), 0), 6) AS loa_95 FROM jn"


@query(f"{_JOINED} " + " UNION ALL ".join(_stats_sql(m, w) for m, w in METRICS.items()))
def parity_stats(spark, d):
    s = parity.statistics(_pairs(spark, d))
    return _rounded(s).withColumns({c: F.round(c, 4) for c in ("pct_delta_zero", "pct_printed_eq")})


@query(f"{_JOINED} " + " UNION ALL ".join(f"SELECT '{m}' AS metric, count(*) AS n, round(corr(ref_{m}, rs_{m}), 5) AS pearson_r, round(avg(abs(ref_{m} - rs_{m})), 6) AS mae, round(avg(CASE WHEN abs(ref_{m} - rs_{m}) <= 0.01 THEN 100.0 ELSE 0 END), 4) AS pct_within_001, round(avg(CASE WHEN ref_{m} = rs_{m} THEN 100.0 ELSE 0 END), 4) AS pct_exact FROM jn" for m in METRICS))
def pearson_table(spark, d):
    return _rounded(parity.pearson(_pairs(spark, d))).withColumns({"pearson_r": F.round("pearson_r", 5), "pct_within_001": F.round("pct_within_001", 4), "pct_exact": F.round("pct_exact", 4)})


@query("SELECT least(CAST(floor(l_extendedprice / 1000) AS BIGINT), 119) AS bx, least(CAST(floor(l_quantity * 1000 / 1000) AS BIGINT), 119) AS by, count(*) AS n FROM lineitem WHERE l_extendedprice BETWEEN 0 AND 120000 AND l_quantity BETWEEN 0 AND 120000 GROUP BY ALL")
def density_2d(spark, d):
    rows = X.table(spark, d, "lineitem").selectExpr("l_extendedprice AS x", "l_quantity * 1000 AS y")
    return parity.density(rows, "x", "y", 0.0, 120_000.0)


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('42:' || doc_id), doc_id) AS n FROM documents) WHERE n <= 50")
def sample_per_group(spark, d):
    return parity.sample_per_group(X.table(spark, d, "documents").select("source", "doc_id"), "source", ("doc_id",))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 60.0 * (event_id % 50) + event_id % 60 WHEN 1 THEN (event_id % 900) * 0.001 WHEN 2 THEN (event_id % 9) * 3600.0 + (event_id % 59) * 60 WHEN 3 THEN CAST(event_id % 77 AS DOUBLE) + 0.5 END AS seconds FROM events")
def duration_parse(spark, d):
    text = "CASE event_id % 5 WHEN 0 THEN (event_id % 50) || 'm ' || (event_id % 60) || 's' WHEN 1 THEN (event_id % 900) || 'ms' WHEN 2 THEN (event_id % 9) || 'h ' || (event_id % 59) || 'm' WHEN 3 THEN (event_id % 77) || '.5s' ELSE '-' END"
    return X.table(spark, d, "events").select("event_id", timing.seconds(F.expr(text)).alias("seconds"))


@query("SELECT CAST(user_id AS VARCHAR) AS sample_id, max((event_id % 90) * 60.0 + event_id % 7) AS realtime_s FROM events WHERE event_type IN ('click', 'view', 'purchase') AND event_id % 4 < 2 AND event_id % 3 > 0 GROUP BY ALL")
def trace_max(spark, d):
    t = X.table(spark, d, "events").where("event_type IN ('click', 'view', 'purchase')").selectExpr("if(event_id % 3 > 0, 'COUNT', 'INDEX') || ' (' || user_id || ')' AS name", "element_at(array('COMPLETED', 'CACHED', 'FAILED', 'ABORTED'), cast(event_id % 4 + 1 AS int)) AS status", "(event_id % 90) || 'm ' || (event_id % 7) || 's' AS realtime")
    return timing.trace_max(t, "COUNT")


@query("""WITH m AS (SELECT CAST(c_custkey AS VARCHAR) AS sample_id, c_acctbal AS rs_wall_s FROM customer), t AS (SELECT CAST(user_id AS VARCHAR) AS sample_id, max((event_id % 90) * 60.0 + event_id % 7) AS realtime_s FROM events WHERE event_id % 4 < 2 AND event_id % 3 > 0 GROUP BY ALL)
SELECT sample_id, rs_wall_s, realtime_s FROM m LEFT JOIN t USING (sample_id)""")
def metrics_timings(spark, d):
    from .sources.tables import with_timings

    trace = X.table(spark, d, "events").selectExpr("if(event_id % 3 > 0, 'COUNT', 'INDEX') || ' (' || user_id || ')' AS name", "element_at(array('COMPLETED', 'CACHED', 'FAILED', 'ABORTED'), cast(event_id % 4 + 1 AS int)) AS status", "(event_id % 90) || 'm ' || (event_id % 7) || 's' AS realtime")
    metrics = X.table(spark, d, "customer").selectExpr("cast(c_custkey AS string) AS sample_id", "c_acctbal AS rs_wall_s")
    return with_timings(metrics, timing.trace_max(trace, "COUNT")).select("sample_id", "rs_wall_s", "realtime_s")


@query("SELECT CAST(c_custkey AS VARCHAR) AS sample_id, CASE WHEN c_nationkey = 3 THEN 'excluded' WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') THEN 'done' ELSE 'pending' END AS status FROM customer")
def sample_status(spark, d):
    from .sources.tables import status

    c = X.table(spark, d, "customer").selectExpr("cast(c_custkey AS string) AS sample_id", "c_nationkey")
    done = X.table(spark, d, "orders").where("o_orderstatus = 'F'").selectExpr("cast(o_custkey AS string) AS sample_id")
    return status(c, done, c.where("c_nationkey = 3"))


@query(f"""WITH {SITES}, c AS (SELECT *, (row_number() OVER (PARTITION BY chrom ORDER BY pos, bed_line, within_line) - 1) // 200 AS chunk FROM g1 WHERE chrom <> 'chr4') SELECT chrom, 0 AS island, chunk, min(pos) AS first, max(pos) AS last FROM c GROUP BY chrom, chunk""")
def chunk_extents(spark, d):
    e = S.extents(S.chunks(S.known(S.expand(X.ranges(spark, d)), X.contigs(spark))))
    return e.select("chrom", F.col("island").cast("int").alias("island"), "chunk", "first", "last")


@query("SELECT DISTINCT 'cohort_' || (c_custkey % 25) AS label, row_number() OVER (ORDER BY c_custkey % 25) AS place FROM (SELECT DISTINCT c_custkey % 25 AS c_custkey FROM customer)")
def labels_in_order(spark, d):
    labels = X.table(spark, d, "customer").selectExpr("'cohort_' || (c_custkey % 25) AS label").distinct()  # a row for each cohort
    return labels.select("label", F.row_number().over(Window.orderBy(timing.label_number(F.col("label")), "label")).cast("long").alias("place"))


@query("SELECT c_mktsegment AS cohort, count(*) AS n, round(median(o_totalprice), 4) AS slow_median, round(median(o_totalprice / (1 + o_orderkey % 7)), 4) AS fast_median, round(quantile_cont(o_totalprice, 0.25), 4) AS slow_q1, round(quantile_cont(o_totalprice, 0.75), 4) AS slow_q3, round(median(o_totalprice / (o_totalprice / (1 + o_orderkey % 7))), 4) AS median_speedup FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL")
def cohort_summary(spark, d):
    rows = X.table(spark, d, "orders").join(X.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).selectExpr("c_mktsegment AS cohort", "o_totalprice AS slow", "o_totalprice / (1 + o_orderkey % 7) AS fast")
    out = timing.cohort_summary(rows, "cohort", "slow", "fast")
    return out.select(*[F.round(c, 4).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


@query("SELECT c_custkey, 'cohort_' || dense_rank() OVER (ORDER BY c_mktsegment) AS label FROM customer WHERE c_mktsegment IS NOT NULL")
def cohort_anonymise(spark, d):
    return timing.anonymised(X.table(spark, d, "customer").where("c_mktsegment IS NOT NULL"), "c_mktsegment").select("c_custkey", "label")


@query("SELECT n_nationkey AS key, n_name AS name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region")
def concat_tables(spark, d):
    return X.table(spark, d, "nation").selectExpr("n_nationkey AS key", "n_name AS name").unionByName(X.table(spark, d, "region").selectExpr("r_regionkey AS key", "r_name AS name"))


@query(f"{ALL} SELECT chrom, pos FROM g2 WHERE NOT EXISTS (SELECT 1 FROM ob WHERE ob.chrom = g2.chrom AND ob.pos = g2.pos)")
def missing_sites(spark, d):
    return parity.missing(S.known(S.expand(X.ranges(spark, d)), X.contigs(spark)), _metrics(spark, d))
