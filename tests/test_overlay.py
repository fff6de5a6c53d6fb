"""Reads over sites in batches against the expressions of kernel.py, on odd reads; and that what moves for file order stays small."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pilespark import synthetic as X
from pilespark.functions import kernel as K
from pilespark.operators import aggregate, observe, overlay
from pilespark.schema import READ, PileupConfig

CIGARS = ["*", "", "12M", "3S9M", "2H3S7M2S1H", "5M2D5M2S", "4M300N8M", "4M7I1M", "2S4=1X1I4M", "12S", "5H", "3M1P2M1D4M3S", "1I11M", "5Z7M5S", "6M700N6M", "0M12M"]
MDS = [None, "", "12", "0A11", "3A1C6", "3A0C0G6", "4A0^GG0C6", "5^ACGT7", "2^A^C3T", "1a2n3", "99T", "^", "3A8T400C"]


def _reads(n, long):
    draw = random.Random(5)
    for i in range(n):
        cigar, length = draw.choice(CIGARS), 12
        if long and i % 9 == 0:
            length = draw.choice([400, 70_000])
            cigar = f"20S{length // 2 - 20}M5I{length // 2 - 5}M"
        quals = [draw.choice([2, 2, 2, 30, 41, 50, 51, 255][: 8 if i % 2 else 6]) for _ in range(length)]
        if i % 5 == 0:
            quals = [2] * length
        yield i * 3 % n, f"r{i}", draw.choice([0, 16, 2, 18, 0x800, 4, 0x400]), draw.choice(["c1", "c2", "x"]), draw.choice([0, 3, 120, 125, 500, 510, 1020, -1]), draw.choice([0, 20, 60, 255]), cigar, "".join(draw.choice("ACGTNacgtn=R") for _ in range(length)), quals, draw.choice([None, -1, 0, 3]), draw.choice(MDS), draw.choice([None, -4, 30, 300])


def _expected(reads, sites, config):
    """The observations as expressions: each aligned base meets its position."""
    at = observe.scan(observe.usable(reads, config)).withColumn("seg", F.explode("segs")).where("seg.len > 0").withColumn("pos", F.explode(F.expr("sequence(seg.ref0 + 1, seg.ref0 + seg.len)")))
    at = at.join(sites.distinct(), ["chrom", "pos"]).withColumn("qpos", F.expr("cast(seg.q0 + pos - 1 - seg.ref0 AS int)")).withColumn("base_qual", F.element_at("qual", F.col("qpos") + 1)).where(F.col("base_qual") >= config.min_baseq)
    at = at.withColumn("n", F.row_number().over(Window.partitionBy("chrom", "pos").orderBy("ord", "qpos"))).where(F.col("n") <= config.max_depth)
    made = {
        "base": K.base_label(F.substring("seq", F.col("qpos") + 1, F.lit(1))), "pos_as_fraction": K.pos_as_fraction(F.col("qpos"), F.col("left_clip"), F.col("clipped_length")), "clipped_len": F.col("clipped_length"),
        "mismatch_fraction": K.mismatch_fraction(F.col("nm"), F.col("clipped_length")), "q2_distance": K.q2_distance(F.col("qpos"), F.col("q2_pos"), F.col("l_qseq")), "distance_to_3p_end": K.distance_to_3p_end(F.col("qpos"), F.col("three_prime_index"), F.col("l_qseq")),
    }
    return at.select(*[made.get(c, F.col(c)).cast(t).alias(c) for c, t in overlay.ROW.items()])


@pytest.mark.parametrize("config", [PileupConfig(), PileupConfig(min_baseq=30, min_mapq=10), PileupConfig(max_depth=3), PileupConfig(exact=True)])
def test_overlay_equals_expressions(spark, config):
    reads = spark.createDataFrame(list(_reads(400, True)), READ).cache()
    sites = spark.range(1, 2000).where("id % 7 <> 3").selectExpr("explode(array('c1', 'c2', 'y')) AS chrom", "id AS pos")
    sites = sites.union(sites.where("pos < 40"))
    want = _expected(reads, sites, config)
    key = lambda r: (r["ord"], r["pos"], r["qpos"])
    rows = sorted(want.collect(), key=key)
    assert len(rows) > 500 and sorted(observe.observations(reads, sites, config).collect(), key=key) == rows
    sums = {}
    for r in sorted(rows, key=lambda r: (r["ord"], r["qpos"])):
        s = sums.setdefault((r["chrom"], r["pos"], r["base"]), [0] * 7 + [0.0] * 4)
        for i, v in enumerate([1, r["is_reverse"], r["mapq"], r["base_qual"], r["se_mapq"] or 0, r["sum_mismatch_quals"], r["q2_distance"] is not None, r["pos_as_fraction"], r["mismatch_fraction"], r["q2_distance"] or 0.0, r["distance_to_3p_end"]]):
            s[i] += v
    got = {(r["chrom"], r["pos"], r["base"]): r for r in aggregate.per_base(reads, sites, config).collect()}
    assert got.keys() == sums.keys()
    for k, (n, minus, mapq, qual, se, smq, q2, *doubles) in sums.items():
        r = got[k]
        assert (r["count"], r["num_minus_strand"], r["num_plus_strand"], r["num_q2_containing_reads"]) == (n, minus, n - minus, q2)
        assert (r["avg_mapping_quality"], r["avg_basequality"], r["avg_se_mapping_quality"], r["avg_sum_mismatch_qualities"]) == (mapq / n, qual / n, se / n, smq / n)
        means = [r["avg_pos_as_fraction"], r["avg_num_mismatches_as_fraction"], r["avg_distance_to_q2_start_in_q2_reads"], r["avg_distance_to_effective_3p_end"]]
        exact = [doubles[0] / n, doubles[1] / n, doubles[2] / q2 if q2 else 0.0, doubles[3] / n]
        assert means == exact if observe.in_order(config) else means == pytest.approx(exact, rel=1e-12)


def test_what_moves_for_file_order_is_a_record_a_read(spark):
    """Exact sums and the depth cap exchange what a read has in a bin, not a row or a list element for each base."""
    d = "/root/testdata/sf0.001"
    sites = spark.range(1, 2101).selectExpr("explode(array('chr1', 'chr2', 'chr3')) AS chrom", "id AS pos")
    records = observe.over_bins(X.reads(spark, d), sites, PileupConfig()).mapInArrow(overlay.pack(PileupConfig()), overlay.RECORD_SCHEMA)
    n, size = records.agg(F.count("*"), F.avg(F.length("record"))).first()
    bases = observe.observations(X.reads(spark, d), sites, PileupConfig()).count()
    assert bases > 10 * n and size < 60


@pytest.mark.parametrize("config", [PileupConfig(), PileupConfig(exact=True)])
def test_metrics_add_up_before_they_move(spark, config):
    """No list of a group's observations is gathered and no row for each observation is exchanged."""
    d = "/root/testdata/sf0.001"
    sites = spark.createDataFrame([("chr1", 5)], "chrom string, pos long")
    plan = aggregate.per_base(X.reads(spark, d), sites, config)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "MapInArrow" in plan
    assert observe.sums(X.reads(spark, d), sites, PileupConfig()).count() <= 5 * 8


@pytest.mark.parametrize("config", [PileupConfig(), PileupConfig(max_depth=3), PileupConfig(exact=True)])
def test_batches_of_a_few_rows(spark, config):
    """Sums, open bins and the depth cap go on from one batch to the next."""
    reads = spark.createDataFrame(list(_reads(300, False)), READ)
    sites = spark.range(1, 2000).selectExpr("explode(array('c1', 'c2')) AS chrom", "id AS pos")
    run = lambda: sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r)) for r in aggregate.per_base(reads, sites, config).collect())
    whole = run()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert run() == whole and whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
