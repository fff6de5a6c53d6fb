import random
import re
import struct
import zlib

import duckdb
import golden
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pilespark import cli
from pilespark.functions import fmt, kernel as K
from pilespark.operators import observe
from pilespark.operators import sites as S
from pilespark.plans import parity, timing
from pilespark.plans.pileup import lines, pileup
from pilespark.schema import CONTIG, READ, SITE, TILE, PileupConfig
from pilespark.queries import ORACLE, QUERIES
from pilespark.sources import bed, tables
from pilespark.sources.tables import sources

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _fasta(path):
    seq = ["a"] * 950_000
    for pos, base in ((924730, "c"), (930299, "c"), (944753, "g")):
        seq[pos - 1] = base
    text = "".join(seq)
    path.write_text(">chr1 test\n" + "\n".join(text[i : i + 60] for i in range(0, len(text), 60)) + "\n")


def _bgzf(data):
    out = b""
    for i in [*range(0, len(data), 700), None]:  # small blocks, then the empty end block
        raw = b"" if i is None else data[i : i + 700]
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = c.compress(raw) + c.flush()
        out += b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(raw), len(raw))
    return out


def _index(bam):
    """A .bai with a chunk for each record and the linear index."""
    from pilespark.sources.bam import Blocks, header

    blocks, bins, linear = Blocks(str(bam)), {}, {}
    header(blocks)
    while True:
        start = blocks.tell()
        size = blocks.read(4)
        if len(size) < 4:
            break
        raw = blocks.read(struct.unpack("<i", size)[0])
        pos, end = struct.unpack_from("<i", raw, 4)[0], struct.unpack_from("<i", raw, 4)[0] + 50
        number = next(o + (pos >> s) for o, s in ((4681, 14), (585, 17), (73, 20), (9, 23), (1, 26), (0, 29)) if pos >> s == (end - 1) >> s)
        bins.setdefault(number, []).append((start, blocks.tell()))
        for k in range(pos >> 14, ((end - 1) >> 14) + 1):
            linear.setdefault(k, start)
    n = max(linear) + 1
    offsets, last = [], 0
    for k in range(n):
        last = linear.get(k, last)
        offsets.append(last)
    body = b"".join(struct.pack("<Ii", b, len(c)) + b"".join(struct.pack("<QQ", *x) for x in c) for b, c in bins.items())
    return b"BAI\1" + struct.pack("<ii", 1, len(bins)) + body + struct.pack("<i", n) + struct.pack(f"<{n}Q", *offsets)


def _bam():
    data = b"BAM\1" + struct.pack("<ii", 0, 1) + struct.pack("<i", 5) + b"chr1\0" + struct.pack("<i", 1_000_000)
    for _, name, flag, _, pos, mapq, cigar, seq, qual, nm, md, sm in golden.rows():
        ops = [(2, 4), (48, 0)] if cigar == "2S48M" else [(50, 0)]
        codes = ["=ACMGRSVTWYHKDBN".index(c) for c in seq]
        body = struct.pack("<iiBBHHHiiii", 0, pos, len(name) + 1, mapq, 0, len(ops), flag, len(seq), -1, -1, 0) + name.encode() + b"\0"
        body += b"".join(struct.pack("<I", n << 4 | op) for n, op in ops) + bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2])) + bytes(qual)
        body += b"NMC" + bytes([nm]) + b"MDZ" + md.encode() + b"\0" + (b"SMC" + bytes([sm]) if sm is not None else b"")
        data += struct.pack("<i", len(body)) + body
    return _bgzf(data)


@pytest.mark.parametrize("strategy", ["bins", "explode"])
def test_golden_lines(spark, strategy):
    reads = spark.createDataFrame(golden.rows(), READ)
    sites = spark.createDataFrame([("chr1", p, i, 0) for i, p in enumerate((944753, 924730, 930299, 924730))] + [("chrX", 5, 9, 0)], "chrom string, pos long, bed_line long, within_line long")
    contigs = spark.createDataFrame([("chr1", 0, 1_000_000)], CONTIG)
    tiles = spark.createDataFrame([("chr1", (p - 1) // 4096 * 4096, "a" * ((p - 1) % 4096) + b) for p, b in ((924730, "c"), (930299, "c"), (944753, "g"))], TILE)
    got = [r["value"] for r in lines(pileup(reads, sites, contigs, tiles, PileupConfig(strategy=strategy, exact=True))).collect()]
    assert got == golden.lines()
    twice = pileup(reads, sites, contigs, tiles, PileupConfig(duplicates="last")).where("pos = 924730").orderBy("bed_line").select("depth").collect()
    assert [r["depth"] for r in twice] == [0, 1]


@pytest.mark.parametrize("kind", ["sam", "bam"])
def test_command_line(spark, tmp_path, kind):
    _fasta(tmp_path / "g.fa")
    (tmp_path / "s.bed").write_text("# sites\ntrack x\n" + golden.SITES)
    (tmp_path / "r.sam").write_text(golden.sam())
    (tmp_path / "r.bam").write_bytes(_bam())
    cli.main(["-f", f"{tmp_path}/g.fa", "-l", f"{tmp_path}/s.bed", "-o", f"{tmp_path}/out", f"{tmp_path}/r.{kind}"], spark)
    assert (tmp_path / "out").read_text().splitlines() == golden.lines()


@pytest.mark.parametrize("extra", ["", "chr1\t5\t5\n"])
def test_command_line_reads_by_index(spark, tmp_path, extra):
    """With an index beside the file the same lines come out, from the chunks that the sites lead to."""
    _fasta(tmp_path / "g.fa")
    (tmp_path / "s.bed").write_text(golden.SITES + extra)
    (tmp_path / "r.bam").write_bytes(_bam())
    (tmp_path / "r.bam.bai").write_bytes(_index(tmp_path / "r.bam"))
    cli.main(["-f", f"{tmp_path}/g.fa", "-l", f"{tmp_path}/s.bed", "-o", f"{tmp_path}/out", f"{tmp_path}/r.bam"], spark)
    assert (tmp_path / "out").read_text().splitlines()[bool(extra) :] == golden.lines()


def test_bam_regions(spark, tmp_path):
    """Reads come once, however regions overlap, and only those over a region."""
    sources(spark)
    (tmp_path / "r.bam").write_bytes(_bam())
    (tmp_path / "r.bam.bai").write_bytes(_index(tmp_path / "r.bam"))
    reads = [r[0:2] + (r[4],) for r in golden.rows()]
    over = lambda *spans: sorted(name for _, name, pos in reads if any(pos < b and pos + 48 > a for a, b in spans))
    load = lambda text: sorted(r["qname"] for r in spark.read.format("bam").option("regions", text).load(f"{tmp_path}/r.bam").collect())
    first, last = min(r[2] for r in reads), max(r[2] for r in reads)
    assert load(f"chr1:{first}-{first + 10},chr1:{first + 5}-{first + 20},chr1:{first}-{last + 1}") == over((first, last + 1))
    assert load(f"chr1:{first}-{first + 1},chrX:0-9") == over((first, first + 1)) and load("chr1:0-10") == [] and load("chrX:0-9") == []
    assert load(f"chr1:{first}-{first + 1},chr1:{last}-{last + 1}") == over((first, first + 1), (last, last + 1))


def test_traces_by_their_own_header(spark, tmp_path):
    for name, text in (("a/trace1.txt", "task\tname\tstatus\trealtime\n1\tCOUNT (s1)\tCOMPLETED\t3m\n"), ("b/trace2.txt", "status\tname\trealtime\r\nCOMPLETED\tCOUNT (s2)\t5s\r\n"), ("b/trace3.txt", "name\tstatus\nCOUNT (s3)\tCACHED"), ("trace4.txt", ""), ("other.txt", "name\nCOUNT (s9)\n")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text, newline="")
    got = sorted(tuple(r) for r in tables.traces(spark, str(tmp_path)).collect())
    assert got == [("COUNT (s1)", "COMPLETED", "3m"), ("COUNT (s2)", "COMPLETED", "5s"), ("COUNT (s3)", "CACHED", None)]
    assert sorted(tuple(r) for r in timing.trace_max(tables.traces(spark, str(tmp_path)), "COUNT").collect()) == [("s1", 180.0), ("s2", 5.0)]
    metrics = spark.createDataFrame([("s1", 9.0), ("s4", 8.0)], "sample_id string, rs_wall_s double")
    assert sorted(tuple(r) for r in tables.with_timings(metrics, timing.trace_max(tables.traces(spark, str(tmp_path)), "COUNT")).collect()) == [("s1", 9.0, 180.0), ("s4", 8.0, None)]


def test_samples_are_parsed_once(spark, tmp_path):
    for side, name in (("ours", "s1"), ("ours", "s2"), ("theirs", "s1"), ("theirs", "s2"), ("theirs", "s3")):
        (tmp_path / side / name).mkdir(parents=True)
        (tmp_path / side / name / "counts.txt").write_text("\n".join(golden.lines()) + "\n")
    left = spark.createDataFrame([("s3",)], "sample_id string")
    run = lambda: dict(tables.parse_samples(spark, f"{tmp_path}/ours/*/counts.txt", f"{tmp_path}/theirs/*/counts.txt", f"{tmp_path}/pairs", left).collect())
    assert run() == {"s1": "pending", "s2": "pending", "s3": "excluded"} and run() == {"s1": "done", "s2": "done", "s3": "excluded"}
    assert spark.read.parquet(f"{tmp_path}/pairs").groupBy("sample_id").count().orderBy("sample_id").collect() == [("s1", 5), ("s2", 5)]


def test_report_formats(spark):
    got = spark.createDataFrame([(n,) for n in (7, 999, 1000, 2_540_000, 2_104_474_278)], "n long").select(fmt.human_count(F.col("n"))).collect()
    assert [r[0] for r in got] == ["7", "999", "1k", "2.5M", "2.10B"]


def test_bam_fields(spark, tmp_path):
    sources(spark)
    (tmp_path / "r.bam").write_bytes(_bam())
    got = spark.read.format("bam").load(f"{tmp_path}/r.bam").orderBy("ord").collect()
    assert [tuple(r)[1:] for r in got] == [r[1:] for r in golden.rows()]


QUAL_CASES = [(False, [30] * 10, 0, 0, 8, 8), (True, [30] * 10, 0, 0, -1, 0), (False, [30] * 7 + [2] * 3, 0, 0, 5, 5), (True, [2] * 3 + [30] * 7, 0, 0, 2, 2), (False, [2] * 10, 0, 0, -1, 9), (True, [2] * 10, 0, 0, -1, 0), (False, [30] + [2] * 9, 0, 0, -1, 9), (False, [30] * 10, 0, 4, 8, 6), (False, [30] * 10, 0, 1, 8, 8), (True, [30] * 10, 3, 0, -1, 3), (False, [30], 0, 0, -1, 0)]
MD_CASES = [("12", "12M", 0), ("3A8", "12M", 13), ("3A0C0G6", "12M", 15), ("3A1C6", "12M", 28), ("4A0^GG0C6", "5M2D7M", 15), ("4A0C5", "5M1I6M", 30), ("4A0C6", "5M100N7M", 15), ("0A11", "12M", 10), ("11A0", "12M", 21), ("3N8", "12M", 13), ("2A6", "3S9M", 15), (None, "12M", 0)]


def test_quality_tails_and_mismatch_runs(spark):
    rows = [(i, "q", 16 * rev, "c", 0, 60, (f"{a}S" if a else "") + f"{len(q) - a - b}M" + (f"{b}S" if b else ""), "A" * len(q), q, 0, None, None) for i, (rev, q, a, b, _, _) in enumerate(QUAL_CASES)]
    got = observe.scan(spark.createDataFrame(rows, READ)).orderBy("ord").collect()
    assert [(r["q2_pos"], r["three_prime_index"]) for r in got] == [c[4:] for c in QUAL_CASES]
    rows = [(i, "m", 0, "c", 0, 60, cigar, "A" * 12, [10 + k for k in range(12)], 0, md, None) for i, (md, cigar, _) in enumerate(MD_CASES)]
    got = observe.scan(spark.createDataFrame(rows, READ)).orderBy("ord").collect()
    assert [r["sum_mismatch_quals"] for r in got] == [c[2] for c in MD_CASES]


def test_read_edges(spark):
    rows = [(i, "r", flag, "c", 9, 60, "5M", seq, qual, -3, None, sm) for i, (flag, seq, qual, sm) in enumerate([(4, "AAAAA", [9] * 5, None), (0x800, "=RAAA", [255] * 5, None), (2, "AAAAA", [9] * 5, None), (2, "AAAAA", [9] * 5, 300)])]
    sites = spark.createDataFrame([("c", 10), ("c", 11)], "chrom string, pos long")
    got = observe.observations(spark.createDataFrame(rows, READ), sites, PileupConfig()).orderBy("ord", "pos").collect()
    assert [(r["ord"], r["base"], r["base_qual"], r["se_mapq"]) for r in got] == [(1, "N", 255, 60), (1, "N", 255, 60), (2, "A", 9, None), (2, "A", 9, None), (3, "A", 9, 255), (3, "A", 9, 255)]
    assert observe.observations(spark.createDataFrame(rows, READ), sites, PileupConfig(max_depth=0)).count() == 0


def test_bed(spark, tmp_path):
    (tmp_path / "a.bed").write_bytes(b"chr1\t5\t5\r\nchr1\t7\t9\textra\n\nchr1\t9\t7\nbrowser x\nchr10\t+1\t2\n")
    assert sorted((r["chrom"], r["pos"], r["bed_line"]) for r in bed.read_sites(spark, f"{tmp_path}/a.bed").collect()) == [("chr1", 5, 1), ("chr1", 8, 2), ("chr1", 9, 2), ("chr10", 2, 6)]
    for bad in ("chr1\t5", "chr1\tx\t9", "chr1\t 5\t9"):
        (tmp_path / "b.bed").write_text("# c\n" + bad + "\n")
        with pytest.raises(Exception, match="line 2"):
            bed.read_sites(spark, f"{tmp_path}/b.bed").collect()


def test_chunks(spark):
    count = lambda pos: S.chunks(spark.createDataFrame([("c", p, i, 0) for i, p in enumerate(pos)], "chrom string, pos long, bed_line long, within_line long")).select("island", "chunk").distinct().count()
    assert [count(range(201)), count([1, 50_001]), count([1, 50_002])] == [2, 1, 2]


def test_two_decimals(spark):
    values = [0.125, 0.375, 0.015, 2.675, 16.575, 49.995, 93.445, 114.445, 0.0, 60.0, 0.005, 123456.785] + [i / 7 for i in range(500)] + [i / 200 for i in range(2000)]
    got = spark.createDataFrame([(v,) for v in values], "x double").select(fmt.fmt2(F.col("x"))).collect()
    assert [r[0] for r in got] == [f"{v:.2f}" for v in values]


def test_durations_and_parsing(spark):
    rows = spark.createDataFrame([("1m 30s",), ("250ms",), ("1h 2m",), ("1.5s",), ("-",), ("",), ("abc",)], "t string")
    assert [r[0] for r in rows.select(timing.seconds(F.col("t"))).collect()] == [90, 0.25, 3720, 1.5, None, None, None]
    text = spark.createDataFrame([(x,) for x in [*golden.lines(), "short\tline", ""]], "value string")
    assert parity.parse_long(text).count() == 5
    assert parity.statistics(parity.joined(parity.parse_long(text), parity.parse_long(text.union(text)))).where("pct_printed_eq = 100 AND n_full = 5").count() == 13


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    d = "/root/testdata/sf0.001"
    rows = QUERIES[name](spark, d).toPandas()
    assert len(rows)
    if name not in ORACLE:
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    want = con.execute(ORACLE[name]).df()
    assert sorted(rows.columns) == sorted(want.columns) and len(rows) == len(want)
    text = lambda df: sorted(tuple("None" if pd.isna(v) else f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in df[sorted(want.columns)].astype(object).itertuples(index=False))
    norm = lambda rows_: [tuple(x[:-2] if x.endswith(".0") else x for x in r) for r in rows_]
    a, b = norm(text(rows)), norm(text(want))
    close = lambda x, y: x == y or x[0] in "-0123456789" and y[0] in "-0123456789" and abs(float(x) - float(y)) <= 2e-6 + 1e-5 * abs(float(y))
    assert all(all(map(close, r, s)) for r, s in zip(a, b)), [(r, s) for r, s in zip(a, b) if r != s][:2]


def test_plan_has_no_cartesian_product(spark):
    plan = QUERIES["full_metrics"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("gap", [50_000, 200_000, 3])
def test_chunks_by_spans(spark, gap):
    """Islands and chunks are those of one pass over each contig, and no window holds a contig's sites."""
    draw = random.Random(1)
    rows = [(f"c{draw.randrange(3)}", draw.choice([draw.randrange(40), draw.randrange(60_000, 70_000), 65_536 * draw.randrange(40)]), i, draw.randrange(2)) for i in range(3000)]
    want, last, state = {}, {}, {}
    for r in sorted(rows):
        island, n = state.get(r[0], (0, -1))
        island, n = (island + 1, 0) if r[0] in last and r[1] - last[r[0]] > gap else (island, n + 1)
        state[r[0]], last[r[0]], want[r] = (island, n), r[1], (island, n // 20)
    got = S.chunks(spark.createDataFrame(rows, SITE), 20, gap)
    assert {tuple(r)[:4]: tuple(r)[4:] for r in got.collect()} == want
    windows = [x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window [" in x and "bed_line" in x]
    assert windows and all(re.search(r"\[chrom#\d+, pos#\d+L?\], \[bed_line", x) for x in windows)
