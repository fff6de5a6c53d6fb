"""Document fingerprints from a randomised edit embedding.

A walk reads the text with one pointer and emits the pointer's character at every step; a random bit, shared by all documents and
chosen by step and character, says whether the pointer moves on. Texts at a small edit distance drift apart at an edit and meet
again soon after, so their embeddings are close in Hamming distance. A fingerprint samples the embedding at positions shared by all
documents. The walk reads the whole text.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, components

PERIOD, CLASSES = 4096, 64
SLOTS, GRAM = 128, 4


@lru_cache(1)
def _walk() -> tuple[list[list[int]], np.ndarray]:
    """How many steps a character of each class stays, by the step modulo PERIOD; and each slot's sampled positions.

    A slot samples the position of least priority below the embedding's length. Only positions that lower the minimum matter; from
    one of them the next is found by one random number, as if each position had drawn a priority.
    """
    rng = np.random.default_rng(20_240_601)
    bits = rng.integers(0, 2, (CLASSES, PERIOD)).astype(bool)
    bits[:, -1] = True
    stay = np.zeros((CLASSES, PERIOD), np.int64)
    for t in range(PERIOD - 1, -1, -1):
        stay[:, t] = np.where(bits[:, t], 1, 1 + stay[:, (t + 1) % PERIOD])
    records = []
    draw = random.Random(7)
    for _ in range(SLOTS):
        row, at = [0], 0
        while at < 1 << 40:
            at = int((at + 1) / (1.0 - draw.random())) + (at == 0)
            row.append(at)
        records.append(row)
    wide = max(map(len, records))
    return stay.tolist(), np.array([r + [1 << 62] * (wide - len(r)) for r in records], np.int64)


class _Rows(dict):
    def __missing__(self, ch: str) -> list[int]:
        self[ch] = row = _walk()[0][(ord(ch) * 0x9E3779B1 >> 12) % CLASSES]
        return row


_ROWS = _Rows()


def _times(text: str, step: int = 0) -> list[int]:
    """The step at which the walk leaves each character, having begun at ``step``."""
    out, rows, mask = [], _ROWS, PERIOD - 1
    add = out.append
    for ch in text:
        step += rows[ch][step & mask]
        add(step)
    return out


def _sample(text: str, times: np.ndarray) -> bytes:
    """One byte for each slot, 0 only for the empty text: the hash of the characters at the sampled position."""
    if not len(times):
        return bytes(SLOTS)
    records = _walk()[1]
    at = records[np.arange(SLOTS), (records < times[-1]).sum(1) - 1]
    i = np.searchsorted(times, at, "right")
    codes = np.zeros(len(times) + GRAM, np.uint64)
    codes[: len(times)] = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    h = np.zeros(SLOTS, np.uint64)
    for k in range(GRAM):
        h = (h + codes[i + k] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h % np.uint64(255) + np.uint64(1)).astype(np.uint8).tobytes()


def fingerprint(text: str | None) -> bytes:
    text = text or ""
    return _sample(text, np.array(_times(text), np.int64))


def likeness(a: bytes, b: bytes) -> float:
    """The share of equal slots."""
    return float((np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8)).mean())


def _ordered(docs: DataFrame, id_column: str, text_column: str, parts: int) -> DataFrame:
    """Rows by (part, tail, key, text): parts are ranges of ids, each followed by a tail row, the first document of the next part.

    Part bounds are quantiles of all ids and heads one id for each part: ``parts`` values, whatever the corpus.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(id_column).cast("long"), F.lit(-(1 << 63))).alias("key"), F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    cuts = rows.agg(F.percentile_approx("key", [i / parts for i in range(1, parts)] or [0.5], 10 * parts).alias("cuts")).first()["cuts"] or []
    cuts = sorted(set(cuts)) if parts > 1 else []
    found = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<long>"), lambda c: c <= F.col("key"))) if cuts else F.lit(0)
    rows = rows.withColumn("part", found)
    heads = sorted((r["part"], r["key"]) for r in rows.groupBy("part").agg(F.min("key").alias("key")).collect())
    tails = spark.createDataFrame([(key, heads[i - 1][0]) for i, (_, key) in enumerate(heads)], "key long, before int")
    both = rows.join(F.broadcast(tails), "key", "left").select("key", "doc_id", "text", F.explode(F.expr("if(before is null, array(struct(part, false AS tail)), array(struct(part, false AS tail), struct(before AS part, true AS tail)))")).alias("p"))
    return both.select("p.part", "p.tail", "key", "doc_id", "text").repartition("part").sortWithinPartitions("part", "tail", "key", "text")


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_chars and fingerprint (hex) of every whole text. A null text counts as empty; equal texts have equal fingerprints."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, texts), pa.int64()), pa.array([fingerprint(t).hex() for t in texts], pa.string())], names=["doc_id", "n_chars", "fingerprint"])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(each, "doc_id long, n_chars long, fingerprint string")


def edited_report(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and how alike they are.

    The edit replaces the last quarter of a text's code points (rounded down) by as many of the next document's first ones, or all it has.
    The next document is the next by id (nulls first; equal ids by text), of the last the first. A table of one document is its own
    next. Columns other than the two named are not read; an empty table gives no rows.
    """
    parts = min(4096, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    out = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in out.split(", ")]
        held = None
        for b in batches:
            rows = []
            for part, tail, _, doc, text in zip(*(c.to_pylist() for c in b.columns)):
                times = np.array(_times(text), np.int64)
                now = (part, doc, text, times, _sample(text, times))
                if held and held[0] == part:
                    rows.append(_compare(held, text, now[4]))
                held = None if tail else now
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *((n, pa.string()) for n in names[2:5]), *((n, pa.float64()) for n in names[5:])]))

    return _ordered(docs, id_column, text_column, parts).mapInArrow(each, out)


def _compare(held: tuple, after: str, after_print: bytes) -> tuple:
    _, doc, text, times, own = held
    n = len(text)
    keep = n - n // 4
    edited = text[:keep] + after[: n // 4]
    walked = np.concatenate([times[:keep], np.array(_times(edited[keep:], int(times[keep - 1]) if keep else 0), np.int64)])
    changed = _sample(edited, walked)
    return doc, n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), own.hex(), changed.hex(), likeness(own, changed), likeness(own, after_print)


def near_documents(docs: DataFrame, least: float = 0.8, band: int = 8, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Groups of documents with like fingerprints: doc_id, fingerprint, component_id (the least id of the group).

    Documents that agree in all slots of a band meet there; a band of 8 of 128 slots, at a likeness of 0.8, agrees with probability 0.17,
    so some of 16 bands agrees with probability 0.95. In each band every document is verified against the band's least one, then
    pairs of the same band that are still apart are verified. Equal fingerprints are one group. Documents with null ids are left out.
    """
    scratch = Scratch(docs.sparkSession, "fingerprints")
    prints = scratch.write(fingerprints(docs.where(F.col(id_column).isNotNull()), id_column, text_column), "prints")
    groups = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("node"))
    wide = 2 * band
    keys = groups.select("node", "fingerprint", F.explode(F.expr(f"transform(sequence(0, {2 * SLOTS // wide - 1}), b -> struct(b AS band, substring(fingerprint, b * {wide} + 1, {wide}) AS bits))")).alias("k")).select("k.*", "node", "fingerprint")
    firsts = keys.groupBy("band", "bits").agg(F.min(F.struct("node", "fingerprint")).alias("f"), F.count("*").alias("n")).where("n > 1")
    equal = sum((F.substring("a_print", 2 * s + 1, 2) == F.substring("b_print", 2 * s + 1, 2)).cast("int") for s in range(SLOTS))
    star = keys.join(firsts, ["band", "bits"]).where("node <> f.node").select(F.col("f.node").alias("u"), F.col("f.fingerprint").alias("a_print"), F.col("node").alias("v"), F.col("fingerprint").alias("b_print")).distinct()
    linked = scratch.write(star.where(equal >= least * SLOTS).select("u", "v"), "star")
    roots = components(scratch, linked, "first")
    apart = keys.join(firsts.select("band", "bits"), ["band", "bits"]).join(roots, "node", "left").select("band", "bits", "node", "fingerprint", F.coalesce("root", "node").alias("root"))
    mixed = apart.groupBy("band", "bits").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("band", "bits")
    some = apart.join(mixed, ["band", "bits"])
    left, right = some.selectExpr("band", "bits", "node AS u", "fingerprint AS a_print", "root AS ru"), some.selectExpr("band", "bits", "node AS v", "fingerprint AS b_print", "root AS rv")
    more = left.join(right, ["band", "bits"]).where("u < v AND ru <> rv").select("u", "v", "a_print", "b_print").distinct().where(equal >= least * SLOTS).select("u", "v")
    final = components(scratch, linked.union(more), "last")
    return prints.join(groups, "fingerprint").join(final, "node", "left").select("doc_id", "fingerprint", F.coalesce("root", "node").alias("component_id"))
