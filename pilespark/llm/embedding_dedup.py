"""Embedding near-dedup by randomised-rotation binary codes.

Vectors are rotated at random; the signs of the rotated coordinates are a code, stored with its correction factor (the inner product of
the vector with its own code). Groups of code bits are bands: vectors that agree in a whole band are compared, first by the number of
code bits in which they differ, so that vectors are moved only for those with a partner that may be near. For these, code and factor give an
unbiased estimate of the inner product with a confidence bound, and only pairs whose bound reaches the threshold are recomputed exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, components

#: Vectors of one comparison task; larger buckets are split into blocks of it, and each pair of blocks is a cell of its own.
BLOCK = 512
#: Pairs whose keys and vectors a comparison task gathers at once.
PAIRS = 20_000
CONFIDENCE = 4.0
#: Standard deviations of the share of differing bits that the screen by codes allows for.
SCREEN = 5.0


#: Below this dimension the directions of one rotation depend on each other too much, and estimates say little: directions are drawn one by one, and all pairs of a cell recomputed.
LOW_DIMENSION = 16


@lru_cache(16)
def directions(dim: int, count: int, seed: int = 17) -> np.ndarray:
    """``count`` directions or one rotation's, if those are more: the rows of random rotations of a dimension, the same in every task. The first ``dim`` are a rotation."""
    rng = np.random.default_rng(seed)
    turns = 1 if dim < LOW_DIMENSION else max(1, -(-count // dim))
    rows = [np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(turns)]
    if dim < LOW_DIMENSION:
        rows.append(rng.standard_normal((max(0, count - dim), dim)))
    return np.concatenate(rows)


def bands_for(rows: int, least: float, recall: float) -> tuple[int, int]:
    """(bits, bands): bits grow with the logarithm of the rows, so buckets of unlike vectors stay small; bands keep the recall at the threshold."""
    bits = max(8, math.ceil(math.log2(max(2, rows))) - 1)
    hit = (1 - math.acos(least) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - hit)))


def _unit(vectors: pa.Array, dim: int) -> np.ndarray:
    """Vectors of one length as rows of length 1. Each is scaled by its largest component first, so that no square overflows or vanishes."""
    x = vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def most_apart(least: float, bits: int) -> int:
    """Code bits in which vectors of cosine ``least`` or more may differ: a bit differs with the chance angle / pi."""
    share = math.acos(least) / math.pi
    return min(bits, math.ceil(bits * share + SCREEN * math.sqrt(bits * share * (1 - share))))


def _pairs_of(cuts: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (i, j), i < j, of rows of the same cell, about ``most`` at a time; cell c has the rows cuts[c] to cuts[c + 1] - 1."""
    ends = np.repeat(cuts[1:], np.diff(cuts))
    after = ends - np.arange(len(ends)) - 1  # partners of each row
    total = np.concatenate([[0], np.cumsum(after)])
    at = 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(total, total[at] + most, "right")) - 1)
        n = after[at:to]
        i = np.repeat(np.arange(at, to), n)
        yield i, i + 1 + np.arange(len(i)) - np.repeat(total[at:to] - total[at], n)
        at = to


def near_duplicates(vectors: DataFrame, least: float = 0.95, recall: float = 0.998, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """vec_id, n_links (other vectors of cosine >= ``least``), component_id (least vec_id reachable), kept (vec_id = component_id).

    Vectors that are null, empty, zero or with null or non-finite components link with nothing; vectors of different lengths are not
    linked. Equal vectors are compared once and counted as often as they occur. Pairs below ``least`` in double precision are never linked;
    ``recall`` is the chance that a pair at exactly ``least`` shares a band. A null vec_id keeps its row, without links and with itself as
    component; a vec_id that occurs twice is two vectors of one component. An empty table gives no rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embeddings")
    given = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("v"))
    given = given.withColumn("ok", F.expr("v is not null and size(v) > 0 and vec_id is not null and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)"))
    given = given.withColumn("ok", F.coalesce("ok", F.lit(False)))
    reps = scratch.write(given.where("ok").groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "reps")
    bits, bands = bands_for(reps.count(), least, recall)
    wide = -(-bits * bands // 8)
    near = most_apart(least, bits * bands)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            sizes = pa.compute.list_value_length(given.column(0)).to_numpy()
            for dim in np.unique(sizes).tolist():
                b = given.filter(pa.array(sizes == dim))
                unit = _unit(b.column(0), dim)
                turned = unit @ directions(dim, bits * bands).T
                sign = turned[:, : bits * bands] > 0
                keys = (sign.reshape(len(unit), bands, bits) * (1 << np.arange(bits, dtype=np.int64))).sum(2)
                code = np.packbits(sign, axis=1).tobytes()
                factor = np.abs(turned[:, :dim]).sum(1) / math.sqrt(dim)
                codes = pa.array([code[i : i + wide] for i in range(0, len(code), wide)], pa.binary())
                key_lists = pa.ListArray.from_arrays(pa.array(np.arange(len(unit) + 1, dtype=np.int32) * bands), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), b.column(0), codes, pa.array(factor), key_lists], names=["rep", "copies", "v", "code", "factor", "keys"])

    index = scratch.write(reps.mapInArrow(encode, "rep long, copies long, v array<double>, code binary, factor double, keys array<long>"), "index")
    dealt = index.select("rep", F.size("v").alias("dim"), "code", F.posexplode("keys").alias("band", "key"))
    sizes = dealt.groupBy("dim", "band", "key").agg(F.count("*").alias("n")).where("n > 1")
    cells = (dealt.join(sizes, ["dim", "band", "key"]).withColumn("blocks", F.expr(f"cast(ceil(n / {BLOCK}) as int)")).withColumn("block", F.expr("cast(pmod(xxhash64(rep), blocks) as int)"))
             .select("rep", "dim", "band", "key", "block", "code", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"))
             .select("rep", "band", "block", "code", F.expr("xxhash64(dim, band, key, least(block, other), greatest(block, other))").alias("cell")))

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a cell with a partner there that is not too far by codes."""
        for t in _cells(batches):
            run, block = t["cell"].to_numpy(), t["block"].to_numpy()
            codes = np.frombuffer(b"".join(t["code"].to_pylist()), np.uint8).reshape(len(run), -1)
            codes = np.pad(codes, ((0, 0), (0, -codes.shape[1] % 8))).view(np.uint64)
            cuts = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1], [True]]))
            crossed = np.repeat(block[cuts[:-1]] != block[cuts[1:] - 1], np.diff(cuts))  # two blocks meet: only their rows with each other
            hit = np.zeros(len(run), bool)
            for i, j in _pairs_of(cuts, 20 * PAIRS):
                apart = np.bitwise_count(codes[i] ^ codes[j]).sum(1, dtype=np.int64)
                may = (apart <= near) & ~(crossed[i] & (block[i] == block[j]))
                hit[i[may]] = hit[j[may]] = True
            kept = t.filter(pa.array(hit))
            yield from kept.select(["cell", "band", "block", "rep"]).combine_chunks().to_batches()

    # A cell has one block's rows, or two blocks' rows that only meet each other.
    screened = scratch.write(cells.repartition("cell").sortWithinPartitions("cell", "block").mapInArrow(screen, "cell long, band int, block int, rep long"), "screened")
    rows = screened.join(index.drop("code"), "rep").select("cell", "band", "block", "rep", "copies", "v", "factor", "keys")
    out = "rep long, links long, other long"

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _cells(batches):
            v = group["v"].combine_chunks()
            dim = len(v[0])
            unit, turn = _unit(v, dim), directions(dim, bits * bands)[:dim]
            n = len(unit)
            rep, copies, block = (group[c].to_numpy() for c in ("rep", "copies", "block"))
            keys = group["keys"].combine_chunks().flatten().to_numpy().reshape(n, bands)
            run = group["cell"].to_numpy()
            band = group["band"].to_numpy()
            turned = (unit @ turn.T).astype(np.float32)
            signs = np.where(turned > 0, np.float32(1), np.float32(-1))
            factor = group["factor"].to_numpy()
            slack = CONFIDENCE * np.sqrt(np.maximum(0, 1 - factor**2)) / (factor * math.sqrt(max(1, dim - 1)))
            if dim < LOW_DIMENSION:
                slack = np.full(n, np.inf)
            cuts = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1], [True]]))
            left, right = [], []
            for i, j in zip(cuts[:-1], cuts[1:]):
                if j - i < 2:
                    continue
                bound = signs[i:j] @ turned[i:j].T / (math.sqrt(dim) * factor[i:j, None]) + slack[i:j, None]
                may = np.triu(bound >= least, 1)
                if block[i] != block[j - 1]:
                    may &= block[i:j, None] != block[None, i:j]
                a, b = np.nonzero(may)
                left.append(a + i)
                right.append(b + i)
            if not left:
                continue
            a, b = np.concatenate(left), np.concatenate(right)
            close = []
            for start in range(0, len(a), PAIRS):
                p, q = a[start : start + PAIRS], b[start : start + PAIRS]
                # A pair counts in the first band that it shares.
                first = (keys[p] == keys[q]).argmax(1) == band[p]
                close.append(first)
                first[first] = np.einsum("ij,ij->i", unit[p[first]], unit[q[first]]) >= least
            if not close:
                continue
            close = np.concatenate(close)
            a, b = a[close], b[close]
            links = np.bincount(a, copies[b], n) + np.bincount(b, copies[a], n)
            least_of = rep.copy()
            while True:  # the least rep reachable inside this cell
                low = np.minimum(least_of[a], least_of[b])
                before = least_of.copy()
                np.minimum.at(least_of, a, low)
                np.minimum.at(least_of, b, low)
                if (before == least_of).all():
                    break
            hit = links > 0
            yield pa.RecordBatch.from_arrays([pa.array(rep[hit]), pa.array(links[hit].astype(np.int64)), pa.array(least_of[hit])], names=["rep", "links", "other"])

    found = scratch.write(rows.withColumn("dim", F.size("v")).repartition("cell").sortWithinPartitions("dim", "cell", "block", "rep").mapInArrow(compare, out), "found")
    roots = components(scratch, found.selectExpr("rep AS u", "other AS v"))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    nodes = reps.select("v", "rep", "copies").join(links, "rep", "left").join(roots, F.col("rep") == F.col("node"), "left").select("v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    linked = given.where("ok").join(nodes, "v", "left")
    every = linked.select("vec_id", "n_links", "component_id").union(given.where("not ok").select("vec_id", F.lit(None).cast("long"), F.lit(None).cast("long")))
    component = F.coalesce("component_id", "vec_id")
    return every.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))


def _cells(batches: Iterator[pa.RecordBatch], most: int = 4096) -> Iterator[pa.Table]:
    """Tables of whole cells: rows come sorted by cell, and a cell's rows may lie in several batches. Rows with ``dim`` come sorted by it first, and a table has one."""
    held: pa.Table | None = None
    for b in batches:
        for at in range(0, b.num_rows, most):
            now = pa.Table.from_batches([b.slice(at, most)])
            held = now if held is None else pa.concat_tables([held, now])
            cell = held["cell"].to_numpy()
            end = int(np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))[-1])
            if end:
                yield from _by_dim(held.slice(0, end))
                held = held.slice(end)
    if held is not None and held.num_rows:
        yield from _by_dim(held)


def _by_dim(t: pa.Table) -> Iterator[pa.Table]:
    if "dim" not in t.schema.names:
        yield t
        return
    dim = t["dim"].to_numpy()
    cuts = np.flatnonzero(np.concatenate([[True], dim[1:] != dim[:-1], [True]]))
    for i, j in zip(cuts[:-1], cuts[1:]):
        yield t.slice(i, j - i)
