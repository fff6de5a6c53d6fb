"""Best-fit packing of documents into sequences of a fixed number of tokens.

Packing needs lengths only, and a length is one of ``capacity`` values. So the tasks count pieces by length, the driver packs the
histogram (``capacity`` counters, whatever the corpus), and each piece finds its place by its rank among pieces of its length.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .pretoken import encoder_of, tokenizer_content
from .scratch import Scratch

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Packs counts[length] pieces of each length; returns (lengths of a bin, number of such bins).

    Pieces above a third of the capacity pair at most twice per bin: the longest takes the longest that still fits, greedily. The
    smaller ones, longest first, go to the fullest bin with room (best fit); new bins open only when none has room. All
    steps move whole runs of equal bins, so time depends on the number of lengths, not of pieces.
    """
    left = {n: k for n, k in counts.items() if k and 0 < n <= capacity}
    large = sorted(n for n in left if 3 * n > capacity)
    bins: dict[tuple[int, ...], int] = defaultdict(int)
    while large:
        n = large[-1]
        at = bisect.bisect_right(large, capacity - n) - 1
        if at < 0:
            k, shape = left[n], (n,)
        else:
            m = large[at]
            k, shape = (left[n] // 2, (n, m)) if m == n else (min(left[n], left[m]), (n, m))
            if k == 0:  # one piece of this length is left
                if at == 0:
                    k, shape = 1, (n,)
                else:
                    m = large[at - 1]
                    k, shape = 1, (n, m)
        bins[shape] += k
        for x in shape:
            left[x] -= k
        large = [x for x in large if left[x]]
    gaps: list[dict[tuple[int, ...], int]] = [defaultdict(int) for _ in range(capacity + 1)]
    for shape, k in bins.items():
        gaps[capacity - sum(shape)][shape] += k
    for n in sorted((x for x in left if 3 * x <= capacity), reverse=True):
        k = left[n]
        while k:
            gap = next((g for g in range(n, capacity + 1) if gaps[g]), None)
            if gap is None:
                each = capacity // n
                full, rest = divmod(k, each)
                if full:
                    gaps[capacity - n * each][(n,) * each] += full
                if rest:
                    gaps[capacity - n * rest][(n,) * rest] += 1
                break
            shape, have = gaps[gap].popitem()
            fit = gap // n
            full, rest = divmod(k, fit)
            used = min(have, full)
            if used:
                gaps[gap - n * fit][shape + (n,) * fit] += used
                k -= used * fit
                have -= used
            if have and k:  # fewer are left than one more bin takes
                gaps[gap - n * k][shape + (n,) * k] += 1
                have -= 1
                k = 0
            if have:
                gaps[gap][shape] += have
    return [(shape, k) for by in gaps for shape, k in sorted(by.items()) if k]


def places(plan: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """For ranks of each length, runs of places: from rank ``rank`` of ``length`` on, sequences from ``first`` at ``offset``."""
    seen: dict[int, int] = defaultdict(int)
    out: list[tuple[int, int, int, int]] = []
    first = 0
    for shape, k in plan:
        offset = 0
        for n in shape:
            out.append((n, seen[n], first, offset))
            seen[n] += k
            offset += n
        first += k
    out.sort()
    return dict(zip(("length", "rank", "first", "offset"), np.array(out or np.zeros((0, 4)), np.int64).reshape(-1, 4).T))


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 1024, id_column: str = "doc_id", text_column: str = "text", keep_ids: bool = False) -> DataFrame:
    """Cuts documents of more than ``capacity`` tokens (end id included) and packs all pieces; one row per piece.

    Only longer documents are cut, into pieces of ``capacity``; their first piece holds the remainder. Columns: doc_id, piece, start,
    length, ids_crc32, sequence_id, offset, and with ``keep_ids`` the piece's ids. A null or empty text is the end id alone. Equal or null
    doc_ids are separate documents. Other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    content = spark.sparkContext.broadcast(tokenizer_content(tokenizer))
    end = np.array([end_id], "<u4").tobytes()
    schema = PIECES + (", ids array<int>" if keep_ids else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, ranks = encoder_of(content.value), TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            cols: list[list] = [[] for _ in range(8)]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encoder.packed(text) + end
                n = len(ids) // 4
                edge, piece, start = (n - 1) % capacity + 1, 0, 0
                while start < n:
                    own = ids[4 * start : 4 * edge]
                    for col, x in zip(cols, (doc, piece, start, edge - start, zlib.crc32(own), part, ranks[edge - start], np.frombuffer(own, np.int32) if keep_ids else None)):
                        col.append(x)
                    ranks[edge - start] += 1
                    piece, start, edge = piece + 1, edge, edge + capacity
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32())]
            k = 8 if keep_ids else 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols[:k], types)], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank", "ids"][:k])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    pieces = scratch.write(rows.mapInArrow(cut, schema), "pieces")
    local = scratch.write(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "counts")
    counts = {r["length"]: r["n"] for r in local.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    table = spark.sparkContext.broadcast(places(plan_bins(counts, capacity)))
    base = local.select("part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("base"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table.value
        shift = 1 << 48
        keys = t["length"] * shift + t["rank"]
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            at = np.searchsorted(keys, length * shift + rank, "right") - 1
            out = {n: b.column(n) for n in b.schema.names if n != "rank"}
            out |= {"sequence_id": pa.array(t["first"][at] + rank - t["rank"][at]), "offset": pa.array(t["offset"][at])}
            yield pa.RecordBatch.from_pydict(out)

    kept = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids]
    ranked = pieces.join(base, ["part", "length"]).select(*kept, (F.col("base") + F.col("rank")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids + ", sequence_id long, offset long")
