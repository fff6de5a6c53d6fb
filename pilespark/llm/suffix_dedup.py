"""Removal of byte strings that occur more than once, by suffix arrays over the places where texts can repeat.

Every window of ``length`` bytes holds the k-gram of least hash among its k-grams, its anchor; equal windows have equal anchors at
equal offsets. So only text around anchors that occur twice can repeat. Where the whole surroundings (all windows over the anchor) are
equal, all is repeated. Where they differ, their distinct versions are put into a suffix array, and neighbours in it with a common
prefix of ``length`` bytes are the repeated windows. The array is built in two stages: suffixes smaller than their successors are sorted
directly, the rest are induced by scanning buckets.

Two versions with a common window agree on half of what a window has besides its anchor, before the anchor or after it. Versions that
share neither half with another one are left out, and an anchor with very many versions gets an array for each half that is shared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

GRAM = 40
#: Bytes by which tied suffixes are read on where they agree.
STRIDES = (160, 64, 16)
#: Text that a task holds at once for anchors (numbers about it fit the processor's cache) and for one suffix array.
CHUNK = 1 << 17
ARRAY = 1 << 20
#: Distinct surroundings of one anchor that one suffix array takes; more are dealt out by the halves that they share. If one half has
#: more, its versions are dealt out again, and their windows are also compared by hash.
GROUP = 4096
#: Bits of the filters of anchors: LEAST_BITS, or eight for each anchor, up to MOST_BITS (64 MB). What they let through too much a join drops.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 29
_BASE = 0x9E3779B97F4A7C15
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.cumprod(np.full(n, _BASE, _U)), np.cumprod(np.full(n, pow(_BASE, -1, 1 << 64), _U))


def _sums_of(data: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hashes of the ``width`` bytes at each position that has so many."""
    if len(data) < width:
        return np.zeros(0, _U)
    power, back = _powers(-(-len(data) // CHUNK) * CHUNK)
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * power[: len(data)], out=sums[1:])
    return (sums[width:] - sums[:-width]) * back[: len(data) - width + 1]


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Of all windows inside the texts data[starts:ends]: positions of their anchors, the k-grams' hashes, and the first and the last window that has each anchor."""
    gram = min(GRAM, length)
    n = len(data) - gram + 1
    wide = length - gram + 1
    long = ends - starts >= length
    if n < wide or not long.any():
        return np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams = mix(_sums_of(data, gram))
    low = grams >> _U(32) << _U(32) | np.arange(n, dtype=_U)
    cover = 1
    while 2 * cover <= wide:
        low = np.minimum(low[:-cover], low[cover:])
        cover *= 2
    if wide > cover:
        low = np.minimum(low[: cover - wide], low[wide - cover :])
    inside = np.zeros(len(data) + 1, np.int32)
    inside[starts[long]] += 1  # no two texts begin at one place, nor end
    inside[ends[long] - length + 1] -= 1
    windows = np.flatnonzero(np.cumsum(inside[: len(low)]) > 0)
    at = (low[windows] & _U(0xFFFFFFFF)).astype(np.int64)
    cut = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return at[cut], grams[at[cut]], windows[cut], windows[np.concatenate([cut[1:], [len(windows)]]) - 1]


def words_of(data: np.ndarray) -> np.ndarray:
    """At each position the next 8 bytes as a big-endian number, zeros after the end."""
    out, padded = np.zeros(len(data), _U), np.concatenate([data, np.zeros(8, np.uint8)])
    for i in range(8):
        out = out << _U(8) | padded[i : i + len(data)]
    return out


def suffix_array(data: np.ndarray, depth: int, words: np.ndarray | None = None, group: np.ndarray | None = None, wanted: np.ndarray | None = None) -> np.ndarray:
    """Suffixes of bytes ordered by their first ``depth`` bytes at least (the end sorts before any byte).

    ``group``: ascending numbers of the stretches to order by themselves, one after the other; each ends with a byte below all others.
    ``wanted``: marks the suffixes to order; the few after each run of them from which they are induced come along.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    words = words_of(data) if words is None else words
    group = np.zeros(n, np.uint16) if group is None else group.astype(np.uint16 if group[-1] < 1 << 16 else np.int64)
    # Smaller than its successor: the next differing byte is larger. The last suffix is larger than the empty one.
    rise = np.zeros(n, np.int8)
    rise[:-1] = np.sign(data[1:].astype(np.int16) - data[:-1])
    rise[-1] = -1
    following = np.where(rise != 0, np.arange(n), n)
    following = np.minimum.accumulate(following[::-1])[::-1]
    small = rise[following] > 0
    if wanted is None:
        wanted = np.ones(n, bool)
    else:
        ends = np.flatnonzero(wanted & ~np.concatenate([wanted[1:], [False]]))
        until = np.minimum.accumulate(np.where(small, np.arange(n), n - 1)[::-1])[::-1][ends]
        more = np.zeros(n + 1, np.int32)
        more[ends] += 1
        more[until + 1] -= 1
        wanted = wanted | (np.cumsum(more[:n]) > 0)
    direct = _sorted(np.flatnonzero(small & wanted), words, depth, group, [(w, _sums_of(data, w)) for w in STRIDES])
    direct = direct[np.argsort(data[direct], kind="stable")]
    counts = np.bincount(data[direct], minlength=256)
    cuts = np.concatenate([[0], np.cumsum(counts)])
    heads: list[list[np.ndarray]] = [[] for _ in range(256)]
    heads[data[-1]].append(np.flatnonzero(wanted[-1:]) + n - 1)
    out = []
    for c in range(256):
        parts, wave = [], np.concatenate(heads[c]) if heads[c] else np.zeros(0, np.int64)
        while len(wave):  # larger suffixes of this byte, then those that begin with the byte once more
            parts.append(wave)
            before = wave[wave > 0] - 1
            wave = before[(data[before] == c) & wanted[before]]
        parts.append(direct[cuts[c] : cuts[c + 1]])
        bucket = np.concatenate(parts)
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[(data[before] > c) & wanted[before]]
        if len(before):
            firsts = data[before]
            order = np.argsort(firsts, kind="stable")
            before, firsts = before[order], firsts[order]
            at = np.flatnonzero(np.concatenate([[True], firsts[1:] != firsts[:-1]]))
            for chunk in np.split(before, at[1:]):
                heads[data[chunk[0]]].append(chunk)
    array = np.concatenate(out)
    return array[np.argsort(group[array], kind="stable")]


def _sorted(at: np.ndarray, words: np.ndarray, depth: int, group: np.ndarray, sums: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Positions by group, then in the order of their suffixes. A round reads tied suffixes on by a stride where they agree by hash, and sorts the others by the next 5 bytes."""
    n = len(words)
    order = at[np.argsort(words[at])]
    order = order[np.argsort(group[order], kind="stable")]
    key, of = words[order], group[order]
    tied = np.concatenate([[False], (key[1:] == key[:-1]) & (of[1:] == of[:-1])])  # with the one before
    slots = np.flatnonzero(tied | np.concatenate([tied[1:], [False]]))
    tied = tied[slots]
    read = np.full(len(slots), 8, np.int64)  # bytes known to be equal in a slot's ties
    while len(slots):
        ties = np.cumsum(~tied) - 1
        left = np.arange(len(slots))
        for width, hashes in sums:
            far = order[slots[left]] + read[left]
            short = far >= len(hashes)
            ahead = hashes[np.minimum(far, len(hashes) - 1)] if len(hashes) else np.zeros(len(far), _U)
            unlike = short.copy()
            unlike[1:] |= tied[left[1:]] & (ahead[1:] != ahead[:-1])
            mixed = np.zeros(ties[-1] + 1, bool)
            mixed[ties[left[unlike]]] = True
            stay = mixed[ties[left]]
            read[left[~stay]] += width
            left = left[stay]
        if len(left):
            far = order[slots[left]] + read[left]
            # Ties, five bytes and whether there are any in one number: arrays are far too short for 2**23 ties.
            key = ties[left].astype(_U) << _U(41) | np.where(far < n, words[np.minimum(far, n - 1)] >> _U(24) << _U(1) | _U(1), _U(0))
            again = np.argsort(key, kind="stable")
            order[slots[left]] = order[slots[left]][again]
            key = key[again]
            same = np.zeros(len(left), bool)
            same[1:] = (key[1:] == key[:-1]) & (key[1:] & _U(1) == 1)
            tied[left] = same
            read[left] += 5
        keep = (tied | np.concatenate([tied[1:], [False]])) & (read < depth)
        slots, tied, read = slots[keep], tied[keep], read[keep]
    return order


def equal_prefix(array: np.ndarray, words: np.ndarray, length: int) -> np.ndarray:
    """Whether each suffix of the array shares its first ``length`` bytes with the one before; both must have that many."""
    out = np.zeros(len(array), bool)
    if len(array) < 2:
        return out
    left, right, slots = array[:-1], array[1:], np.arange(1, len(array))
    for skip in [*range(0, length - 7, 8), *[length - 8] * (length % 8 > 0)]:
        ok = words[left + skip] == words[right + skip]
        left, right, slots = left[ok], right[ok], slots[ok]
    out[slots] = True
    return out


def _occurrence(cls: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (cls.view(_U) ^ mix(at.astype(_U) + _U(_BASE))).view(np.int64)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows (cls, bytes, ...) in pieces of about CHUNK bytes: the rows, their bytes one after the other, starts and ends."""
    for b in batches:
        offsets = np.frombuffer(b.column(1).buffers()[1], np.int32)[b.column(1).offset : b.column(1).offset + b.num_rows + 1].astype(np.int64)
        flat = np.frombuffer(b.column(1).buffers()[2] or b"", np.uint8)
        i = 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK)))
            j = min(j, b.num_rows)
            yield b.slice(i, j - i), flat[offsets[i] : offsets[j]], offsets[i:j] - offsets[i], offsets[i + 1 : j + 1] - offsets[i]
            i = j


def _bits(rows: DataFrame) -> np.ndarray:
    """Bits of the column ``key``, built by the tasks: as many as its rows ask for, within bounds, whatever the corpus."""
    size = min(MOST_BITS, max(LEAST_BITS, 1 << (8 * rows.count()).bit_length()))
    bit = F.pmod("key", F.lit(size)) + 1
    table = np.zeros(size // 8, np.uint8)
    for r in rows.groupBy(F.expr(f"bitmap_bucket_number(pmod(key, {size}L) + 1)").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).toLocalIterator():
        table[(r["bucket"] - 1) * 4096 : r["bucket"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    return table


def _in(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = (keys % _U(8 * len(table))).astype(np.int64)
    return (table[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def remove_repeats(docs: DataFrame, length: int = 200, id_column: str = "doc_id", text_column: str = "text", keep_text: bool = False) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with ``keep_text`` the remaining bytes as ``kept``.

    Removed is each byte of a ``length``-byte string that also starts anywhere else, in the same document or another; all is judged on the
    input. A null text is empty. Texts of under ``length`` bytes keep everything. Equal texts are one class: if they are long
    enough they go whole. Equal or null doc_ids are separate documents; other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffixes")
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    rows = rows.select(F.xxhash64("text").alias("cls"), F.col("text").cast("binary").alias("bytes"), "doc_id")
    gram = min(GRAM, length)
    reach = length - gram
    half = -(-reach // 2)

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for few, data, starts, ends in _chunks(batches):
            at, keys, _, _ = anchors(data, starts, ends, length)
            if not len(at):
                continue
            doc = np.searchsorted(starts, at, "right") - 1
            occ = _occurrence(few.column(0).to_numpy()[doc], at - starts[doc])
            order = np.argsort(keys)
            keys, occ = keys[order], occ[order]
            cut = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            yield pa.RecordBatch.from_arrays([pa.array(keys[cut].view(np.int64)), pa.array(np.minimum.reduceat(occ, cut)), pa.array(np.maximum.reduceat(occ, cut))], names=["key", "low", "high"])

    texts = rows.where(F.octet_length("bytes") >= length)
    copied = scratch.write(texts.groupBy("cls").agg(F.count("*").alias("n"), F.min("doc_id").alias("rep")).where("n > 1").select("cls", "rep"), "copied")
    seen = texts.select("cls", "bytes").mapInArrow(first_pass, "key long, low long, high long").groupBy("key").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    repeated = scratch.write(seen.where("low < high").select("key"), "repeated")
    maybe = spark.sparkContext.broadcast(_bits(repeated))

    def surroundings(content: bool, table):  # noqa: ANN001, ANN202
        """Of each anchor, or with ``content`` each occurrence, that the filter knows: hashes of its surroundings and of their halves, or the text."""

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for few, data, starts, ends in _chunks(batches):
                at, keys, left, last = anchors(data, starts, ends, length)
                doc = np.searchsorted(starts, at, "right") - 1
                occ = _occurrence(few.column(0).to_numpy()[doc], at - starts[doc])
                known = _in(table.value, occ.view(_U) if content else keys)
                at, keys, doc, occ, left, right = at[known], keys[known], doc[known], occ[known], left[known], last[known] + length
                if not len(at):
                    continue
                view = memoryview(data)
                digest = xxhash.xxh3_64_intdigest
                digests = np.array([digest(view[i:j], seed=k - i) for i, j, k in zip(left.tolist(), right.tolist(), at.tolist())], _U)
                cols = {"key": pa.array(keys.view(np.int64)), "seg": pa.array(digests.view(np.int64)), "cls": few.column(0).take(pa.array(doc)), "s": pa.array(left - starts[doc]), "o": pa.array(occ)}
                if content:
                    cols |= {"doc_id": few.column(2).take(pa.array(doc)), "content": pa.array([view[i:j].tobytes() for i, j in zip(left.tolist(), right.tolist())], pa.binary())}
                else:
                    cols |= {"e": pa.array(right - starts[doc])}
                    for name, has, i in (("before", at - left >= half, at - half), ("after", right - at - gram >= half, at + gram)):
                        hashes = np.array([digest(view[k : k + half]) if ok else 0 for ok, k in zip(has.tolist(), i.tolist())], _U)
                        cols[name] = pa.array(hashes.view(np.int64), mask=~has)
                yield pa.RecordBatch.from_pydict(cols)

        return each

    around = scratch.write(texts.select("cls", "bytes").mapInArrow(surroundings(False, maybe), "key long, seg long, cls long, s long, o long, e long, before long, after long"), "around", free=True)
    versions = around.groupBy("key", "seg").agg(F.min(F.struct("cls", "s", "o")).alias("f"), F.max(F.struct("cls", "s", "o")).alias("l"), F.max("before").alias("before"), F.max("after").alias("after"))
    versions = scratch.write(versions.select("key", "seg", "f.*", F.expr("f < l").alias("twice"), "before", "after"), "versions", free=True)
    whole = scratch.write(around.join(versions.where("twice").select("key", "seg"), ["key", "seg"]).select("cls", "s", "e").distinct(), "whole", free=True)
    scratch.drop("around", "repeated")
    mixed = versions.groupBy("key").agg(F.count("*").alias("k"), F.min("twice").alias("all")).where("k > 1 and not all").select("key", "k")
    halves = versions.join(mixed, "key").selectExpr("key", "seg", "cls", "s", "o", "k", "explode(array(struct(0 AS side, before AS half), struct(1 AS side, after AS half))) AS x").select("key", "seg", "cls", "s", "o", "k", "x.*").where("half IS NOT NULL")
    halves = scratch.write(halves, "halves", free=True)
    scratch.drop("versions")
    shared = halves.groupBy("key", "side", "half").agg(F.count("*").alias("n")).where("n > 1")
    met = halves.join(shared, ["key", "side", "half"])
    few = met.where(f"k <= {GROUP}").selectExpr("key", "seg", "cls", "s", "o", "2 AS side", "0L AS half", "false AS split", "0L AS sub").distinct()
    many = met.where(f"k > {GROUP}").selectExpr("key", "seg", "cls", "s", "o", "side", "half", f"n > {GROUP} AS split", f"pmod(seg, cast(ceil(n / {GROUP}) AS bigint)) AS sub")
    unlike = scratch.write(few.union(many), "unlike", free=True)
    scratch.drop("halves")
    table = spark.sparkContext.broadcast(_bits(unlike.select(F.col("o").alias("key"))))
    texts_of = texts.mapInArrow(surroundings(True, table), "key long, seg long, cls long, s long, o long, doc_id long, content binary")
    # Of a copied class only the least document's text is taken.
    owners = unlike.drop("s").join(copied, "cls", "left").withColumnRenamed("rep", "owner")
    dealt = texts_of.join(owners, ["key", "seg", "cls", "o"]).where("owner is null or owner <=> doc_id").select("key", "side", "half", "sub", "seg", "cls", "s", "content", "split")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches):
            yield from _repeats(t, length)

    compared = dealt.repartition("key", "side", "half", "sub").sortWithinPartitions("key", "side", "half", "sub", "seg").mapInArrow(compare, "cls long, s long, e long, window long, low long, high long")
    compared = scratch.write(compared, "compared", free=True)
    far = compared.where("window is not null")
    hashes = far.groupBy("window").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high").select("window")
    across = far.where("cls is not null").join(hashes, "window").select("cls", "s", "e")
    ranges = whole.union(compared.where("window is null").select("cls", "s", "e")).union(across)
    spans = ranges.groupBy("cls").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    side = spans.join(copied.select("cls", F.lit(True).alias("copied")), "cls", "full").select("cls", F.when(F.col("copied"), F.lit(None)).otherwise(F.col("spans")).alias("spans"), F.coalesce("copied", F.lit(False)).alias("copied"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for doc, data, spans_of, gone in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist()):
                runs = [(0, len(data))] if gone else []
                for s, e in [] if gone or not spans_of.is_valid else sorted((x["s"], x["e"]) for x in spans_of.as_py()):
                    if runs and s <= runs[-1][1]:
                        runs[-1] = (runs[-1][0], max(e, runs[-1][1]))
                    else:
                        runs.append((s, e))
                edges = [0, *(x for r in runs for x in r), len(data)]
                left = b"".join(data[i:j] for i, j in zip(edges[::2], edges[1::2]))
                out.append((doc, len(data), len(data) - len(left), len(runs), hashlib.sha256(left).hexdigest(), left))
            cols = list(zip(*out)) or [()] * 6
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            k = 6 if keep_text else 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols[:k], kinds)], names=names[:k])

    joined = rows.join(side, "cls", "left").select("doc_id", "bytes", "spans", F.coalesce("copied", F.lit(False)).alias("copied"))
    return joined.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of whole (key, side, half, sub) groups, about ARRAY bytes of text at a time."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        for at in range(0, b.num_rows, 512):
            few = b.slice(at, 512)
            held.append(few)
            size += few.column(few.schema.get_field_index("content")).nbytes
            if size >= ARRAY:
                t = pa.Table.from_batches(held)
                end = int(np.flatnonzero(_begins(t))[-1])
                if end:
                    yield t.slice(0, end)
                    held = t.slice(end).to_batches()
                    size = t["content"].slice(end).nbytes
    if held:
        yield pa.Table.from_batches(held)


def _begins(t: pa.Table) -> np.ndarray:
    """Where a group of rows begins."""
    new = np.zeros(t.num_rows, bool)
    new[:1] = True
    for c in ("key", "side", "half", "sub"):
        x = t[c].to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return new


def _repeats(t: pa.Table, length: int) -> Iterator[pa.RecordBatch]:
    """Rows (cls, s, e) of repeated windows among the rows' texts; for split groups also (window, low, high) of all windows."""
    contents = t["content"].to_pylist()
    sizes = np.fromiter(map(len, contents), np.int64, len(contents))
    # No UTF-8 text has the byte 255: raised by one, it ends each text with a byte below all others.
    data = np.frombuffer(b"\xff".join([*contents, b""]), np.uint8) + np.uint8(1)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    words = words_of(data)
    row_of = np.repeat(np.arange(len(sizes)), sizes + 1)
    window = np.arange(len(data)) + length <= (starts + sizes)[row_of]
    array = suffix_array(data, length, words, (np.cumsum(_begins(t)) - 1)[row_of], window)
    array = array[window[array]]
    if not len(array):
        return
    cls, s = t["cls"].to_numpy(), t["s"].to_numpy()
    row = row_of[array]
    place = s[row] + array - starts[row]
    occ = _occurrence(cls[row], place)
    cut = np.flatnonzero(~equal_prefix(array, words, length))
    low, high = np.minimum.reduceat(occ, cut), np.maximum.reduceat(occ, cut)
    run = np.repeat(np.arange(len(cut)), np.diff(np.concatenate([cut, [len(array)]])))
    twice = low < high
    marked = np.zeros(len(data) + 1, np.int8)
    marked[array[twice[run]]] = 1
    # Runs of window starts inside one row; a row's last starts are never marked, so runs end with their row.
    edges = np.diff(np.concatenate([[0], marked]))
    first, last = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1) - 1
    r = row_of[first]
    names = ["cls", "s", "e", "window", "low", "high"]
    none = pa.nulls(len(first), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array(cls[r]), pa.array(s[r] + first - starts[r]), pa.array(s[r] + last - starts[r] + length), none, none, none], names=names)
    split = t["split"].to_numpy()
    ours = np.flatnonzero(split[row[cut]])
    if len(ours):
        view = memoryview(data)
        head = array[cut[ours]]
        hashes = np.array([xxhash.xxh3_64_intdigest(view[i : i + length]) for i in head.tolist()], _U).view(np.int64)
        alone = ~twice[ours]
        own = row_of[head]
        at = s[own] + head - starts[own]
        yield pa.RecordBatch.from_arrays([pa.array(cls[own], mask=~alone), pa.array(at, mask=~alone), pa.array(at + length, mask=~alone), pa.array(hashes), pa.array(low[ours]), pa.array(high[ours])], names=names)
