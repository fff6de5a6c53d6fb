"""N-gram Jaccard join by parity sketches.

Two sets of a and b shingles link when their symmetric difference D is at most (1-t)/(1+t) * (a+b). Shingles are dealt to m blocks by hash and
each block keeps the XOR of its shingles' hashes: blocks of two sets differ in at most D places, so the others, those that are not
empty, are equal. Sets are joined on equal blocks, within bands of sizes. A set shows only its rarest D+1 blocks: by the
prefix-filter argument two linked sets share one of them. Bit sketches (256 parities, and for larger sets as many as the
size band asks for), whose Hamming distance is at most D, drop candidates before the exact comparison.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, components

WORDS = 5
_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
#: Bits of the filter that says which sets a comparison may need: LEAST_BITS, or eight for each set named, up to MOST_BITS (16 MB).
#: False positives cost rows that a join drops, nothing else.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 27
#: A key is frequent if one set in so many has it; keys that a task holds together before it reports its own frequent ones.
FREQUENT, HELD = 1024, 1_500_000
#: Sets from this size on have a second sketch of four to eight parities a shingle: 256 parities say little of a difference that may be as large.
WIDE = 64
#: Rows of a written table up to which it is broadcast: 16 to 72 bytes each.
BROADCAST_ROWS = 200_000
#: Least keys of a set that are known beside each of its keys.
LEAST_KEYS = 6


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


#: Lower-case bytes as numbers from 1 on, white space as 0.
_BYTES = np.array([0 if b == 32 or 9 <= b <= 13 else 1 + b + 32 * (65 <= b <= 90) for b in range(256)], np.uint64)


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.cumprod(np.full(n, _STEP)), np.cumprod(np.full(n, pow(int(_STEP), -1, 1 << 64), np.uint64))


class Shingler:
    """Sets of hashed shingles: ASCII letters in lower case, words between ASCII white space."""

    #: Bytes of text taken together: numbers about them fit the processor's cache.
    CHUNK = 1 << 17

    def __init__(self, words: int = WORDS):
        self.words = words

    def sets(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The set of each text, as a sorted array; null texts have none."""
        texts = texts.cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        at = 0
        while at < len(texts):
            to = min(len(texts), max(at + 1, int(np.searchsorted(offsets, offsets[at] + self.CHUNK, "right")) - 1))
            yield from self._sets_of(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
            at = to

    def set_of(self, text: str | None) -> np.ndarray:
        return next(self.sets(pa.array([text], pa.string())))

    def _sets_of(self, data: np.ndarray, cuts: np.ndarray) -> Iterator[np.ndarray]:
        values = _BYTES[data]
        word = np.zeros(len(data) + 1, bool)
        word[:-1] = values != 0
        begins = word[:-1].copy()
        begins[1:] &= ~word[:-2]
        ends = word[:-1] & ~word[1:]
        inner = cuts[:-1][cuts[:-1] < len(data)]
        begins[inner] = word[inner]
        ends[inner[inner > 0] - 1] = word[inner[inner > 0] - 1]
        begin, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        power, back = _powers(max(1, -(-len(data) // self.CHUNK)) * self.CHUNK)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values * power[: len(data)], out=sums[1:])
        w = mix((sums[end] - sums[begin]) * back[begin])
        whole = self._shingles(w, self.words)
        bounds = np.searchsorted(begin, cuts)
        for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if j - i > self.words:
                h = np.sort(whole[i : j - self.words + 1])
                yield h[np.concatenate([[True], h[1:] != h[:-1]])]
            else:
                yield self._shingles(w[i:j], max(1, j - i))

    @staticmethod
    def _shingles(w: np.ndarray, k: int) -> np.ndarray:
        if len(w) < k:
            return np.zeros(0, np.uint64)
        h = np.full(len(w) - k + 1, k, np.uint64)
        for i in range(k):
            h = h * _STEP + w[i : len(w) - k + 1 + i]
        return mix(h)


def _group_of(h: np.ndarray) -> tuple[int, int]:
    """Two 64-bit digests of a set, as signed integers."""
    return int(mix(h + np.uint64(11)).sum(dtype=np.uint64).view(np.int64)), int(mix(h ^ _M2).sum(dtype=np.uint64).view(np.int64))


def _sketch(h: np.ndarray) -> np.ndarray:
    return np.packbits((np.bincount((h >> np.uint64(7)) & np.uint64(255), minlength=256) & 1).astype(np.uint8)).view(np.int64)


def _wide(h: np.ndarray) -> np.ndarray | None:
    """Parities of a larger set, as many as its size band asks for; the parities of half as many bits are the XOR of the two halves."""
    if len(h) < WIDE:
        return None
    bits = 4 << len(h).bit_length()
    return np.packbits((np.bincount((h >> np.uint64(7)) & np.uint64(bits - 1), minlength=bits) & 1).astype(np.uint8)).view(np.int64)


def _blocks(h: np.ndarray, band: int) -> np.ndarray:
    """Keys of the non-empty blocks of a set in a band of sizes from 2**band."""
    m = np.uint64(1 << band)
    block = (h >> np.uint64(20)) % m
    order = np.argsort(block, kind="stable")
    block = block[order]
    first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
    return mix(np.bitwise_xor.reduceat(mix(h[order] + _STEP), first) + block[first] * _M1 + np.uint64((band + 1) * int(_STEP) % (1 << 64)))


def _bands(n: int, num: int, den: int) -> list[tuple[int, int]]:
    """(band, bound on the symmetric difference with partners there): the own one, and the one below if partners reach into it."""
    band, widest = n.bit_length() - 1, n * den // num
    diff = lambda other: (n + other) * (den - num) // (den + num)
    below = [(band - 1, diff((1 << band) - 1))] if band and -(-n * num // den) < 1 << band else []
    return [(band, diff(widest)), *below]


def _shown(h: np.ndarray, heavy: np.ndarray, num: int, den: int) -> np.ndarray:
    """The block keys that a set shows: in each band the D+1 rarest. Where a set has no more than D non-empty blocks it also shows single shingles."""
    out = []

    def rarest(keys: np.ndarray, k: int) -> np.ndarray:
        if len(keys) <= k:
            return keys
        at = np.searchsorted(heavy, keys)
        late = heavy[np.minimum(at, len(heavy) - 1)] == keys if len(heavy) else np.zeros(len(keys), bool)
        return keys[np.lexsort((keys, late))[:k]]

    for band, most in _bands(len(h), num, den):
        keys = _blocks(h, band)
        out.append(rarest(keys, most + 1))
        if len(keys) <= most:
            out.append(rarest(mix(h ^ _M1), most + 1))
    return np.concatenate(out)


def small(rows: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A written table, marked for a broadcast if it has no more than ``limit`` rows."""
    return F.broadcast(rows) if rows.count() <= limit else rows


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def link(docs: DataFrame, percent: int = 80, words: int = WORDS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id: the least id reachable over links of Jaccard similarity of at least ``percent``.

    Documents of fewer than ``words`` words have one shingle, the whole sequence; null, empty and blank ones have none and link with
    nothing. Equal sets are one node. A null doc_id is kept as a row with the component of a named row of the same set; a set that only
    such rows have links with no other, and its component_id is null. Rows that repeat an id stay rows, and link whatever one of them
    links. An empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    num, den = percent, 100
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, keys, known, held = Shingler(words), [], set(), 0
        names = ["doc_id", "n", "cls", "more", "s0", "s1", "s2", "s3", "heavy", "wide"]

        def frequent() -> pa.RecordBatch:
            k, n = np.unique(np.concatenate(keys or [np.zeros(0, np.uint64)]), return_counts=True)
            often = n >= max(3, len(known) // (2 * FREQUENT))
            k, n = k[often], n[often]
            none, zero = pa.nulls(len(k), pa.int64()), pa.array(np.zeros(len(k), np.int64))
            return pa.RecordBatch.from_arrays([none, pa.array(n), _signed(k), *[zero] * 5, pa.array(np.ones(len(k), np.int64)), pa.nulls(len(k), pa.list_(pa.int64()))], names=names)

        for b in batches:
            for at in range(0, b.num_rows, 2048):
                few = b.slice(at, 2048)
                ints, wide = np.zeros((7, few.num_rows), np.int64), [None] * few.num_rows
                for i, h in enumerate(shingler.sets(few.column(1))):
                    ints[0, i] = len(h)
                    if len(h):
                        ints[1:3, i] = cls = _group_of(h)
                        ints[3:, i] = _sketch(h)
                        wide[i] = _wide(h)
                        if cls not in known:
                            known.add(cls)
                            own = [_blocks(h, band) for band, _ in _bands(len(h), num, den)]
                            keys += own
                            held += sum(map(len, own))
                yield pa.RecordBatch.from_arrays([few.column(0), *map(pa.array, ints), pa.nulls(few.num_rows, pa.int64()), pa.array(wide, pa.list_(pa.int64()))], names=names)
                if held > HELD:
                    yield frequent()
                    keys, known, held = [], set(), 0
        yield frequent()

    found = scratch.write(rows.mapInArrow(describe, "doc_id long, n long, cls long, more long, s0 long, s1 long, s2 long, s3 long, heavy long, wide array<long>"), "described")
    described = found.where("heavy is null").drop("wide")
    total = described.count()
    # At most FREQUENT times the mean number of keys of a set, whatever the corpus.
    frequent = found.where("heavy = 1").groupBy("cls").agg(F.sum("n").alias("n")).where(F.col("n") >= max(8, total // FREQUENT)).select("cls").collect()
    heavy = spark.sparkContext.broadcast(np.sort(np.array([r["cls"] for r in frequent], np.int64).view(np.uint64)))
    sets = scratch.write(described.where("n > 0").groupBy("n", "cls", "more").agg(F.min("doc_id").alias("rep"), *[F.first(s).alias(s) for s in ("s0", "s1", "s2", "s3")]), "sets")

    def show(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, late = Shingler(words), heavy.value
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                keys, nodes, known = [], [], set()
                for h in shingler.sets(b.column(1).slice(at, 2048)):
                    if len(h) and (cls := _group_of(h)[0]) not in known:
                        known.add(cls)
                        keys.append(_shown(h, late, num, den))
                        nodes.append(np.full(len(keys[-1]), cls, np.int64))
                if keys:
                    yield pa.RecordBatch.from_arrays([_signed(np.concatenate(keys)), pa.array(np.concatenate(nodes))], names=["key", "cls"])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each key shown by several sets: the first of them, in an order of the key's own, and each of the others."""
        key = first = last = None
        for b in batches:
            k, c = b.column(0).to_numpy(), b.column(1).to_numpy()
            if not len(k):
                continue
            new = np.concatenate([[key is None or k[0] != key], k[1:] != k[:-1]])
            at = np.maximum.accumulate(np.where(new, np.arange(len(k)), -1))
            firsts = np.where(at >= 0, c[at], 0 if first is None else first)
            other = ~new & (c != np.concatenate([[c[0] if last is None else last], c[:-1]]))
            yield pa.RecordBatch.from_arrays([pa.array(x[other]) for x in (k, firsts, c)], names=["key", "first", "cls"])
            key, first, last = k[-1], firsts[-1], c[-1]

    met = scratch.write(rows.mapInArrow(show, "key long, cls long").repartition("key").sortWithinPartitions("key", F.xxhash64("key", "cls"), "cls").mapInArrow(runs, "key long, first long, cls long"), "met", free=True)

    distance = sum(F.bit_count(F.col(f"a{s}").bitwiseXOR(F.col(f"b{s}"))) for s in ("s0", "s1", "s2", "s3"))
    may_link = F.expr(f"{den} * least(an, bn) >= {num} * greatest(an, bn)") & (distance * (den + num) <= (F.col("an") + F.col("bn")) * (den - num))

    def verified(near: DataFrame, name: str) -> DataFrame:
        """Of pairs (u, v, ru, rv) of sets and their least doc_ids those that link, as the ids (u, v)."""
        wanted = near.selectExpr("explode(array(u, v)) AS cls")
        bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * near.count()).bit_length()))
        bit = F.pmod(F.col("cls"), F.lit(bits)) + 1
        maps = wanted.groupBy(F.expr(f"bitmap_bucket_number(pmod(cls, {bits}L) + 1)").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).toLocalIterator()
        table = np.zeros(bits // 8, np.uint8)
        for r in maps:
            table[(r["bucket"] - 1) * 4096 : r["bucket"] * 4096] = np.frombuffer(r["bits"], np.uint8)
        if not table.any():
            return near.selectExpr("ru AS u", "rv AS v").limit(0)
        may = spark.sparkContext.broadcast(table)

        def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shingler = Shingler(words)
            for b in batches:
                for at in range(0, b.num_rows, 1024):
                    ids, nodes, parts = [], [], []
                    for doc, h in zip(b.column(0).slice(at, 1024).to_pylist(), shingler.sets(b.column(1).slice(at, 1024))):
                        if len(h) and may.value[(cls := _group_of(h)[0]) % bits >> 3] >> (cls % bits & 7) & 1:
                            ids.append(doc)
                            nodes.append(cls)
                            parts.append(h)
                    cuts = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
                    flat = np.concatenate(parts or [np.zeros(0, np.uint64)])
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(nodes, pa.int64()), pa.ListArray.from_arrays(pa.array(cuts), _signed(flat))], names=["rep", "cls", "h"])

        need = near.selectExpr("explode(array(struct(u AS cls, ru AS rep), struct(v AS cls, rv AS rep))) AS x").select("x.*").distinct()
        known = scratch.write(rows.mapInArrow(pick, "rep long, cls long, h array<long>").join(need, ["cls", "rep"]).select("cls", "h"), f"{name}_sets")
        both = near.join(known.selectExpr("cls AS u", "h AS a"), "u").join(known.selectExpr("cls AS v", "h AS b"), "v")
        common = both.select("ru", "rv", F.size(F.array_intersect("a", "b")).alias("i"), (F.size("a") + F.size("b")).alias("s"))
        return common.where(f"{den} * i >= {num} * (s - i)").selectExpr("ru AS u", "rv AS v").distinct()

    half = lambda x: f"if(size({x}) > least(size(aw), size(bw)), zip_with(slice({x}, 1, size({x}) div 2), slice({x}, size({x}) div 2 + 1, size({x}) div 2), (p, q) -> p ^ q), {x})"
    apart_bits = f"aggregate(zip_with({half('aw')}, {half('bw')}, (p, q) -> bit_count(p ^ q)), 0, (t, x) -> t + x)"
    #: Larger sets are told apart by their wide sketches too.
    wide_too = F.expr(f"CASE WHEN aw IS NULL OR bw IS NULL THEN true ELSE {apart_bits} * {den + num} <= (an + bn) * {den - num} END")
    wide = found.where("heavy is null AND wide is not null AND doc_id is not null").select("cls", F.col("doc_id").alias("rep"), "n", "wide")

    def screened(near: DataFrame, name: str) -> DataFrame:
        """Pairs (u, v, ru, rv) without those of larger sets whose wide sketches are too far apart. Only sketches that a pair names are moved."""
        near = scratch.write(near.distinct(), f"{name}_near", free=True)
        named = scratch.write(near.selectExpr("explode(array(struct(u AS cls, ru AS rep), struct(v AS cls, rv AS rep))) AS x").select("x.*").distinct(), f"{name}_named")
        few = scratch.write(wide.join(small(named), ["cls", "rep"], "left_semi"), f"{name}_wide")
        sketch = lambda p, q: few.select(F.col("cls").alias(q), F.col("rep").alias("r" + q), F.col("n").alias(p + "n"), F.col("wide").alias(p + "w"))
        both = near.join(sketch("a", "u"), ["u", "ru"], "left").join(sketch("b", "v"), ["v", "rv"], "left")
        return both.where(wide_too).select("u", "v", "ru", "rv").distinct()

    sized = lambda p, q: sets.select(*[F.col(c).alias(p + c) for c in sets.columns if c not in ("cls", "more")], F.col("cls").alias(q))
    star = met.selectExpr("first AS u", "cls AS v").distinct().join(sized("a", "u"), "u").join(sized("b", "v"), "v").where(may_link)
    star = scratch.write(screened(star.select("u", "v", F.col("arep").alias("ru"), F.col("brep").alias("rv")), "star"), "star", free=True)
    scratch.drop("star_near", "star_named", "star_wide")
    # A set meets a first set under each of its keys; comparing it with two of them mostly joins it to its group.
    first = lambda f: star.groupBy("v").agg(f(F.struct("u", "ru", "rv")).alias("x")).select("v", "x.u", "x.ru", "x.rv")
    once = scratch.write(first(F.min).union(first(F.max)).distinct(), "once")
    linked = scratch.write(verified(once, "once"), "linked", free=True)
    scratch.drop("once_sets")
    roots = components(scratch, linked)
    root_of = lambda c, name: roots.select(F.col("node").alias(c), F.col("root").alias(name))
    left_over = star.join(once.select("u", "v"), ["u", "v"], "left_anti").join(root_of("ru", "x"), "ru", "left").join(root_of("rv", "y"), "rv", "left")
    left_over = left_over.where("coalesce(x, ru) <> coalesce(y, rv)").select("u", "v", "ru", "rv")
    # Sets that meet under a key and are still apart after that: all their pairs but those with the key's first set, which are done.
    placed_sets = scratch.write(sets.select("cls", "rep", "n", "s0", "s1", "s2", "s3").join(root_of("rep", "root"), "rep", "left").withColumn("root", F.coalesce("root", "rep")), "placed_sets")
    # Rows stay narrow until it is known which keys hold sets of several groups.
    placed = scratch.write(met.select("key", "cls").join(placed_sets.select("cls", "root"), "cls"), "placed", free=True)
    mixed = placed.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("key")
    shared = scratch.write(placed.join(mixed, "key").select("key", "cls"), "shared", free=True)
    # The wide rows below are not written: both sides of their join read one exchange.
    # A set's least keys: two sets that have one of them in common meet under the least such key alone, not under every key that they share.
    least = scratch.write(shared.groupBy("cls").agg(F.slice(F.sort_array(F.collect_list("key")), 1, LEAST_KEYS).alias("least")), "least")
    # Half of a wide sketch's parities go with each key: two to four a shingle. Below twice the least size they are the 256 that every set has.
    folded = F.expr("zip_with(slice(wide, 1, size(wide) div 2), slice(wide, size(wide) div 2 + 1, size(wide) div 2), (p, q) -> p ^ q)")
    halves = wide.where(f"n >= {2 * WIDE}").join(small(least.select("cls")), "cls", "left_semi").select("cls", "rep", folded.alias("w")).groupBy("cls", "rep").agg(F.first("w").alias("w"))
    known = placed_sets.join(small(least), "cls").join(halves, ["cls", "rep"], "left")
    apart = shared.join(known, "cls")
    scratch.drop("placed", "met")
    kept = ("rep", "root", "n", "s0", "s1", "s2", "s3", "least", "w")
    side = lambda p, q: apart.select(F.col("key").alias(p + "key"), F.col("cls").alias(q), *[F.col(c).alias(p + c) for c in kept])
    first_meeting = "NOT exists(aleast, x -> x < akey AND array_contains(bleast, x))"
    pairs = side("a", "u").join(side("b", "v"), (F.col("akey") == F.col("bkey")) & F.expr("u < v AND aroot <> broot") & may_link & F.expr(first_meeting) & wide_too)
    pairs = pairs.select("u", "v", F.col("arep").alias("ru"), F.col("brep").alias("rv"))
    rest = scratch.write(pairs.union(left_over).distinct(), "rest", free=True)
    more = scratch.write(verified(rest, "rest"), "more")
    scratch.drop("rest_sets", "shared", "least")
    if not more.isEmpty():
        roots = components(scratch, linked.union(more), "cc2_")
    nodes = described.join(sets.select("n", "cls", "more", "rep"), ["n", "cls", "more"], "left").select("doc_id", "n", "rep")
    return nodes.join(roots, F.col("rep") == F.col("node"), "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "rep", F.when(F.col("n") == 0, F.col("doc_id"))).alias("component_id"))
