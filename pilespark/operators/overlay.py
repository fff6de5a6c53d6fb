"""Reads over sites in Arrow batches: observations as rows, or added up for each site and base before they leave a task.

Sites come with the reads as bits of a bin of positions. Where file order counts (exact sums, a depth cap), what a read has in a small bin moves
as one record, records are sorted by bin and read, and a task goes through them holding one bin's sums.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa

from ..functions import vector as V
from ..schema import BASES, PileupConfig

#: Positions of a bin, and of one in which records move; words of its bits.
BIN, SMALL = 512, 128
WORDS = [f"_w{i}" for i in range(BIN // 64)]
#: Bins whose sums a task holds.
HELD = 128
WHOLE = ("n", "minus", "q2", "mapq", "base_qual", "se_mapq", "sum_mismatch_quals", "clipped_len")
DOUBLES = ("pos_as_fraction", "mismatch_fraction", "q2_distance", "distance_to_3p_end")
SUMS_SCHEMA = "chrom string, pos long, base string, " + ", ".join(f"{c} long" for c in WHOLE) + ", " + ", ".join(f"{c} double" for c in DOUBLES)
ROW = {
    "chrom": "string", "pos": "long", "base": "string", "base_qual": "int", "mapq": "int", "se_mapq": "int", "is_reverse": "boolean", "pos_as_fraction": "double", "mismatch_fraction": "double",
    "sum_mismatch_quals": "long", "q2_distance": "double", "clipped_len": "int", "distance_to_3p_end": "double", "ord": "long", "qpos": "int",
}
RECORD_SCHEMA = "chrom string, small long, ord long, record binary"
#: Numbers of a record before its bases, none below -1: one more than each in one, two or four bytes, by the greatest one.
_HEAD = ("left", "clipped_len", "l_qseq", "q2", "three", "se", "nm", "sum_mismatch_quals", "mapq", "is_reverse", "qpos", "at")
_SIZES = np.array([1, 2, 4])
#: Flags of a record beside its size: its places are listed, for they are not one after the other; a base and its quality share a byte, qualities being below LOW.
_LISTED, _SHARED, LOW = 4, 8, 51
_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}
Obs = tuple[dict[str, np.ndarray], dict[str, np.ndarray], np.ndarray, list[tuple[str, int]], int]


def _bins(chrom: pa.Array, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[str, int]]]:
    """For each row the place of its (chrom, number) among those of the batch; a row of each; and what they are."""
    codes = chrom.dictionary_encode()
    pairs = np.stack([codes.indices.to_numpy().astype(np.int64), number])
    order = np.lexsort(pairs[::-1])
    new = np.concatenate([[True], (np.diff(pairs[:, order]) != 0).any(axis=0)])
    which = np.empty(len(number), np.int64)
    which[order] = np.cumsum(new) - 1
    rows = order[new]
    names = codes.dictionary.to_pylist()
    return which, rows, [(names[c], int(b)) for c, b in pairs[:, rows].T]


def _over_sites(batches: Iterable[pa.RecordBatch], config: PileupConfig) -> Iterator[Obs]:
    """For each batch: per-read arrays, observations in order of reads, each read's bin, the bins, and their width."""
    for batch in batches:
        if not batch.num_rows:
            continue
        s = V.scan(batch)
        number = V.numbers(batch["bin"])
        which, rows, bins = _bins(batch["chrom"], number)
        words = np.stack([V.numbers(batch[w])[rows] for w in WORDS], axis=1).astype("<i8")
        sites = np.unpackbits(words.view(np.uint8), axis=1, bitorder="little").ravel().astype(bool)
        low = number[s.row] * BIN
        start, stop = np.maximum(s.ref0, low), np.minimum(s.ref0 + s.len, low + BIN)
        seg, ref0 = V._spread(start, np.maximum(0, stop - start))
        row = s.row[seg]
        found = np.flatnonzero(sites[which[row] * BIN + ref0 - low[seg]])
        if len(found) < len(seg):
            seg, ref0, row = seg[found], ref0[found], row[found]
        yield s.reads, V.observed(s, row, ref0, ref0 + (s.q0 - s.ref0)[seg], config.min_baseq), which, bins, BIN


def pack(config: PileupConfig) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Records of reads over sites: what a read has in a small bin, its insertions of more than three bases apart."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for reads, obs, which, bins, _ in _over_sites(batches, config):
            row, ref0, qpos = obs["row"], obs["ref0"], obs["qpos"]
            if not len(row):
                continue
            small = ref0 // SMALL
            step, next_ = qpos[1:] - qpos[:-1], ref0[1:] - ref0[:-1]
            begins = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (small[1:] != small[:-1]) | (step > 4)]))
            count = np.diff(np.concatenate([begins, [len(row)]]))
            own = row[begins]
            given = reads | {"qpos": qpos[begins], "at": ref0[begins] % SMALL}
            head = np.stack([(given[c] if c in ("qpos", "at") else given[c][own]).astype(np.int64) for c in _HEAD], axis=1) + 1
            most = head.max(axis=1)
            width = (most > 255).astype(np.int64) + (most > 65535)
            of, within = V._spread(np.zeros(len(begins), np.int64), count)
            apart = np.concatenate([[False], (step != 1) | (next_ != 1)])
            apart[begins] = False
            listed, shared = np.bincount(of, apart) > 0, np.maximum.reduceat(obs["base_qual"], begins) < LOW
            size = _SIZES[width] * len(_HEAD) + 1
            ends = V._before(size + count * (2 - shared + 2 * listed))
            out = np.empty(ends[-1], np.uint8)
            out[ends[:-1]] = width + _LISTED * listed + _SHARED * shared
            for w, bytes_ in enumerate(_SIZES):
                rows = np.flatnonzero(width == w)
                raw = head[rows].astype(f"<u{bytes_}").view(np.uint8).reshape(len(rows), bytes_ * len(_HEAD))
                out[(ends[:-1][rows] + 1)[:, None] + np.arange(bytes_ * len(_HEAD))] = raw
            place = (ends[:-1] + size)[of] + within
            both = shared[of]
            out[place] = np.where(both, obs["base"] * LOW + np.minimum(obs["base_qual"], LOW - 1), obs["base"])
            for rows, values, before in ((np.flatnonzero(~both), obs["base_qual"], np.ones(len(begins), np.int64)), (np.flatnonzero(listed[of]), ref0 % SMALL, 2 - shared), (np.flatnonzero(listed[of]), qpos - qpos[begins][of], 3 - shared)):
                out[place[rows] + (count * before)[of[rows]]] = values[rows]
            names = np.array([c for c, _ in bins], object)
            record = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(out)])
            yield _batch({"chrom": pa.array(names[which[own]], pa.string()), "small": small[begins], "ord": reads["ord"][own], "record": record}, RECORD_SCHEMA)

    return run


def _unpacked(batches: Iterable[pa.RecordBatch], config: PileupConfig) -> Iterator[Obs]:
    """As _over_sites, from sorted records, in their order; a site's observations beyond the depth cap are left out."""
    last, seen = None, np.zeros(SMALL, np.int64)
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        which, _, bins = _bins(batch["chrom"], V.numbers(batch["small"]))
        which, bins = _in_order(which, bins)
        column = batch["record"].cast(pa.large_binary())
        _, offsets, data = column.buffers()
        at, data = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1], np.frombuffer(data, np.uint8)
        flags = data[at[:-1]].astype(np.int64)
        width, listed, shared = flags & 3, flags & _LISTED > 0, flags & _SHARED > 0
        size = _SIZES[width] * len(_HEAD) + 1
        head = np.empty((n, len(_HEAD)), np.int64)
        for w, bytes_ in enumerate(_SIZES):
            rows = np.flatnonzero(width == w)
            head[rows] = data[(at[:-1][rows] + 1)[:, None] + np.arange(bytes_ * len(_HEAD))].view(f"<u{bytes_}")
        head -= 1
        reads = {c: head[:, i] for i, c in enumerate(_HEAD[:-2])} | {"ord": V.numbers(batch["ord"])}
        reads["is_reverse"] = reads["is_reverse"] == 1
        count = (np.diff(at) - size) // (2 - shared + 2 * listed)
        row, within = V._spread(np.zeros(n, np.int64), count)
        place = (at[:-1] + size)[row] + within
        base, off, qpos = data[place].astype(np.int64), head[:, -1][row] + within, within
        own, many = np.flatnonzero(~shared[row]), np.flatnonzero(listed[row])
        quality = base % LOW
        quality[own] = data[place[own] + count[row[own]]]
        base = np.where(shared[row], base // LOW, base)
        off[many] = data[place[many] + (count * (2 - shared))[row[many]]]
        qpos[many] = data[place[many] + (count * (3 - shared))[row[many]]]
        obs = {"row": row, "ref0": np.array([b for _, b in bins])[which[row]] * SMALL + off, "qpos": head[:, -2][row] + qpos, "base": base, "base_qual": quality}
        if config.max_depth < PileupConfig.max_depth:
            site = which[row] * SMALL + off
            before = np.zeros(len(bins) * SMALL, np.int64)
            if bins[0] == last:
                before[:SMALL] = seen
            keep = np.flatnonzero(before[site] < config.max_depth)
            site = site[keep].astype(np.uint16 if len(before) <= 1 << 16 else np.int64)  # two bytes are sorted by radix
            order = np.argsort(site, kind="stable")
            first = np.searchsorted(site[order], np.arange(len(before), dtype=site.dtype))
            rank = np.empty(len(site), np.int64)
            rank[order] = np.arange(len(site)) - first[site[order]]
            last, seen = bins[-1], (before + np.bincount(site, minlength=len(before)))[-SMALL:]
            keep = keep[rank + before[site] < config.max_depth]
            obs = {k: v[keep] for k, v in obs.items()}
        yield reads, obs, which, bins, SMALL


def _in_order(which: np.ndarray, bins: list[tuple[str, int]]) -> tuple[np.ndarray, list[tuple[str, int]]]:
    """Bins numbered as they come."""
    come = which[np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]]))]
    place = np.empty(len(bins), np.int64)
    place[come] = np.arange(len(come))
    return place[which], [bins[i] for i in come]


def _batch(columns: dict, schema: str) -> pa.RecordBatch:
    fields = [f.split(" ") for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([c if isinstance(c := columns[name], pa.Array) else pa.array(c, _ARROW[kind]) for name, kind in fields], names=[name for name, _ in fields])


def rows(source: str, config: PileupConfig, columns: list[str]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Observations with ``columns`` of ROW, ``source`` being "reads" or "records"."""
    schema = ", ".join(f"{c} {ROW[c]}" for c in columns)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for reads, obs, which, bins, _ in _SOURCES[source](batches, config):
            row = obs["row"]
            if not len(row):
                continue
            chroms = sorted({c for c, _ in bins})
            number = np.array([chroms.index(c) for c, _ in bins])[which]
            doubles = V.fractions(reads, row, obs["qpos"]) if set(columns) & set(DOUBLES) else {}
            make = {
                "chrom": lambda: pa.DictionaryArray.from_arrays(pa.array(number[row], pa.int32()), pa.array(chroms, pa.string())).cast(pa.string()), "pos": lambda: obs["ref0"] + 1,
                "base": lambda: pa.DictionaryArray.from_arrays(pa.array(obs["base"], pa.int32()), pa.array(BASES, pa.string())).cast(pa.string()), "base_qual": lambda: obs["base_qual"], "qpos": lambda: obs["qpos"],
                "se_mapq": lambda: pa.array(reads["se"][row], pa.int32(), mask=reads["se"][row] < 0), "q2_distance": lambda: pa.array(doubles["q2_distance"], pa.float64(), mask=np.isnan(doubles["q2_distance"])),
            }
            yield _batch({c: make[c]() if c in make else doubles[c] if c in doubles else reads[c][row] for c in columns}, schema)

    return run


def _weights(reads: dict[str, np.ndarray], obs: dict[str, np.ndarray], with_doubles: bool) -> Iterator[np.ndarray | None]:
    """What is added for each of WHOLE and DOUBLES; None where it is one for each observation."""
    row = obs["row"]
    yield None
    yield reads["is_reverse"].astype(float)[row]
    yield (reads["q2"] > -1).astype(float)[row]
    yield reads["mapq"].astype(float)[row]
    yield obs["base_qual"]
    yield np.maximum(0, reads["se"]).astype(float)[row]
    yield reads["sum_mismatch_quals"].astype(float)[row]
    yield reads["clipped_len"].astype(float)[row]
    if with_doubles:
        doubles = V.fractions(reads, row, obs["qpos"])
        yield from (np.nan_to_num(doubles[c], nan=0.0) if c == "q2_distance" else doubles[c] for c in DOUBLES)


def _sums_batch(bins: list[tuple[str, int]], width: int, cells: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    """Rows of SUMS_SCHEMA; a cell is a bin's place, a position in it and a base."""
    bin_ = cells // (len(BASES) * width)
    columns = {
        "chrom": pa.array(np.array([c for c, _ in bins], object)[bin_], pa.string()), "pos": np.array([b for _, b in bins], np.int64)[bin_] * width + cells // len(BASES) % width + 1,
        "base": pa.array(np.array(BASES, object)[cells % len(BASES)], pa.string()),
    }
    columns |= {c: sums[i].astype(np.int64) for i, c in enumerate(WHOLE)} | {c: sums[len(WHOLE) + i] if len(sums) > len(WHOLE) else np.zeros(len(cells)) for i, c in enumerate(DOUBLES)}
    return _batch(columns, SUMS_SCHEMA)


def sums(config: PileupConfig, with_doubles: bool = True) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Partial sums of reads' observations, of HELD bins at a time; of batches with more bins each batch's own."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, block = len(WHOLE) + len(DOUBLES) * with_doubles, BIN * len(BASES)
        held: dict[tuple[str, int], int] = {}
        total = np.zeros((kinds, HELD * block))

        def given() -> Iterator[pa.RecordBatch]:
            cells = np.flatnonzero(total[0])
            if len(cells):
                yield _sums_batch(list(held), BIN, cells, total[:, cells])

        for reads, obs, which, bins, _ in _over_sites(batches, config):
            cell = (which[obs["row"]] * BIN + obs["ref0"] % BIN) * len(BASES) + obs["base"]
            if not len(cell):
                continue
            if len(bins) > HELD:
                cells, at = np.unique(cell, return_inverse=True)
                yield _sums_batch(bins, BIN, cells, np.stack([np.bincount(at, w, len(cells)) for w in _weights(reads, obs, with_doubles)]))
                continue
            if len(set(bins) - held.keys()) + len(held) > HELD:
                yield from given()
                held.clear()
                total[:] = 0
            to = np.array([held.setdefault(b, len(held)) for b in bins])
            cell = to[cell // block] * block + cell % block
            for i, w in enumerate(_weights(reads, obs, with_doubles)):
                total[i, : len(held) * block] += np.bincount(cell, w, len(held) * block)
        yield from given()

    return run


def ordered_sums(config: PileupConfig) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Whole sums of sorted records, doubles added in their order; bincount adds one number after the other."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = SMALL * len(BASES)
        last, open_ = None, np.zeros((len(WHOLE) + len(DOUBLES), block))

        def given(bins: list[tuple[str, int]], total: np.ndarray) -> Iterator[pa.RecordBatch]:
            cells = np.flatnonzero(total[0])
            if len(cells):
                yield _sums_batch(bins, SMALL, cells, total[:, cells])

        for reads, obs, which, bins, _ in _unpacked(batches, config):
            if last is not None and bins[0] != last:
                yield from given([last], open_)
                open_ = np.zeros_like(open_)
            cell = (which[obs["row"]] * SMALL + obs["ref0"] % SMALL) * len(BASES) + obs["base"]
            cells, at = np.arange(len(bins) * block), np.concatenate([np.arange(block), cell])
            if len(cells) > 4 * len(at):
                cells, at = np.unique(at, return_inverse=True)
            total = np.stack([np.bincount(at, np.concatenate([open_[i], np.ones(len(cell)) if w is None else w]), len(cells)) for i, w in enumerate(_weights(reads, obs, True))])
            done = np.flatnonzero((cells < (len(bins) - 1) * block) & (total[0] > 0))
            if len(done):
                yield _sums_batch(bins, SMALL, cells[done], total[:, done])
            rest, open_ = np.flatnonzero(cells >= (len(bins) - 1) * block), np.zeros_like(open_)
            open_[:, cells[rest] - (len(bins) - 1) * block] = total[:, rest]
            last = bins[-1]
        if last is not None:
            yield from given([last], open_)

    return run


_SOURCES = {"reads": _over_sites, "records": _unpacked}
