"""The expressions of kernel.py over Arrow batches: CIGAR and MD texts are parsed, and reads laid over sites, for a whole batch at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from . import kernel as K

_DIGIT = np.zeros(256, bool)
_DIGIT[list(b"0123456789")] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_OP, _MATCH, _READ, _REF = (np.zeros(256, bool) for _ in range(4))
_OP[list(b"MIDNSHP=X")], _MATCH[list(b"M=X")], _READ[list(b"M=XIS")], _REF[list(b"M=XDN")] = True, True, True, True
#: Number of a base in BASES.
_CODE = np.full(256, 4, np.uint8)
for _n, _pair in enumerate((b"Aa", b"Cc", b"Gg", b"Tt")):
    _CODE[list(_pair)] = _n


def _text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and where each row's begin, the end of the last one added; nulls are empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy().astype(np.int64)


def numbers(column: pa.Array, null: int = 0) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(null).to_numpy()


def _decimal(text: np.ndarray, ends: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of the runs of digits just before ``ends``, which begin at ``low`` at the earliest; and which of them have a digit."""
    value, at, scale = np.zeros(len(ends), np.int64), ends - 1, 1
    live = (at >= low) & _DIGIT[text[np.maximum(at, 0)]]
    some = live
    while live.any():
        value += np.where(live, (text[np.maximum(at, 0)].astype(np.int64) - 48) * scale, 0)
        at, scale = at - 1, scale * 10
        live = live & (at >= low) & _DIGIT[text[np.maximum(at, 0)]]
    return value, some


def _before(values: np.ndarray) -> np.ndarray:
    """Running totals, of what comes before each place and in the end of all."""
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(values, dtype=np.int64)])


def _spread(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``counts`` places from each start on: which start it is of, and the place."""
    which = np.repeat(np.arange(len(counts)), counts)
    return which, np.arange(len(which)) + np.repeat(starts - _before(counts)[:-1], counts)


@dataclass
class Scan:
    """What observe.scan gives for each read, as arrays; aligned stretches have a row number each, in order."""

    seq: tuple[np.ndarray, np.ndarray]
    qual: tuple[np.ndarray, np.ndarray]
    row: np.ndarray
    ref0: np.ndarray
    q0: np.ndarray
    len: np.ndarray
    reads: dict[str, np.ndarray]


def scan(batch: pa.RecordBatch) -> Scan:
    n = batch.num_rows
    pos0, flag, mapq = numbers(batch["pos0"]), numbers(batch["flag"]), numbers(batch["mapq"])
    text, at = _text(batch["cigar"])
    ends = np.flatnonzero(_OP[text[at[0] : at[-1]]]) + at[0]
    row = np.searchsorted(at, ends, "right") - 1
    length, some = _decimal(text, ends, at[row])
    op, row, length = text[ends[some]], row[some], length[some]
    first, after = np.searchsorted(row, np.arange(n)), np.searchsorted(row, np.arange(n), "right")

    def clip(end: np.ndarray, next_: np.ndarray) -> np.ndarray:
        if not len(op):
            return np.zeros(n, np.int64)
        end_, next__ = np.clip(end, 0, len(op) - 1), np.clip(next_, 0, len(op) - 1)
        second = (after - first > 1) & (op[end_] == ord("H")) & (op[next__] == ord("S"))
        return np.where(after == first, 0, np.where(op[end_] == ord("S"), length[end_], np.where(second, length[next__], 0)))

    left, right = clip(first, first + 1), clip(after - 1, after - 2)
    q, r = _before(np.where(_READ[op], length, 0)), _before(np.where(_REF[op], length, 0))
    match = np.flatnonzero(_MATCH[op] & (length > 0))
    seg_row, seg_len = row[match], length[match]
    seg_q0, seg_ref0 = (q[match] - q[first[seg_row]]), (r[match] - r[first[seg_row]] + pos0[seg_row])

    seq, qual = _text(batch["seq"]), _lists(batch["qual"])
    seq_len = np.diff(seq[1])
    star = np.zeros(n, bool)
    one = np.flatnonzero(seq_len == 1)
    star[one] = seq[0][seq[1][:-1][one]] == ord("*")
    l_qseq = np.where(star, 0, seq_len)
    clipped, edge = np.maximum(0, l_qseq - left - right), np.maximum(0, l_qseq - right)
    reverse = (flag & K.REVERSE) != 0

    other = np.flatnonzero(qual[0][qual[1][0] : qual[1][-1]] != 2) + qual[1][0]
    low, high = np.searchsorted(other, qual[1][:-1]), np.searchsorted(other, qual[1][1:])
    q2 = np.full(n, -1, np.int64)
    has = np.flatnonzero(high > low)
    q2[has] = np.where(reverse[has], other[low[has]], other[high[has] - 1]) - qual[1][:-1][has] - 1
    three = np.minimum(l_qseq - 1, edge)
    three = np.where(reverse, np.maximum(np.maximum(0, left), q2), np.where((q2 != -1) & (three > q2), q2, three))
    # -1: no mapping quality
    se = np.where((flag & K.PROPER_PAIR) != 0, np.where(np.asarray(batch["sm"].is_null()), -1, np.clip(numbers(batch["sm"]), 0, 255)), mapq)
    reads = {
        "ord": numbers(batch["ord"]), "mapq": mapq, "is_reverse": reverse, "left": left, "clipped_len": clipped, "l_qseq": l_qseq, "q2": q2, "three": three, "se": se,
        "nm": np.maximum(0, numbers(batch["nm"])), "sum_mismatch_quals": _mismatch_quals(*_text(batch["md"]), seg_row, seg_q0, seg_len, qual, n),
    }
    return Scan(seq, qual, seg_row, seg_ref0, seg_q0, seg_len, reads)


def _mismatch_quals(text: np.ndarray, at: np.ndarray, seg_row: np.ndarray, seg_q0: np.ndarray, seg_len: np.ndarray, qual: tuple[np.ndarray, np.ndarray], n: int) -> np.ndarray:
    """As kernel.sum_mismatch_quals."""
    text, at = text[at[0] : at[-1]], at - at[0]
    if not len(text):
        return np.zeros(n, np.int64)
    begins = np.zeros(len(text), bool)
    begins[at[:-1][np.diff(at) > 0]] = True
    digit, letter = _DIGIT[text], _LETTER[text]
    word = letter & (begins | ~np.concatenate([[False], letter[:-1]]))  # where a run of letters begins
    start = np.maximum.accumulate(np.where(word, np.arange(len(text)), 0))
    gap = letter & ~begins[start] & (text[np.maximum(start - 1, 0)] == ord("^"))
    wrong = np.flatnonzero(letter & ~gap)
    stops = np.flatnonzero(digit & np.concatenate([~digit[1:] | begins[1:], [True]]))  # last digits
    advance = np.zeros(len(text), np.int64)
    advance[stops] = _decimal(text, stops + 1, at[np.searchsorted(at, stops, "right") - 1])[0]
    advance[wrong] = 1
    total, row = _before(advance), np.searchsorted(at, wrong, "right") - 1
    aligned, seg_from = _before(seg_len), np.searchsorted(seg_row, np.arange(n + 1))
    base = total[wrong] - total[at[row]] + aligned[seg_from[row]]  # the mismatch's number among all aligned bases of the batch
    inside = base < aligned[seg_from[row + 1]]
    base, row = base[inside], row[inside]
    seg = np.searchsorted(aligned, base, "right") - 1
    index = seg_q0[seg] + base - aligned[seg]
    if not len(index):
        return np.zeros(n, np.int64)
    place = qual[1][row] + index
    known = place < qual[1][row + 1]
    value = np.where(known, qual[0][np.where(known, place, 0)] if len(qual[0]) else 0, 0)
    runs = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (index[1:] != index[:-1] + 1)]))
    return np.bincount(row[runs], np.maximum.reduceat(value, runs), n).astype(np.int64)


def observed(s: Scan, row: np.ndarray, ref0: np.ndarray, q0: np.ndarray, min_baseq: int) -> dict[str, np.ndarray]:
    """Base number and quality of aligned bases at read places q0; ``row`` is each one's read, ``ref0`` its position from 0. Those of low quality go."""
    place = s.qual[1][row] + q0
    if (place >= s.qual[1][row + 1]).any():
        raise ValueError("a read has fewer qualities than its CIGAR has bases")
    quality = s.qual[0][place]
    at = s.seq[1][row] + q0
    if len(at) and len(s.seq[0]):
        base = np.where(at < s.seq[1][row + 1], _CODE[s.seq[0][np.minimum(at, len(s.seq[0]) - 1)]], 4)
    else:
        base = np.full(len(at), 4)
    out = {"row": row, "ref0": ref0, "qpos": q0, "base": base, "base_qual": quality}
    if min_baseq:
        keep = np.flatnonzero(quality >= min_baseq)
        out = {k: v[keep] for k, v in out.items()}
    return out


def fractions(reads: dict[str, np.ndarray], row: np.ndarray, qpos: np.ndarray) -> dict[str, np.ndarray]:
    """The four doubles of an observation, as kernel.py says them; NaN where there is no Q2 distance."""
    with np.errstate(divide="ignore", invalid="ignore"):
        half = reads["clipped_len"] / 2.0
        none, length = reads["clipped_len"] == 0, np.maximum(1, reads["l_qseq"])
        mismatch = np.where(none, 0.0, reads["nm"] / reads["clipped_len"])
        h = half[row]
        place = 1 - np.abs((qpos - reads["left"][row]) - h) / h
    if none.any():
        place = np.where(none[row], 0.0, place)
    length, q2 = length[row].astype(float), reads["q2"][row]
    return {
        "pos_as_fraction": place, "mismatch_fraction": mismatch[row], "q2_distance": np.where(q2 > -1, np.abs(qpos - q2) / length, np.nan),
        "distance_to_3p_end": np.abs(qpos - reads["three"][row]) / length,
    }
