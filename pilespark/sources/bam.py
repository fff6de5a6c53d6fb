"""BAM: block-compressed binary alignments, read by file or, with an index, by region."""

from __future__ import annotations

import bisect
import os
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schema import READ

OPS, NIBBLES = "MIDNSHP=X", "=ACMGRSVTWYHKDBN"
BATCH = 20_000
_TAG_SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
_TAG_CODES = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I"}
_PAIRS = [NIBBLES[b >> 4] + NIBBLES[b & 15] for b in range(256)]


class Blocks:
    """The decompressed bytes of a BGZF file from a virtual offset on."""

    def __init__(self, path: str, start: int = 0):
        self.file = open(path, "rb")
        self.file.seek(start >> 16)
        self.at, self.next, self.data, self.i = start >> 16, start >> 16, b"", 0
        if self._load():
            self.i = start & 0xFFFF

    def _load(self) -> bool:
        self.at = self.next
        head = self.file.read(12)
        if len(head) < 12:
            self.data, self.i = b"", 0
            return False
        if head[:4] != b"\x1f\x8b\x08\x04":
            raise ValueError("not a BGZF block")
        extra = self.file.read(struct.unpack("<H", head[10:])[0])
        k, size = 0, None
        while k < len(extra):
            tag, n = extra[k : k + 2], struct.unpack_from("<H", extra, k + 2)[0]
            if tag == b"BC":
                size = struct.unpack_from("<H", extra, k + 4)[0] + 1
            k += 4 + n
        if size is None:
            raise ValueError("block without its size")
        body = self.file.read(size - 12 - len(extra))
        self.next += size
        self.data, self.i = zlib.decompress(body[:-8], -15), 0
        return True

    def tell(self) -> int:
        return (self.next << 16) if self.i >= len(self.data) else self.at << 16 | self.i

    def read(self, n: int) -> bytes:
        out = b""
        while n:
            if self.i >= len(self.data) and not self._load():
                return out
            got = self.data[self.i : self.i + n]
            self.i += len(got)
            n -= len(got)
            out += got
        return out


def header(blocks: Blocks) -> list[tuple[str, int]]:
    if blocks.read(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    blocks.read(struct.unpack("<i", blocks.read(4))[0])
    out = []
    for _ in range(struct.unpack("<i", blocks.read(4))[0]):
        name = blocks.read(struct.unpack("<i", blocks.read(4))[0])[:-1].decode()
        out.append((name, struct.unpack("<i", blocks.read(4))[0]))
    return out


def contigs(path: str) -> list[tuple[str, int, int]]:
    """(chrom, tid, len), from the header."""
    return [(name, i, size) for i, (name, size) in enumerate(header(Blocks(path)))]


def _tags(raw: bytes) -> dict[str, object]:
    out, i = {}, 0
    while i < len(raw):
        name, kind, i = raw[i : i + 2].decode(), chr(raw[i + 2]), i + 3
        if kind in "ZH":
            end = raw.index(b"\0", i)
            out[name], i = (raw[i:end].decode() if kind == "Z" else None), end + 1
        elif kind == "B":
            n = struct.unpack_from("<i", raw, i + 1)[0]
            i += 5 + n * _TAG_SIZES[chr(raw[i])]
        else:
            out[name], i = struct.unpack_from(_TAG_CODES[kind], raw, i)[0] if kind in _TAG_CODES else None, i + _TAG_SIZES[kind]
    return out


def decode(raw: bytes, names: list[str], order: int) -> dict:
    tid, pos, n_name, mapq, _, n_cigar, flag, n_seq = struct.unpack_from("<iiBBHHHi", raw)
    i = 32
    name = raw[i : i + n_name - 1].decode()
    i += n_name
    cigar = "".join(f"{x >> 4}{OPS[x & 15]}" for x in struct.unpack_from(f"<{n_cigar}I", raw, i))
    i += 4 * n_cigar
    seq = "".join(map(_PAIRS.__getitem__, raw[i : i + (n_seq + 1) // 2]))[:n_seq]
    i += (n_seq + 1) // 2
    tags = _tags(raw[i + n_seq :])
    whole = lambda x: x if isinstance(x, int) else None
    nm, sm, md = whole(tags.get("NM")), whole(tags.get("SM")), tags.get("MD")
    return {"ord": order, "qname": name, "flag": flag, "chrom": names[tid] if tid >= 0 else "*", "pos0": pos, "mapq": mapq, "cigar": cigar or "*", "seq": seq or "*", "qual": list(raw[i : i + n_seq]), "nm": nm, "md": md if isinstance(md, str) else None, "sm": None if sm is None else max(0, min(255, sm))}


def index_chunks(path: str, tid: int, begin: int, end: int) -> list[tuple[int, int]]:
    """Virtual-offset ranges that may hold reads over [begin, end) of a contig, merged, from a .bai file."""
    with open(path, "rb") as f:
        raw = f.read()
    if raw[:4] != b"BAI\1":
        raise ValueError("not a BAI file")
    bins = {0, *(o + (begin >> s) + k for o, s in ((1, 26), (9, 23), (73, 20), (585, 17), (4681, 14)) for k in range(((end - 1) >> s) - (begin >> s) + 1))}
    i, out, least = 8, [], 0
    for t in range(struct.unpack_from("<i", raw, 4)[0]):
        n_bins, i = struct.unpack_from("<i", raw, i)[0], i + 4
        for _ in range(n_bins):
            number, n = struct.unpack_from("<Ii", raw, i)
            i += 8
            if t == tid and number in bins:
                v = struct.unpack_from(f"<{2 * n}Q", raw, i)
                out += list(zip(v[::2], v[1::2]))
            i += 16 * n
        n_lines, i = struct.unpack_from("<i", raw, i)[0], i + 4
        if t == tid and n_lines:
            least = struct.unpack_from("<Q", raw, i + 8 * min(begin >> 14, n_lines - 1))[0]
        i += 8 * n_lines
    return merged([(max(a, least), b) for a, b in out if b > least])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans that neither overlap nor touch."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


class _Part(InputPartition):
    """Records that begin in [start, end); with a contig those over one of its spans, sorted and apart."""

    def __init__(self, start: int, end: int, tid: int = -1, spans: tuple[tuple[int, int], ...] = ()):
        self.start, self.end, self.tid, self.spans = start, end, tid, spans


class BamReader(DataSourceReader):
    """Options: path; regions ``chr:begin-end,...`` (0-based, half open, needs path.bai).

    Regions of a contig are merged and so are the index chunks that they lead to, so a read over several regions comes once.
    """

    def __init__(self, options: dict):
        self.path, self.regions = options["path"], [r for r in options.get("regions", "").split(",") if r]
        blocks = Blocks(self.path)
        self.names = [n for n, _ in header(blocks)]
        self.first = blocks.tell()

    def partitions(self) -> list[InputPartition]:
        if not self.regions:
            return [_Part(self.first, 1 << 62)]
        bai = self.path + ".bai" if os.path.exists(self.path + ".bai") else self.path.removesuffix(".bam") + ".bai"
        spans: dict[str, list[tuple[int, int]]] = {}
        for r in self.regions:
            name, _, span = r.rpartition(":")
            low, high = map(int, span.split("-"))
            spans.setdefault(name, []).append((low, high))
        out: list[InputPartition] = []
        for name in self.names:  # an unknown contig has no rows
            wanted, tid = merged(spans.get(name, [])), self.names.index(name)
            found = merged([c for low, high in wanted for c in index_chunks(bai, tid, low, high)])
            out += [_Part(a, b, tid, tuple(wanted)) for a, b in found]
        return out

    def read(self, partition: _Part | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # nothing was planned
            return
        blocks, rows = Blocks(self.path, partition.start), []
        schema = pa.schema([("ord", pa.int64()), ("qname", pa.string()), ("flag", pa.int32()), ("chrom", pa.string()), ("pos0", pa.int64()), ("mapq", pa.int32()), ("cigar", pa.string()), ("seq", pa.string()), ("qual", pa.list_(pa.int32())), ("nm", pa.int64()), ("md", pa.string()), ("sm", pa.int32())])
        while (order := blocks.tell()) < partition.end and len(size := blocks.read(4)) == 4:
            raw = blocks.read(struct.unpack("<i", size)[0])
            tid, pos = struct.unpack_from("<ii", raw)
            if partition.tid >= 0:
                if tid > partition.tid or tid < 0 or tid == partition.tid and pos >= partition.spans[-1][1]:
                    break
                if tid < partition.tid:
                    continue
                n = struct.unpack_from("<H", raw, 12)[0]
                span = sum(x >> 4 for x in struct.unpack_from(f"<{n}I", raw, 32 + raw[8]) if x & 15 in (0, 2, 3, 7, 8))
                near = bisect.bisect_left(partition.spans, pos + max(1, span), key=lambda x: x[0]) - 1
                if near < 0 or partition.spans[near][1] <= pos:
                    continue
            rows.append(decode(raw, self.names, order))
            if len(rows) == BATCH:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


class BamDataSource(DataSource):
    """``spark.read.format("bam").load(path)``. ord is the record's virtual offset, so file order survives any partitioning."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> T.StructType | str:
        return READ

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return BamReader(dict(self.options))
