"""Reference genomes: FASTA, read by index in ranges of a contig, as tiles of upper-case bases."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.reference import TILE
from ..schema import TILE as SCHEMA


def build_index(path: str) -> list[tuple[str, int, int, int, int]]:
    """(contig, bases, offset, bases per line, bytes per line), as a .fai file has them; read from one if it lies beside the file."""
    if os.path.exists(path + ".fai"):
        with open(path + ".fai") as f:
            return [(r[0], *map(int, r[1:5])) for r in (x.rstrip("\n").split("\t") for x in f if x.strip())]
    out: list[list] = []
    at = 0
    with open(path, "rb") as f:
        for line in f:
            at += len(line)
            if line.startswith(b">"):
                out.append([line[1:].split()[0].decode(), 0, at, 0, 0])
            elif out:
                bases = len(line.rstrip(b"\r\n"))
                out[-1][1] += bases
                if not out[-1][3]:
                    out[-1][3:] = [bases, len(line)]
    return [tuple(x) for x in out]


class _Range(InputPartition):
    def __init__(self, entry: tuple, first: int, last: int):
        self.entry, self.first, self.last = entry, first, last


class FastaReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.tile = options["path"], int(options.get("tile", TILE))
        self.only = set(filter(None, options.get("contigs", "").split(",")))

    def partitions(self) -> list[InputPartition]:
        step = 1024 * self.tile
        return [_Range(e, i, min(i + step, e[1])) for e in build_index(self.path) if not self.only or e[0] in self.only for i in range(0, max(1, e[1]), step)]

    def read(self, partition: _Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # nothing was planned
            return
        name, bases, offset, per_line, width = partition.entry
        if not bases:
            return
        place = lambda i: offset + i // per_line * width + i % per_line
        with open(self.path, "rb") as f:
            f.seek(place(partition.first))
            raw = f.read(place(partition.last - 1) + 1 - place(partition.first))
        seq = raw.replace(b"\n", b"").replace(b"\r", b"").upper().decode("ascii")
        starts = range(0, len(seq), self.tile)
        yield pa.RecordBatch.from_pydict({"chrom": [name] * len(starts), "start0": [partition.first + i for i in starts], "seq": [seq[i : i + self.tile] for i in starts]})


class FastaDataSource(DataSource):
    """``spark.read.format("fasta").load(path)``; option contigs: names to read, separated by commas."""

    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return FastaReader(dict(self.options))
