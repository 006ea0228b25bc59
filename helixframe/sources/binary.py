"""Python data sources for formats whose bytes must be decoded. Partitions are byte, block or row ranges.

Options common to all: ``path``; ``zeroBased`` (default per format); ``columns``: comma-separated names, since Spark does not
prune the columns of Python sources; pushed filters only skip work and are always evaluated again by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import bgzf


@dataclass
class Range(InputPartition):
    start: int
    end: int


@dataclass
class Ranges(InputPartition):
    """Byte ranges that one task reads, one after another."""

    ranges: list


#: Tasks that small ranges are dealt to, and bytes of a task where there would be more of them.
TASKS, TASK_BYTES = 256, 64 << 20


def dealt(size: int, step: int) -> list[Ranges]:
    """The ranges of ``step`` bytes of a file, in its order. Each is read for itself; a task has several where there are many."""
    each = [Range(a, min(a + step, size)) for a in range(0, max(size, 1), step)]
    n = max(min(TASK_BYTES, size // TASKS) // step, 1)
    return [Ranges(each[k : k + n]) for k in range(0, len(each), n)]


def option(options: dict, name: str, default: str = "") -> str:
    return {k.lower(): v for k, v in options.items()}.get(name.lower(), default)


class Reader(DataSourceReader):
    """Yields record batches of the schema's columns."""

    def __init__(self, options: dict, schema):
        self.options, self.path = dict(options), option(options, "path")
        self.names = schema.names

    def partitions(self):
        return [Range(0, 1)]

    def batch(self, columns: dict[str, pa.Array]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[n] for n in self.names], names=self.names)


def pruned(fields: list[tuple[str, str]], options: dict) -> str:
    wanted = [c for c in option(options, "columns").split(",") if c]
    return ", ".join(f"`{n}` {t}" for n, t in fields if not wanted or n in wanted)


# --- FASTQ ---------------------------------------------------------------------------------------------------------


class FastqReader(Reader):
    def partitions(self):
        n, step = bgzf.size_of(self.path), int(option(self.options, "splitBytes", str(64 << 20)))
        return dealt(n, max(n, 1) if bgzf.compression(self.path) == "gzip" else step)

    def read(self, part: Ranges):
        for r in part.ranges:
            yield from self._range(r)

    def _lines(self, part: Range) -> Iterator[tuple[bool, bytes]]:
        """(whether a record that starts here belongs to this range, line), from the first whole line on."""
        kind = bgzf.compression(self.path)
        if kind == "gzip":
            rest = b""
            for chunk in bgzf.gunzip(self.path):
                parts = (rest + chunk).split(b"\n")
                rest = parts.pop()
                yield from ((True, x) for x in parts)
            if rest:
                yield True, rest
            return
        if kind == "plain":
            with bgzf.open_raw(self.path) as f:
                at = part.start
                f.seek(at)
                rest, skip = b"", at > 0
                size = min(max(part.end - part.start, 1 << 16), 1 << 20)
                while chunk := f.read(size):
                    parts = (rest + chunk).split(b"\n")
                    rest = parts.pop()
                    for x in parts:
                        if not skip:
                            yield at <= part.end, x
                        skip = False
                        at += len(x) + 1
                if rest and not skip:
                    yield at <= part.end, rest
            return
        with bgzf.open_raw(self.path) as f:
            size = bgzf.size_of(self.path)
            start = bgzf.find_block(f, part.start, size)
            stop = bgzf.find_block(f, part.end, size) if part.end < size else size
        if start >= stop and part.start > 0:
            return
        blocks, at, skip = bgzf.Blocks(self.path, start), 0, start > 0
        while True:
            k = blocks.data.find(b"\n", at - blocks.base)
            while k < 0:
                if not blocks.fill():
                    if blocks.base + len(blocks.data) > at and not skip:
                        yield blocks.block_of(at) < stop, blocks.data[at - blocks.base :]
                    return
                k = blocks.data.find(b"\n", at - blocks.base)
            if not skip:
                block = blocks.block_of(at)
                first = any(p == at and b == stop for p, b in blocks.marks)
                yield block < stop or first, blocks.data[at - blocks.base : k]
            skip = False
            at = blocks.base + k + 1
            blocks.drop(at)

    def _range(self, part: Range):
        lines = self._lines(part)
        held: list[tuple[bool, bytes]] = []
        if part.start > 0:  # in the middle: find the first line that can only be a record's first
            for x in lines:
                held.append(x)
                if len(held) >= 8:
                    break
            for k in range(max(len(held) - 3, 0)):
                a, b, c, d = (held[k + i][1].rstrip(b"\r") for i in range(4))
                if a[:1] == b"@" and c[:1] == b"+" and len(b) == len(d):
                    held = held[k:]
                    break
            else:
                return
        columns: list[list] = [[], [], [], []]

        def every():
            yield from held
            yield from lines

        it = every()
        for mine, head in it:
            if not mine:
                break
            head = head.rstrip(b"\r")
            if not head:
                continue
            seq, plus, qual = (next(it)[1].rstrip(b"\r") for _ in range(3))
            if head[:1] != b"@" or plus[:1] != b"+":
                raise ValueError("not a FASTQ record")
            name, _, text = head[1:].partition(b" ")
            for c, v in zip(columns, (name, text or None, seq, qual), strict=True):
                c.append(v)
            if len(columns[0]) >= 8192:
                yield self._batch(columns)
                columns = [[], [], [], []]
        if columns[0]:
            yield self._batch(columns)

    def _batch(self, columns):
        names = ("name", "description", "sequence", "quality_scores")
        return self.batch({n: pa.array(c, pa.binary()).cast(pa.string()) for n, c in zip(names, columns, strict=True) if n in self.names})


class FastqSource(DataSource):
    """Plain files split by bytes, BGZF by blocks; other gzip is one stream. A range owns the records that start in it."""

    @classmethod
    def name(cls):
        return "fastq"

    def schema(self):
        return pruned([("name", "string"), ("description", "string"), ("sequence", "string"), ("quality_scores", "string")], self.options)

    def reader(self, schema):
        return FastqReader(self.options, schema)


# --- lines of BGZF files -------------------------------------------------------------------------------------------


class BgzfLinesReader(Reader):
    """Block ranges. A range owns the lines that begin in it, behind its first line feed, up to its end's first byte."""

    def partitions(self):
        n, step = bgzf.size_of(self.path), int(option(self.options, "splitBytes", str(32 << 20)))
        return [Range(a, min(a + step, n)) for a in range(0, max(n, 1), step)]

    def read(self, part: Range):
        size = bgzf.size_of(self.path)
        with bgzf.open_raw(self.path) as f:
            start = bgzf.find_block(f, part.start, size)
            stop = bgzf.find_block(f, part.end, size) if part.end < size else size
        if start >= stop:
            return
        blocks, rest, skip = bgzf.Blocks(self.path, start), b"", start > 0

        def taken() -> bytes:
            data, blocks.data, blocks.base = blocks.data, b"", blocks.base + len(blocks.data)
            blocks.marks.clear()
            return data

        while blocks.at < stop:
            while blocks.at < stop and len(blocks.data) < 4 << 20 and blocks.fill():
                pass
            data = taken()
            if not data and blocks.at < stop:
                break
            if skip:
                k = data.find(b"\n")
                if k < 0:
                    continue
                data, skip = data[k + 1 :], False
            data = rest + data
            k = data.rfind(b"\n") + 1
            rest = data[k:]
            yield from self._batch(data[:k])
        # the line that goes on behind the range, or begins with its end
        pieces = [] if skip else [rest]
        while blocks.fill():
            data = taken()
            k = data.find(b"\n")
            pieces.append(data if k < 0 else data[: k + 1])
            if k >= 0:
                break
        if not skip:
            yield from self._batch(b"".join(pieces))

    def _batch(self, data: bytes):
        if data:
            each = pc.split_pattern(pa.array([data.decode("utf-8", "replace")], pa.large_string()), "\n")[0].values
            each = each[: len(each) - 1] if data.endswith(b"\n") else each
            for a in range(0, len(each), 16384):
                yield pa.RecordBatch.from_arrays([pc.utf8_rtrim(each[a : a + 16384], "\r").cast(pa.string())], names=["value"])


class BgzfLinesSource(DataSource):
    """The lines of one BGZF file, in parallel; ``splitBytes`` of the compressed file per task."""

    @classmethod
    def name(cls):
        return "bgzf_lines"

    def schema(self):
        return "value string"

    def reader(self, schema):
        return BgzfLinesReader(self.options, schema)


def register(spark: SparkSession) -> None:
    """All data sources of this package, for ``spark.read.format(...)`` and SQL."""
    from helixframe.session import ship

    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # the readers prune by pushed filters
    from . import alignments, bbi, genotypes, indexes, vep

    for source in (FastqSource, BgzfLinesSource, alignments.BamSource, bbi.BigWigSource, bbi.BigBedSource, genotypes.BgenSource, genotypes.PgenSource, genotypes.ZarrSource, genotypes.BcfSource, vep.VepEntitySource, indexes.IndexedLinesSource):
        spark.dataSource.register(source)
