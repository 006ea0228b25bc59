"""BigWig and BigBed: index blocks are dealt to partitions, those that no region touches are never read."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, InputPartition

from helixframe.plans.regions import extract_regions

from . import bgzf
from .binary import Reader, option, pruned

WIG, BED, TREE, INDEX = 0x888FFC26, 0x8789F2EB, 0x78CA8C91, 0x2468ACE0


@dataclass
class Blocks(InputPartition):
    blocks: list


class BbiFile:
    def __init__(self, path: str):
        self.f = bgzf.open_raw(path)
        head = self.at(0, 64)
        self.e = "<" if struct.unpack("<I", head[:4])[0] in (WIG, BED) else ">"
        magic, _, _, tree, _, index, fields, defined, sql, _, buffer, _ = struct.unpack(self.e + "IHHQQQHHQQIQ", head)
        if magic not in (WIG, BED):
            raise ValueError("not a BigWig or BigBed file")
        self.bed, self.index, self.fields, self.compressed = magic == BED, index, fields, buffer > 0
        self.sql = self._text(sql) if sql else ""
        self.names: dict[int, str] = {}
        magic, _, key, _, _, _ = struct.unpack(self.e + "IIIIQQ", self.at(tree, 32))
        todo = [tree + 32]
        while todo:
            at = todo.pop()
            leaf, _, n = struct.unpack(self.e + "BBH", self.at(at, 4))
            data = self.at(at + 4, n * (key + 8))
            for k in range(n):
                name = data[k * (key + 8) : k * (key + 8) + key].rstrip(b"\0").decode()
                if leaf:
                    self.names[struct.unpack_from(self.e + "I", data, k * (key + 8) + key)[0]] = name
                else:
                    todo.append(struct.unpack_from(self.e + "Q", data, k * (key + 8) + key)[0])

    def at(self, offset: int, n: int) -> bytes:
        self.f.seek(offset)
        return self.f.read(n)

    def _text(self, at: int) -> str:
        out = b""
        while b"\0" not in out:
            more = self.at(at + len(out), 4096)
            if not more:
                break
            out += more
        return out.partition(b"\0")[0].decode()

    def blocks(self, regions) -> list[tuple[int, int]]:
        """(offset, size) of the data blocks that may touch the regions (1-based closed); None: all."""
        ids = {v: k for k, v in self.names.items()}
        spans = None if regions is None else [(ids[r.chrom], r.start - 1, r.end if r.end is not None else 1 << 32) for r in regions if r.chrom in ids]

        def touches(c0, s0, c1, s1):
            return spans is None or any((c0, s0) < (c, e) and (c, s) < (c1, s1) or c0 <= c <= c1 and c0 != c1 for c, s, e in spans)

        out, todo = [], [self.index + 48]
        while todo:
            at = todo.pop()
            leaf, _, n = struct.unpack(self.e + "BBH", self.at(at, 4))
            size = 32 if leaf else 24
            data = self.at(at + 4, n * size)
            for k in range(n):
                c0, s0, c1, s1 = struct.unpack_from(self.e + "IIII", data, k * size)
                if touches(c0, s0, c1, s1):
                    if leaf:
                        out.append(struct.unpack_from(self.e + "QQ", data, k * size + 16))
                    else:
                        todo.append(struct.unpack_from(self.e + "Q", data, k * size + 16)[0])
        return sorted(out)

    def data(self, offset: int, size: int) -> bytes:
        raw = self.at(offset, size)
        return zlib.decompress(raw) if self.compressed else raw

    def wig(self, offset: int, size: int) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
        raw = self.data(offset, size)
        chrom, start, _, step, span, kind, _, n = struct.unpack_from(self.e + "IIIIIBBH", raw)
        if kind == 1:
            a = np.frombuffer(raw, np.dtype([("s", self.e + "u4"), ("e", self.e + "u4"), ("v", self.e + "f4")]), n, 24)
            return self.names[chrom], a["s"].astype(np.int64), a["e"].astype(np.int64), a["v"].astype(np.float32)
        if kind == 2:
            a = np.frombuffer(raw, np.dtype([("s", self.e + "u4"), ("v", self.e + "f4")]), n, 24)
            s = a["s"].astype(np.int64)
            return self.names[chrom], s, s + span, a["v"].astype(np.float32)
        v = np.frombuffer(raw, self.e + "f4", n, 24).astype(np.float32)
        s = start + step * np.arange(n, dtype=np.int64)
        return self.names[chrom], s, s + span, v

    def bed_rows(self, offset: int, size: int) -> Iterator[tuple[str, int, int, str]]:
        raw, at = self.data(offset, size), 0
        while at + 12 < len(raw):
            chrom, s, e = struct.unpack_from(self.e + "III", raw, at)
            end = raw.index(0, at + 12)
            yield self.names[chrom], s, e, raw[at + 12 : end].decode()
            at = end + 1


def autosql(text: str) -> list[tuple[str, str]]:
    """(name, Spark type) of the columns behind the first three; [] if there is no usable declaration."""
    kinds = {"int": "int", "uint": "bigint", "short": "int", "ushort": "int", "byte": "int", "ubyte": "int", "bigint": "bigint", "float": "float", "double": "double"}
    found = re.findall(r"^\s*([a-z]+(?:\[\w+\])?)\s+(\w+)\s*;", text.partition("(")[2], re.M)
    return [(n, kinds.get(t, "string")) for t, n in found][3:]


class _BbiReader(Reader):
    regions = None

    def pushFilters(self, filters):
        zero = option(self.options, "zeroBased", "true") == "true"
        self.regions = extract_regions(filters, zero)
        return filters

    def partitions(self):
        every = BbiFile(self.path).blocks(self.regions)
        n = max(1, min(len(every) or 1, int(option(self.options, "partitions", "16"))))
        return [Blocks(every[k * len(every) // n : (k + 1) * len(every) // n]) for k in range(n)]


class BigWigReader(_BbiReader):
    def read(self, part):
        f, add = BbiFile(self.path), option(self.options, "zeroBased", "true") != "true"
        for offset, size in part.blocks:
            chrom, s, e, v = f.wig(offset, size)
            yield self.batch({"chrom": pa.array([chrom] * len(s), pa.string()), "start": pa.array(s + add), "end": pa.array(e), "value": pa.array(v)})


class BigBedReader(_BbiReader):
    def read(self, part):
        f, add = BbiFile(self.path), option(self.options, "zeroBased", "true") != "true"
        extra = autosql(f.sql)
        cast = {"int": int, "bigint": int, "float": float, "double": float, "string": str}
        kinds = {"int": pa.int32(), "bigint": pa.int64(), "float": pa.float32(), "double": pa.float64(), "string": pa.string()}
        for offset, size in part.blocks:
            rows = list(f.bed_rows(offset, size))
            columns = {"chrom": pa.array([r[0] for r in rows], pa.string()), "start": pa.array([r[1] + add for r in rows], pa.int64()), "end": pa.array([r[2] for r in rows], pa.int64())}
            if extra:
                parts = [r[3].split("\t") if r[3] else [] for r in rows]
                for k, (n, t) in enumerate(extra):
                    columns[n] = pa.array([cast[t](p[k]) if len(p) > k and p[k] != "" else None for p in parts], kinds[t])
            else:
                columns["rest"] = pa.array([r[3] for r in rows], pa.string())
            yield self.batch(columns)


class BigWigSource(DataSource):
    @classmethod
    def name(cls):
        return "bigwig"

    def schema(self):
        return pruned([("chrom", "string"), ("start", "bigint"), ("end", "bigint"), ("value", "float")], self.options)

    def reader(self, schema):
        return BigWigReader(self.options, schema)


class BigBedSource(DataSource):
    @classmethod
    def name(cls):
        return "bigbed"

    def schema(self):
        extra = autosql(BbiFile(option(self.options, "path")).sql) or [("rest", "string")]
        return pruned([("chrom", "string"), ("start", "bigint"), ("end", "bigint"), *extra], self.options)

    def reader(self, schema):
        return BigBedReader(self.options, schema)
