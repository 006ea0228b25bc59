"""Genotype containers: BGEN, PGEN, BCF and VCF Zarr."""

from __future__ import annotations

import json
import math
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, InputPartition

from helixframe.plans.regions import extract_regions

from . import bgzf
from .binary import Range, Reader, option, pruned
from .text import parse_vcf_header, select_samples


def zstd(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompressobj().decompress(data)


@dataclass
class Rows(InputPartition):
    rows: list


def _deal(rows: list, options: dict) -> list[Rows]:
    n = max(1, min(len(rows), int(option(options, "partitions", "16"))))
    return [Rows(rows[k * len(rows) // n : (k + 1) * len(rows) // n]) for k in range(n)] if rows else [Rows([])]


def _zero(options: dict) -> bool:
    return option(options, "zeroBased", "true") == "true"


class _Filtered(Reader):
    regions = None

    def pushFilters(self, filters):
        self.regions = extract_regions(filters, _zero(self.options))
        return filters

    def touched(self, chrom: str, first: int, last: int) -> bool:
        """Whether a variant (1-based closed) may pass the pushed filters."""
        return self.regions is None or any(r.chrom == chrom and first <= (r.end or 1 << 62) and r.start <= last for r in self.regions)

    def chosen(self, samples: list[str]) -> list[int]:
        wanted = [s for s in option(self.options, "samples").split(",") if s] or None
        return [samples.index(s) for s in select_samples(samples, wanted, option(self.options, "missingSamples", "error"))]


# --- BGEN ----------------------------------------------------------------------------------------------------------


class Bgen:
    def __init__(self, path: str):
        self.f = bgzf.open_raw(path)
        head = self.at(0, 24)
        self.first, length, self.variants, self.n = struct.unpack("<IIII", head[:16])
        self.first += 4
        if head[16:20] not in (b"bgen", b"\0\0\0\0"):
            raise ValueError("not a BGEN file")
        (flags,) = struct.unpack("<I", self.at(length, 4))
        self.compression, self.layout = flags & 3, flags >> 2 & 15
        self.samples = [f"sample_{k}" for k in range(self.n)]
        if flags >> 31:
            size, n = struct.unpack("<II", self.at(4 + length, 8))
            data, at = self.at(12 + length, size - 8), 0
            self.samples = []
            for _ in range(n):
                (k,) = struct.unpack_from("<H", data, at)
                self.samples.append(data[at + 2 : at + 2 + k].decode())
                at += 2 + k

    def at(self, offset: int, n: int) -> bytes:
        self.f.seek(offset)
        return self.f.read(n)

    def catalogue(self) -> Iterator[tuple]:
        """(chrom, position, id, rsid, alleles, data offset, data size) of each variant; probabilities are skipped."""
        at = self.first
        for _ in range(self.variants):
            data = self.at(at, 4096)
            k = 4 if self.layout == 1 else 0

            def text(fmt: str) -> str:
                nonlocal k, data
                size = struct.calcsize(fmt)
                if k + size > len(data):
                    data = self.at(at, len(data) * 4)
                (n,) = struct.unpack_from(fmt, data, k)
                while k + size + n + 16 > len(data) and len(data) >= 4096:
                    more = self.at(at, len(data) * 4)
                    if len(more) == len(data):
                        break
                    data = more
                k += size + n
                return data[k - n : k].decode()

            ident, rsid, chrom = text("<H"), text("<H"), text("<H")
            pos, count = (*struct.unpack_from("<I", data, k), 2) if self.layout == 1 else struct.unpack_from("<IH", data, k)
            k += 4 if self.layout == 1 else 6
            alleles = [text("<I") for _ in range(count)]
            if self.layout == 1 and not self.compression:
                size = 6 * self.n
            else:
                (size,) = struct.unpack("<I", self.at(at + k, 4))
                k += 4
            yield chrom, pos, ident, rsid, alleles, at + k, size
            at += k + size

    def raw(self, offset: int, size: int) -> bytes:
        data = self.at(offset, size)
        if not self.compression:
            return data
        if self.layout == 2:
            data = data[4:]
        return zlib.decompress(data) if self.compression == 1 else zstd(data)

    def probabilities(self, offset: int, size: int, alleles: int) -> tuple[bool, int, np.ndarray, list[np.ndarray | None]]:
        """(phased, bits, ploidies, for each sample its probabilities or None if missing)."""
        raw = self.raw(offset, size)
        if self.layout == 1:
            v = np.frombuffer(raw, "<u2", 3 * self.n).reshape(-1, 3).astype(np.float64)
            total = v.sum(1)
            if not np.isin(total, (0, 32767, 32768, 32769)).all():
                raise ValueError("BGEN layout 1 probabilities don't add up")
            return False, 16, np.full(self.n, 2), [None if t == 0 else p / 32768 for p, t in zip(v, total, strict=True)]
        n, k, _, _ = struct.unpack_from("<IHBB", raw)
        if n != self.n or k != alleles:
            raise ValueError("BGEN block and header disagree")
        marks = np.frombuffer(raw, np.uint8, n, 8)
        phased, bits = raw[8 + n], raw[9 + n]
        if phased > 1 or not 1 <= bits <= 32:
            raise ValueError("BGEN block is malformed")
        ploidy, missing = (marks & 63).astype(int), marks >> 7 == 1
        stored = {z: z * (k - 1) if phased else math.comb(z + k - 1, k - 1) - 1 for z in set(ploidy.tolist())}
        counts = np.array([stored[z] for z in ploidy.tolist()])
        data = np.frombuffer(raw, np.uint8, -1, 10 + n)
        total = int(counts.sum())
        if bits in (8, 16, 32):
            values = data[: total * bits // 8].view(f"<u{bits // 8}").astype(np.float64)
        else:
            b = np.unpackbits(data, bitorder="little")[: total * bits].reshape(total, bits)
            values = b @ (1 << np.arange(bits, dtype=np.uint64)).astype(np.float64)
        values = values / ((1 << bits) - 1)
        out: list = []
        at = 0
        for z, c, m in zip(ploidy.tolist(), counts.tolist(), missing.tolist(), strict=True):
            p = values[at : at + c]
            at += c
            if m:
                out.append(None)
            elif phased:
                h = p.reshape(z, k - 1)
                out.append(np.column_stack((h, 1 - h.sum(1))).reshape(-1))
            else:
                out.append(np.append(p, 1 - p.sum()))
        return bool(phased), bits, ploidy, out


def dosage(p: np.ndarray | None, phased: bool) -> float | None:
    """Expected copies of the second allele of a biallelic variant."""
    if p is None:
        return None
    return float(p[1::2].sum()) if phased else float(p @ np.arange(len(p)))


class BgenReader(_Filtered):
    def partitions(self):
        found = [v for v in Bgen(self.path).catalogue() if self.touched(v[0], v[1], v[1] + len(v[4][0]) - 1)]
        return _deal(found, self.options)

    def read(self, part):
        f = Bgen(self.path)
        keep = self.chosen(f.samples)
        fields = [x for x in option(self.options, "genotypeFields", "GP").split(",") if x]
        kinds = {"GP": pa.list_(pa.list_(pa.float32())), "DS": pa.list_(pa.float32()), "PLOIDY": pa.list_(pa.int16())}
        for a in range(0, len(part.rows), 256):
            rows = part.rows[a : a + 256]
            cols: dict[str, list] = {x: [] for x in ("phased", "bits", *fields)}
            for v in rows:
                if not {"genotypes", "phased", "bits"} & set(self.names):
                    break
                phased, bits, ploidy, probs = f.probabilities(v[5], v[6], len(v[4]))
                if "DS" in fields and len(v[4]) != 2 and keep:
                    raise ValueError("dosage of a variant that is not biallelic")
                cols["phased"].append(phased)
                cols["bits"].append(bits)
                for x in fields:
                    cols[x].append([None if x == "GP" and probs[i] is None else probs[i].tolist() if x == "GP" else dosage(probs[i], phased) if x == "DS" else int(ploidy[i]) for i in keep])
            z = _zero(self.options)
            out = {
                "chrom": pa.array([v[0] for v in rows], pa.string()), "start": pa.array([v[1] - z for v in rows], pa.int64()), "end": pa.array([v[1] + len(v[4][0]) - 1 for v in rows], pa.int64()),
                "id": pa.array([v[2] or None for v in rows], pa.string()), "rsid": pa.array([v[3] or None for v in rows], pa.string()), "alleles": pa.array([v[4] for v in rows], pa.list_(pa.string())),
            }
            if cols["phased"]:
                out |= {"phased": pa.array(cols["phased"]), "bits": pa.array(cols["bits"], pa.int16()), "genotypes": pa.StructArray.from_arrays([pa.array(cols[x], kinds[x]) for x in fields], fields)}
            yield self.batch(out)


class BgenSource(DataSource):
    """``genotypeFields``: GP, or DS with or without PLOIDY; PLOIDY alone is refused."""

    @classmethod
    def name(cls):
        return "bgen"

    def schema(self):
        fields = [x for x in option(self.options, "genotypeFields", "GP").split(",") if x]
        kinds = {"GP": "array<array<float>>", "DS": "array<float>", "PLOIDY": "array<smallint>"}
        if unknown := [x for x in fields if x not in kinds]:
            raise ValueError(f"no such genotype field: {unknown[0]}")
        if fields == ["PLOIDY"] or {"GP", "DS"} <= set(fields):
            raise ValueError("genotypeFields: GP, or DS with or without PLOIDY")
        core = [("chrom", "string"), ("start", "bigint"), ("end", "bigint"), ("id", "string"), ("rsid", "string"), ("alleles", "array<string>"), ("phased", "boolean"), ("bits", "smallint")]
        return pruned(core + [("genotypes", "struct<" + ",".join(f"{x}:{kinds[x]}" for x in fields) + ">")], self.options)

    def reader(self, schema):
        return BgenReader(self.options, schema)


# --- PGEN ----------------------------------------------------------------------------------------------------------


def _companion(path: str, suffixes: tuple[str, ...]) -> str:
    stem = path.removesuffix(".pgen")
    for s in suffixes:
        try:
            bgzf.open_raw(stem + s).close()
            return stem + s
        except (FileNotFoundError, OSError):
            continue
    raise FileNotFoundError(f"no {' or '.join(suffixes)} beside the .pgen file")


def _table(path: str) -> tuple[list[str], list[list[str]]]:
    """Column names of the last header line, and the rows, of a .pvar or .psam file."""
    raw = bgzf.read_all(path)
    lines = (zstd(raw) if path.endswith(".zst") else raw).decode().splitlines()
    head = [x for x in lines if x.startswith("#") and not x.startswith("##")]
    return (head[-1][1:].split() if head else []), [x.split() for x in lines if x and not x.startswith("#")]


class Pgen:
    def __init__(self, path: str):
        self.f = bgzf.open_raw(path)
        names, rows = _table(_companion(path, (".pvar", ".pvar.zst")))
        at = {n: k for k, n in enumerate(names or ["CHROM", "POS", "ID", "REF", "ALT"])}
        self.variants = [(r[at["CHROM"]], int(r[at["POS"]]), r[at["ID"]], r[at["REF"]], r[at["ALT"]].split(",")) for r in rows]
        names, rows = _table(_companion(path, (".psam",)))
        k = names.index("IID") if "IID" in names else 0
        self.samples = [r[k] for r in rows]
        magic = self.at(0, 3)
        if magic[:2] != b"\x6c\x1b":
            raise ValueError("not a PGEN file")
        self.mode = magic[2]
        self.n, m = len(self.samples), len(self.variants)
        width = (self.n + 3) // 4
        if self.mode == 1:
            self.types, self.offsets, self.sizes = [0] * m, [3 + k * width for k in range(m)], [width] * m
            return
        m_, n_, control = struct.unpack("<IIB", self.at(3, 9))
        if (m_, n_) != (m, self.n):
            raise ValueError("PGEN header and companions disagree")
        if self.mode == 2:
            start = 12 + ((m + 7) // 8 if control >> 6 == 3 else 0)
            self.types, self.offsets, self.sizes = [0] * m, [start + k * width for k in range(m)], [width] * m
            return
        if self.mode not in (0x10, 0x11):
            raise ValueError(f"PGEN mode {self.mode:#x} is not read")
        low = control & 15
        if low > 7:
            raise ValueError("PGEN header layout is not read")
        wide, length, alleles, nonref = low >= 4, (low & 3) + 1, control >> 4 & 3, control >> 6 == 3
        blocks = -(-m // 65536)
        starts = struct.unpack(f"<{blocks}Q", self.at(12, 8 * blocks))
        at_ = 12 + 8 * blocks
        self.types, self.offsets, self.sizes = [], [], []
        for b in range(blocks):
            count = min(65536, m - b * 65536)
            size = count if wide else (count + 1) // 2
            t = np.frombuffer(self.at(at_, size), np.uint8)
            t = t if wide else np.column_stack((t & 15, t >> 4)).reshape(-1)[:count]
            at_ += size
            raw = np.frombuffer(self.at(at_, count * length), np.uint8).reshape(count, length).astype(np.int64)
            sizes = raw @ (1 << (8 * np.arange(length)))
            at_ += count * (length + alleles) + ((count + 7) // 8 if nonref else 0)
            self.types += t.tolist()
            self.sizes += sizes.tolist()
            self.offsets += (starts[b] + np.concatenate(([0], np.cumsum(sizes)[:-1]))).tolist()

    def at(self, offset: int, n: int) -> bytes:
        self.f.seek(offset)
        return self.f.read(n)

    def base_of(self, k: int) -> int | None:
        """The variant whose genotypes variant ``k`` is a difference to."""
        if self.types[k] & 7 not in (2, 3):
            return None
        while self.types[k] & 7 in (2, 3):
            k -= 1
        return k

    def _varint(self, d: bytes, at: int) -> tuple[int, int]:
        out = shift = 0
        while True:
            b = d[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out, at
            shift += 7

    def _ids(self, d: bytes, at: int, values: bool) -> tuple[np.ndarray, np.ndarray | None, int]:
        """Sample numbers of a difference list, its 2-bit values if it has any, and the place behind it."""
        n, at = self._varint(d, at)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint8), at
        groups, width = -(-n // 64), max(1, (int(self.n).bit_length() + 7) // 8)
        starts = [int.from_bytes(d[at + g * width : at + (g + 1) * width], "little") for g in range(groups)]
        at += groups * width + groups - 1
        got = None
        if values:
            got = unpack2(d[at : at + (n + 3) // 4], n)
            at += (n + 3) // 4
        ids = np.empty(n, np.int64)
        for g in range(groups):
            x = starts[g]
            ids[g * 64] = x
            for k in range(g * 64 + 1, min(g * 64 + 64, n)):
                step, at = self._varint(d, at)
                x += step
                ids[k] = x
        return ids, got, at

    def genotypes(self, k: int) -> tuple[np.ndarray, bytes, int]:
        """Codes 0, 1, 2 or 3 (missing) of every sample, the record, and the place behind its main track."""
        d, t = self.at(self.offsets[k], self.sizes[k]), self.types[k]
        if self.mode == 1:
            return np.array([2, 3, 1, 0], np.uint8)[unpack2(d, self.n)], d, len(d)
        kind, at = t & 7, 0
        if kind == 0:
            return unpack2(d, self.n), d, (self.n + 3) // 4
        if kind == 5:
            raise ValueError("PGEN record type 5 is reserved")
        if kind == 1:
            code = d[0]
            size = (self.n + 7) // 8
            bits = np.unpackbits(np.frombuffer(d, np.uint8, size, 1), bitorder="little")[: self.n]
            g, at = ((code >> 2) + bits * (code & 3)).astype(np.uint8), 1 + size
        elif kind in (2, 3):
            g = self.genotypes(self.base_of(k))[0].copy()
        else:
            g = np.full(self.n, {4: 0, 6: 2, 7: 3}[kind], np.uint8)
        ids, values, at = self._ids(d, at, True)
        g[ids] = values
        if kind == 3:
            g = np.array([2, 1, 0, 3], np.uint8)[g]
        return g, d, at

    def read(self, k: int) -> dict[str, np.ndarray]:
        """GT (first, second allele; -1 missing), PHASED, ALT_COUNT (-1 missing), DS (nan missing)."""
        g, d, at = self.genotypes(k)
        t = self.types[k]
        if t & 0x88:
            raise ValueError("multiallelic patches and phased dosages are not read")
        first, second = np.where(g == 2, 1, np.where(g == 3, -1, 0)), np.where(g == 3, -1, np.where(g >= 1, 1, 0))
        phased = np.zeros(self.n, bool)
        if t & 0x10:
            hets = np.flatnonzero(g == 1)
            size = 1 + len(hets) // 8
            bits = np.unpackbits(np.frombuffer(d, np.uint8, size, at), bitorder="little").astype(bool)
            at += size
            if bits[0]:
                known = hets[bits[1 : 1 + len(hets)]]
                size = (len(known) + 7) // 8
                turn = np.unpackbits(np.frombuffer(d, np.uint8, size, at), bitorder="little")[: len(known)].astype(bool)
                at += size
            else:
                known, turn = hets, bits[1 : 1 + len(hets)]
            phased[known] = True
            first[known[turn]], second[known[turn]] = 1, 0
        count = np.where(g == 3, -1, g).astype(np.int8)
        ds = np.where(g == 3, np.nan, g).astype(np.float32)
        stored = np.zeros(self.n, bool)
        if t & 0x60:
            kind = t >> 5 & 3
            if kind == 1:
                ids, _, at = self._ids(d, at, False)
            elif kind == 2:
                ids = np.arange(self.n)
            else:
                size = (self.n + 7) // 8
                ids = np.flatnonzero(np.unpackbits(np.frombuffer(d, np.uint8, size, at), bitorder="little")[: self.n])
                at += size
            v = np.frombuffer(d, "<u2", len(ids), at)
            good = v != 65535
            ds[ids] = np.where(good, v / 16384, np.nan)
            stored[ids[good]] = True
        return {"GT": np.column_stack((first, second)), "PHASED": phased, "ALT_COUNT": count, "DS": ds, "DS_STORED": stored, "missing": g == 3}


def unpack2(data: bytes, n: int) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    return np.column_stack((b & 3, b >> 2 & 3, b >> 4 & 3, b >> 6)).reshape(-1)[:n]


_PGEN = {"GT": "array<array<int>>", "ALT_COUNT": "array<tinyint>", "PHASED": "array<boolean>", "DS": "array<float>", "DS_STORED": "array<float>"}


class PgenReader(_Filtered):
    def partitions(self):
        f = Pgen(self.path)
        return _deal([k for k, v in enumerate(f.variants) if self.touched(v[0], v[1], v[1] + len(v[3]) - 1)], self.options)

    def read(self, part):
        f = Pgen(self.path)
        keep = np.array(self.chosen(f.samples), np.int64)
        fields = [x for x in option(self.options, "genotypeFields", "GT").split(",") if x]
        kinds = {"GT": pa.list_(pa.list_(pa.int32())), "ALT_COUNT": pa.list_(pa.int8()), "PHASED": pa.list_(pa.bool_()), "DS": pa.list_(pa.float32()), "DS_STORED": pa.list_(pa.float32())}
        for a in range(0, len(part.rows), 256):
            rows = part.rows[a : a + 256]
            vs = [f.variants[k] for k in rows]
            z = _zero(self.options)
            out = {
                "chrom": pa.array([v[0] for v in vs], pa.string()), "start": pa.array([v[1] - z for v in vs], pa.int64()), "end": pa.array([v[1] + len(v[3]) - 1 for v in vs], pa.int64()),
                "id": pa.array([None if v[2] == "." else v[2] for v in vs], pa.string()), "ref": pa.array([v[3] for v in vs], pa.string()), "alt": pa.array([v[4] for v in vs], pa.list_(pa.string())),
            }
            if "genotypes" in self.names:
                got = [{n: x[keep] for n, x in f.read(k).items()} for k in rows]
                values = {
                    "GT": lambda g: [None if m else x for x, m in zip(g["GT"].tolist(), g["missing"].tolist(), strict=True)],
                    "ALT_COUNT": lambda g: [None if x < 0 else x for x in g["ALT_COUNT"].tolist()],
                    "PHASED": lambda g: [None if m else x for x, m in zip(g["PHASED"].tolist(), g["missing"].tolist(), strict=True)],
                    "DS": lambda g: [None if x != x else x for x in g["DS"].tolist()],
                    "DS_STORED": lambda g: [x if s else None for x, s in zip(g["DS"].tolist(), g["DS_STORED"].tolist(), strict=True)],
                }
                out["genotypes"] = pa.StructArray.from_arrays([pa.array([values[x](g) for g in got], kinds[x]) for x in fields], fields)
            yield self.batch(out)


class PgenSource(DataSource):
    """``genotypeFields``: GT, ALT_COUNT, PHASED, DS, DS_STORED."""

    @classmethod
    def name(cls):
        return "pgen"

    def schema(self):
        fields = [x for x in option(self.options, "genotypeFields", "GT").split(",") if x]
        if unknown := [x for x in fields if x not in _PGEN]:
            raise ValueError(f"no such genotype field: {unknown[0]}")
        core = [("chrom", "string"), ("start", "bigint"), ("end", "bigint"), ("id", "string"), ("ref", "string"), ("alt", "array<string>")]
        return pruned(core + [("genotypes", "struct<" + ",".join(f"{x}:{_PGEN[x]}" for x in fields) + ">")], self.options)

    def reader(self, schema):
        return PgenReader(self.options, schema)


# --- BCF -----------------------------------------------------------------------------------------------------------

_WIDTH = {1: ("<i1", -128), 2: ("<i2", -32768), 3: ("<i4", -(1 << 31)), 5: ("<f4", None), 7: ("S1", None)}
_SCALARS = {"Integer": ("int", pa.int32()), "Float": ("float", pa.float32()), "String": ("string", pa.string()), "Character": ("string", pa.string()), "Flag": ("boolean", pa.bool_())}


def _bcf_text(path: str) -> tuple[bgzf.Blocks, dict, int]:
    blocks = bgzf.Blocks(path)
    blocks.need(0, 9)
    if blocks.get(0, 3) != b"BCF":
        raise ValueError("not a BCF file")
    (n,) = struct.unpack("<I", blocks.get(5, 4))
    blocks.need(9, n)
    head = parse_vcf_header(blocks.get(9, n).rstrip(b"\0").decode().splitlines())
    return blocks, head, 9 + n


def _dictionary(head: dict) -> list[str]:
    """Names by number: PASS first, then FILTER, INFO and FORMAT ids in the order of the header."""
    import re

    out = {0: "PASS"}
    k = 1
    known = {"PASS"}
    for line in head["lines"]:
        m = re.match(r"##(?:FILTER|INFO|FORMAT)=<ID=([^,>]+)", line)
        if m and m[1] not in known:
            i = re.search(r"IDX=(\d+)", line)
            out[int(i[1]) if i else k] = m[1]
            known.add(m[1])
            k += 1
    return [out.get(i, "") for i in range(max(out) + 1)]


class _Typed:
    """Typed values of a BCF record."""

    def __init__(self, data: bytes, at: int = 0):
        self.d, self.at = data, at

    def descriptor(self) -> tuple[int, int]:
        b = self.d[self.at]
        self.at += 1
        n = b >> 4
        if n == 15:
            n = self.values()[0]
        return b & 15, n

    def raw(self, kind: int, n: int):
        if kind == 0 or n == 0:
            return []
        if kind == 7:
            self.at += n
            return self.d[self.at - n : self.at].split(b"\0")[0].decode()
        dtype, missing = _WIDTH[kind]
        v = np.frombuffer(self.d, dtype, n, self.at)
        self.at += v.nbytes
        if kind == 5:
            bits = v.view("<u4")
            return [None if b == 0x7F800001 else float(x) for x, b in zip(v, bits, strict=True) if b != 0x7F800002]
        return [None if x == missing else int(x) for x in v if x != missing + 1]

    def values(self):
        return self.raw(*self.descriptor())


def _gt(codes: list) -> str:
    text = ""
    for k, c in enumerate(codes):
        c = 0 if c is None else c
        text += ("" if k == 0 else "|" if c & 1 else "/") + ("." if c >> 1 == 0 else str((c >> 1) - 1))
    return text or "."


def _dosage_mode(options: dict, head: dict) -> bool:
    """Dosage mode reads GT as the count of allele 1; GT must be the only FORMAT field."""
    on = option(options, "dosage", "false") == "true"
    if on and list(head["format"]) != ["GT"]:
        raise ValueError("dosage needs GT as the only FORMAT field")
    return on


def gt_dosage(codes: list) -> int | None:
    """Copies of allele 1; None if an allele is missing."""
    if not codes:
        raise ValueError("genotype without alleles")
    alleles = [(c or 0) >> 1 for c in codes]
    if 0 in alleles:
        return None
    count = sum(a == 2 for a in alleles)
    if count > 127:
        raise ValueError("dosage over 127")
    return count


def _begins(blocks: bgzf.Blocks, at: int, contigs: int, samples: int, depth: int = 4) -> bool:
    """Whether BCF records begin at a stream position: a chain of well-formed ones, or the end of the file."""
    for k in range(depth):
        if not blocks.need(at, 32):
            return k > 0 and at == blocks.base + len(blocks.data)
        shared, indiv, chrom, pos, rlen, _, info_alleles, fmt_samples = struct.unpack("<IIiiifII", blocks.get(at, 32))
        if not (24 < shared < 1 << 28 and indiv < 1 << 30 and 0 <= chrom < contigs and pos >= -1 and rlen >= 0 and info_alleles >> 16 >= 1 and fmt_samples & 0xFFFFFF == samples):
            return False
        if (indiv == 0) != (fmt_samples >> 24 == 0):
            return False
        at += 8 + shared + indiv
    return True


class BcfReader(_Filtered):
    """Block ranges of ``splitBytes``; a range owns the records that begin in it."""

    def partitions(self):
        n, step = bgzf.size_of(self.path), int(option(self.options, "splitBytes", str(64 << 20)))
        return [Range(a, min(a + step, n)) for a in range(0, max(n, 1), step)]

    def read(self, part):
        blocks, head, at = _bcf_text(self.path)
        names, contigs = _dictionary(head), list(head["contigs"])
        size = bgzf.size_of(self.path)
        with bgzf.open_raw(self.path) as f:
            start = bgzf.find_block(f, part.start, size)
            stop = bgzf.find_block(f, part.end, size) if part.end < size else size
        if start >= stop:
            return
        if part.start > 0:
            blocks, at = bgzf.Blocks(self.path, start), 0
            while blocks.need(at, 32) and blocks.block_of(at) < stop and not _begins(blocks, at, len(contigs), len(head["samples"])):
                at += 1
                if at > 1 << 30:
                    raise ValueError(f"no record begins behind byte {start} of the BCF file")
        rows, z = [], _zero(self.options)
        keep = self.chosen(head["samples"])
        self.dosage = _dosage_mode(self.options, head)
        while blocks.need(at, 8) and blocks.block_of(at) < stop:
            shared, indiv = struct.unpack("<II", blocks.get(at, 8))
            if not blocks.need(at + 8, shared + indiv):
                raise ValueError("BCF record cut off")
            d = blocks.get(at + 8, shared + indiv)
            at += 8 + shared + indiv
            blocks.drop(at)
            chrom, pos, rlen, _, info_alleles, fmt_samples = struct.unpack_from("<iiifII", d)
            first = pos + 1
            if not self.touched(contigs[chrom], first, pos + max(rlen, 1)):
                continue
            qual = None if d[12:16] == struct.pack("<I", 0x7F800001) else struct.unpack_from("<f", d, 12)[0]
            t = _Typed(d, 24)
            ident = t.values() or ""
            alleles = [t.values() or "" for _ in range(info_alleles >> 16)]
            filters = t.values()
            if self.dosage and len(alleles) != 2:
                raise ValueError("dosage of a variant without exactly one ALT")
            r = {"chrom": contigs[chrom], "start": pos + (not z), "end": pos + max(rlen, 1), "id": "" if ident == "." else ident, "ref": alleles[0], "alt": "|".join(alleles[1:]), "qual": qual, "filter": ";".join(names[x] for x in filters)}
            for n, spec in head["info"].items():
                if spec["type"] == "Flag":
                    r[n] = False
            for _ in range(info_alleles & 0xFFFF):
                key = names[t.values()[0]]
                kind, n = t.descriptor()
                v = t.raw(kind, n)
                spec = head["info"].get(key, {"type": "String", "number": "."})
                r[key] = True if spec["type"] == "Flag" else self._value(v, spec)
            t = _Typed(d, shared)
            for _ in range(fmt_samples >> 24):
                key = names[t.values()[0]]
                kind, n = t.descriptor()
                each = [t.raw(kind, n) for _ in range(fmt_samples & 0xFFFFFF)]
                spec = head["format"].get(key, {"type": "String", "number": "."})
                r[f"F:{key}"] = [gt_dosage(each[i]) if self.dosage else _gt(each[i]) if key == "GT" else self._value(each[i], spec) for i in keep]
            rows.append(r)
            if len(rows) >= 2048:
                yield self._rows(rows, head)
                rows = []
        if rows:
            yield self._rows(rows, head)

    def _value(self, v, spec):
        if isinstance(v, str):
            return None if v in ("", ".") else v if spec["number"] == "1" else v.split(",")
        if spec["number"] == "1":
            return v[0] if v else None
        return v or None

    def _rows(self, rows, head):
        out = {n: pa.array([r[n] for r in rows], pa.string()) for n in ("chrom", "id", "ref", "alt", "filter")}
        out |= {n: pa.array([r[n] for r in rows], pa.int64()) for n in ("start", "end")} | {"qual": pa.array([r["qual"] for r in rows], pa.float64())}
        for n, s in head["info"].items():
            kind = _SCALARS[s["type"]][1]
            out[n] = pa.array([r.get(n) for r in rows], kind if s["number"] in ("0", "1") else pa.list_(kind))
        if head["format"] and head["samples"]:
            arrays = []
            for n, s in head["format"].items():
                kind = pa.int8() if self.dosage else _SCALARS[s["type"]][1]
                arrays.append(pa.array([r.get(f"F:{n}") for r in rows], pa.list_(kind if s["number"] in ("0", "1") else pa.list_(kind))))
            out["genotypes"] = pa.StructArray.from_arrays(arrays, list(head["format"]))
        return self.batch(out)


class BcfSource(DataSource):
    """BCF 2.2; FORMAT fields stand in ``genotypes`` for any number of samples."""

    @classmethod
    def name(cls):
        return "bcf"

    def schema(self):
        _, head, _ = _bcf_text(option(self.options, "path"))
        kind = lambda s: _SCALARS[s["type"]][0] if s["number"] in ("0", "1") else f"array<{_SCALARS[s['type']][0]}>"
        core = [("chrom", "string"), ("start", "bigint"), ("end", "bigint"), ("id", "string"), ("ref", "string"), ("alt", "string"), ("qual", "double"), ("filter", "string")]
        fields = core + [(n, kind(s)) for n, s in head["info"].items()]
        if head["format"] and head["samples"]:
            inner = "`GT`:array<tinyint>" if _dosage_mode(self.options, head) else ",".join(f"`{n}`:array<{kind(s)}>" for n, s in head["format"].items())
            fields.append(("genotypes", f"struct<{inner}>"))
        return pruned(fields, self.options)

    def reader(self, schema):
        return BcfReader(self.options, schema)


# --- VCF Zarr ------------------------------------------------------------------------------------------------------


class ZarrArray:
    """One array of a Zarr v2 directory store; compressors: none, zlib, gzip, zstd."""

    def __init__(self, root: str, name: str):
        self.path = f"{root}/{name}"
        self.meta = json.loads(bgzf.read_all(f"{self.path}/.zarray"))
        self.shape, self.chunks = self.meta["shape"], self.meta["chunks"]
        if self.meta.get("zarr_format") != 2:
            raise ValueError("Zarr format 2 only")

    def chunk(self, *at: int) -> np.ndarray:
        sep = self.meta.get("dimension_separator", ".")
        try:
            with bgzf.open_raw(f"{self.path}/{sep.join(map(str, at))}") as f:
                raw = f.read()
        except FileNotFoundError:
            return np.full(self.chunks, self.meta.get("fill_value") or 0, self.meta["dtype"] if self.meta["dtype"] != "|O" else object)
        c = self.meta.get("compressor")
        if c:
            raw = {"zlib": zlib.decompress, "gzip": lambda x: zlib.decompress(x, 31), "zstd": zstd}[c["id"]](raw)
        if self.meta["dtype"] == "|O":  # vlen-utf8
            (n,) = struct.unpack_from("<I", raw)
            out, k = [], 4
            for _ in range(n):
                (size,) = struct.unpack_from("<I", raw, k)
                out.append(raw[k + 4 : k + 4 + size].decode())
                k += 4 + size
            return np.array(out, object).reshape(self.chunks)
        return np.frombuffer(raw, self.meta["dtype"]).reshape(self.chunks, order=self.meta.get("order", "C"))

    def rows(self, k: int) -> np.ndarray:
        """All entries of the k-th chunk of the first dimension."""
        n = min(self.chunks[0], self.shape[0] - k * self.chunks[0])
        out = None
        grids = [range(-(-s // c)) for s, c in zip(self.shape[1:], self.chunks[1:], strict=True)]
        if not grids:
            return self.chunk(k)[:n]
        out = np.empty((n, *self.shape[1:]), object if self.meta["dtype"] == "|O" else self.meta["dtype"])
        for at in np.ndindex(*[len(g) for g in grids]):
            piece = self.chunk(k, *at)
            where = tuple(slice(i * c, min((i + 1) * c, s)) for i, c, s in zip(at, self.chunks[1:], self.shape[1:], strict=True))
            out[(slice(None), *where)] = piece[(slice(0, n), *[slice(0, w.stop - w.start) for w in where])]
        return out

    def all(self) -> np.ndarray:
        return np.concatenate([self.rows(k) for k in range(-(-self.shape[0] // self.chunks[0]))]) if self.shape[0] else np.zeros(0)


def _zarr_facts(root: str) -> tuple[dict, dict]:
    from pyarrow.fs import FileSelector

    from helixframe.sinks.lines import filesystem

    attrs = json.loads(bgzf.read_all(f"{root}/.zattrs"))
    if attrs.get("vcf_zarr_version") != "0.4":
        raise ValueError("VCF Zarr version 0.4 only")
    fs, p = filesystem(root)
    names = [x.base_name for x in fs.get_file_info(FileSelector(p))]
    return attrs, {n: ZarrArray(root, n) for n in names if fs.get_file_info(f"{p}/{n}/.zarray").is_file}


_ZARR_CORE = frozenset("contig position length id id_mask allele quality filter".split())


def _zarr_info(arrays: dict) -> dict[str, str]:
    def kind(a) -> str:
        d = a.meta["dtype"]
        t = "string" if d == "|O" else "boolean" if d == "|b1" else "float" if d[1] == "f" else "int"
        return t if len(a.shape) == 1 else f"array<{t}>"

    return {n.removeprefix("variant_"): kind(a) for n, a in sorted(arrays.items()) if n.startswith("variant_") and n.removeprefix("variant_") not in _ZARR_CORE and len(a.shape) <= 2}


class ZarrReader(_Filtered):
    def partitions(self):
        a = ZarrArray(self.path, "variant_position")
        every = list(range(-(-a.shape[0] // a.chunks[0])))
        try:
            index = ZarrArray(self.path, "region_index").all()
            contigs = ZarrArray(self.path, "contig_id").all()
            every = sorted({int(c) for c, contig, s, _, m, n in index if n > 0 and self.touched(str(contigs[contig]), int(s), int(m))})
        except FileNotFoundError:
            pass
        return [Rows([k]) for k in every] or [Rows([])]

    def read(self, part):
        _, arrays = _zarr_facts(self.path)
        contigs, filters = arrays["contig_id"].all(), arrays["filter_id"].all() if "filter_id" in arrays else []
        samples = [str(s) for s in arrays["sample_id"].all()] if "sample_id" in arrays else []
        z = _zero(self.options)
        for k in part.rows:
            pos, contig = arrays["variant_position"].rows(k), arrays["variant_contig"].rows(k)
            alleles = arrays["variant_allele"].rows(k)
            length = np.maximum(arrays["variant_length"].rows(k), 1) if "variant_length" in arrays else np.array([max(len(str(x[0])), 1) for x in alleles])
            text = lambda x: "" if x == "." else str(x)
            qual = arrays["variant_quality"].rows(k).astype(np.float64) if "variant_quality" in arrays else np.full(len(pos), np.nan)
            passed = arrays["variant_filter"].rows(k) if "variant_filter" in arrays else np.zeros((len(pos), 0), bool)
            out = {
                "chrom": pa.array([str(contigs[c]) for c in contig], pa.string()), "start": pa.array((pos - z).astype(np.int64)), "end": pa.array((pos + length - 1).astype(np.int64)),
                "id": pa.array([text(x) for x in (arrays["variant_id"].rows(k) if "variant_id" in arrays else ["."] * len(pos))], pa.string()),
                "ref": pa.array([str(x[0]) for x in alleles], pa.string()), "alt": pa.array(["|".join(str(y) for y in x[1:] if y) for x in alleles], pa.string()),
                "qual": pa.array([None if x != x else float(x) for x in qual], pa.float64()), "filter": pa.array([";".join(str(f) for f, y in zip(filters, x, strict=True) if y) for x in passed], pa.string()),
            }
            for n, t in _zarr_info(arrays).items():
                v = arrays[f"variant_{n}"].rows(k)
                many = t.startswith("array")
                kind = {"string": pa.string(), "boolean": pa.bool_(), "float": pa.float32(), "int": pa.int32()}[t[6:-1] if many else t]
                clean = lambda x: None if x in (-1, -2, ".", "") and not isinstance(x, (bool, np.bool_)) or x != x else x.item() if hasattr(x, "item") else x
                out[n] = pa.array([[clean(y) for y in x if not (y == -2 or y == "")] if many else clean(x) for x in v], pa.list_(kind) if many else kind)
            if "genotypes" in self.names:
                keep = self.chosen(samples)
                gt = arrays["call_genotype"].rows(k)[:, keep]
                phased = arrays["call_genotype_phased"].rows(k)[:, keep] if "call_genotype_phased" in arrays else np.zeros(gt.shape[:2], bool)

                def one(codes, ph):
                    parts = ["." if c == -1 else str(c) for c in codes.tolist() if c != -2]
                    return ("|" if ph else "/").join(parts) or "."

                out["genotypes"] = pa.StructArray.from_arrays([pa.array([[one(c, p) for c, p in zip(a, b, strict=True)] for a, b in zip(gt, phased, strict=True)], pa.list_(pa.string()))], ["GT"])
            yield self.batch(out)


class ZarrSource(DataSource):
    @classmethod
    def name(cls):
        return "vcf_zarr"

    def schema(self):
        _, arrays = _zarr_facts(option(self.options, "path"))
        fields = [("chrom", "string"), ("start", "bigint"), ("end", "bigint"), ("id", "string"), ("ref", "string"), ("alt", "string"), ("qual", "double"), ("filter", "string"), *_zarr_info(arrays).items()]
        if "call_genotype" in arrays:
            fields.append(("genotypes", "struct<GT:array<string>>"))
        return pruned(fields, self.options)

    def reader(self, schema):
        return ZarrReader(self.options, schema)


def describe_zarr(spark, path: str):
    """name, field_type, data_type, description of a store's fields."""
    _, arrays = _zarr_facts(path)
    rows = [(n, "INFO", t, "") for n, t in _zarr_info(arrays).items()]
    rows += [("GT", "FORMAT", "string", "genotype")] if "call_genotype" in arrays else []
    return spark.createDataFrame(rows, "name string, field_type string, data_type string, description string")
