"""Region indexes (TBI, CSI, BAI) and scans that read only the chunks a region needs."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql.datasource import DataSource, InputPartition

from helixframe.plans.regions import Region, Sized, balance

from . import bgzf
from .binary import Reader, option


@dataclass
class Index:
    names: list[str]
    bins: list[dict[int, list[tuple[int, int]]]] = field(default_factory=list)
    linear: list[list[int]] = field(default_factory=list)
    offsets: list[dict[int, int]] = field(default_factory=list)
    shift: int = 14
    depth: int = 5

    def chunks(self, ref: int, start: int, end: int) -> list[tuple[int, int]]:
        """Merged (from, to) virtual offsets of the records that may overlap 0-based half-open [start, end)."""
        end = min(end, 1 << (self.shift + 3 * self.depth))
        found, first, s = [], 0, self.shift + 3 * self.depth
        floor = 0
        if self.linear[ref:] and self.linear[ref]:
            k = start >> 14
            floor = self.linear[ref][k] if k < len(self.linear[ref]) else self.linear[ref][-1]
        for level in range(self.depth + 1):
            for b in range(first + (start >> s), first + (end - 1 >> s) + 1):
                found += self.bins[ref].get(b, [])
            first += 1 << (3 * level)
            s -= 3
        out: list[tuple[int, int]] = []
        for a, b in sorted(c for c in found if c[1] > floor):
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], max(b, out[-1][1]))
            else:
                out.append((a, b))
        return out

    @property
    def reach(self) -> int:
        """The first position that the bins can't hold: where a region without an end stops."""
        return 1 << (self.shift + 3 * self.depth)

    def size(self, ref: int, start: int, end: int) -> int:
        """Estimated compressed bytes of a region."""
        return sum(max((b >> 16) - (a >> 16), 1) for a, b in self.chunks(ref, start, end))


def find(path: str, explicit: str | None = None) -> str | None:
    """The index of a file: the one named, which must exist, or the first of the usual places."""
    if explicit:
        bgzf.open_raw(explicit).close()
        return explicit
    stem = path.rsplit(".", 1)[0]
    for p in (f"{path}.tbi", f"{path}.csi", f"{path}.bai", f"{stem}.bai", f"{path}.px2"):
        try:
            bgzf.open_raw(p).close()
            return p
        except (FileNotFoundError, OSError):
            continue
    return None


def load(path: str, names: list[str] | None = None) -> Index:
    """``names``: of the references, where the index has none (BAI, plain CSI)."""
    d = bgzf.read_all(path)
    magic = d[:4]
    if magic in (b"TBI\1", b"px2.", b"PX2\1"):
        n, _, _, _, _, _, _, size = struct.unpack_from("<8i", d, 4)
        names = d[36 : 36 + size].rstrip(b"\0").decode().split("\0")
        at, out = 36 + size, Index(names)
    elif magic == b"BAI\1":
        (n,) = struct.unpack_from("<i", d, 4)
        at, out = 8, Index(names or [])
    elif magic == b"CSI\1":
        shift, depth, aux = struct.unpack_from("<3i", d, 4)
        extra = d[16 : 16 + aux]
        if aux >= 28:
            names = extra[28:].rstrip(b"\0").decode().split("\0")
        (n,) = struct.unpack_from("<i", d, 16 + aux)
        at, out = 20 + aux, Index(names or [], shift=shift, depth=depth)
    else:
        raise ValueError("not an index")
    last = (1 << (3 * (out.depth + 1))) // 7 + 1
    for _ in range(n):
        bins: dict[int, list[tuple[int, int]]] = {}
        (count,) = struct.unpack_from("<i", d, at)
        at += 4
        for _ in range(count):
            if magic == b"CSI\1":
                b, _, k = struct.unpack_from("<IQi", d, at)
                at += 16
            else:
                b, k = struct.unpack_from("<Ii", d, at)
                at += 8
            if b < last:  # what lies beyond holds counts, not records
                bins[b] = [struct.unpack_from("<QQ", d, at + 16 * i) for i in range(k)]
            at += 16 * k
        out.bins.append(bins)
        linear: list[int] = []
        if magic != b"CSI\1":
            (k,) = struct.unpack_from("<i", d, at)
            linear = list(struct.unpack_from(f"<{k}Q", d, at + 4))
            at += 4 + 8 * k
        out.linear.append(linear)
    return out


def merged(regions: list[Region]) -> list[Region]:
    """Disjoint regions, sorted."""
    out: list[Region] = []
    for r in sorted(regions, key=lambda r: (r.chrom, r.start)):
        if out and out[-1].chrom == r.chrom and (out[-1].end is None or r.start <= out[-1].end + 1):
            end = None if out[-1].end is None or r.end is None else max(out[-1].end, r.end)
            out[-1] = Region(r.chrom, out[-1].start, end)
        else:
            out.append(r)
    return out


def plan(index: Index, regions: list[Region] | None, partitions: int) -> list[list[Region]]:
    """Regions dealt to partitions by their indexed bytes; None: every reference as a whole."""
    wanted = [Region(n) for n in index.names] if regions is None else merged(regions)
    sized = [Sized(r, index.size(index.names.index(r.chrom), r.start - 1, r.end or index.reach), index.reach) for r in wanted if r.chrom in index.names]
    return balance(sized, partitions) if sized else []


@dataclass
class Pieces(InputPartition):
    regions: list


class IndexedLinesReader(Reader):
    """Lines whose interval overlaps the regions. A line that reaches into several pieces belongs to the first of them."""

    def _regions(self) -> list[Region] | None:
        text = option(self.options, "regions")
        if not text:
            return None
        out = []
        for x in text.split(";"):
            chrom, _, span = x.rpartition(":")
            a, _, b = span.partition("-")
            out.append(Region(chrom, int(a), int(b) if b else None))
        return out

    def partitions(self):
        index = load(find(self.path, option(self.options, "index") or None))
        return [Pieces(p) for p in plan(index, self._regions(), int(option(self.options, "partitions", "16")))] or [Pieces([])]

    def read(self, part):
        index = load(find(self.path, option(self.options, "index") or None))
        every = merged(self._regions()) if option(self.options, "regions") else None
        columns = [int(x) for x in option(self.options, "intervalColumns", "0,1,2").split(",")]
        vcf = option(self.options, "kind", "vcf") == "vcf"
        for r in part.regions:
            held: list[str] = []
            for line in self._lines(index, r):
                f = line.split("\t", 8 if vcf else -1)
                if f[columns[0]] != r.chrom:
                    continue
                start = int(f[columns[1]])
                if vcf:
                    end = start + len(f[3]) - 1
                    for x in f[7].split(";") if len(f) > 7 else ():
                        if x.startswith("END="):
                            end = int(x[4:])
                else:
                    end = int(f[columns[2]])
                if r.end is not None and start > r.end or end < r.start:
                    continue
                if start < r.start:  # it began before this piece: another one has it, unless this is the first it touches
                    first = next((x for x in every or [] if x.chrom == r.chrom and (x.end is None or start <= x.end) and end >= x.start), None)
                    if first is None or first.start != r.start:
                        continue
                held.append(line)
                if len(held) >= 8192:
                    yield self.batch({"value": pa.array(held, pa.string())})
                    held = []
            if held:
                yield self.batch({"value": pa.array(held, pa.string())})

    def _lines(self, index: Index, r: Region):
        ref = index.names.index(r.chrom)
        for a, b in index.chunks(ref, r.start - 1, r.end or index.reach):
            blocks, at = bgzf.Blocks(self.path, a >> 16), a & 0xFFFF
            if not blocks.fill():
                return
            while True:
                block = blocks.block_of(at)
                inside = at - max((p for p, x in blocks.marks if x == block), default=0)
                if (block << 16 | inside) >= b:
                    break
                k = blocks.data.find(b"\n", at - blocks.base)
                while k < 0 and blocks.fill():
                    k = blocks.data.find(b"\n", at - blocks.base)
                if k < 0:
                    break
                line = blocks.data[at - blocks.base : k]
                at = blocks.base + k + 1
                if at >= blocks.base + len(blocks.data):
                    blocks.fill()
                if line[:1] != b"#":
                    yield line.decode()
                blocks.drop(at)


class IndexedLinesSource(DataSource):
    """Options: ``regions`` as chrom:start-end;..., 1-based closed; ``index``; ``kind``: vcf or interval; ``intervalColumns``."""

    @classmethod
    def name(cls):
        return "indexed_lines"

    def schema(self):
        return "value string"

    def reader(self, schema):
        return IndexedLinesReader(self.options, schema)


def build_tbi(path: str, columns: tuple[int, int, int] = (0, 1, 2), vcf: bool = True) -> str:
    """Index a sorted BGZF file of lines in one pass; written beside it."""
    from helixframe.sinks.lines import BGZF_END, compress, filesystem

    names: list[str] = []
    bins: list[dict[int, list[list[int]]]] = []
    linear: list[list[int]] = []
    blocks, at = bgzf.Blocks(path), 0

    def voffset(p: int) -> int:
        block = blocks.block_of(p)
        return block << 16 | p - max(x for x, b in blocks.marks if b == block)

    blocks.fill()
    while True:
        k = blocks.data.find(b"\n", at - blocks.base)
        while k < 0 and blocks.fill():
            k = blocks.data.find(b"\n", at - blocks.base)
        if k < 0:
            break
        line, begin = blocks.data[at - blocks.base : k].decode(), voffset(at)
        at = blocks.base + k + 1
        if at >= blocks.base + len(blocks.data):
            blocks.fill()
        stop = voffset(at) if at < blocks.base + len(blocks.data) else blocks.at << 16
        if line.startswith("#"):
            continue
        f = line.split("\t")
        if not names or names[-1] != f[columns[0]]:
            names.append(f[columns[0]])
            bins.append({})
            linear.append([])
        s = int(f[columns[1]]) - 1
        e = s + len(f[3]) if vcf else int(f[columns[2]])
        for x in f[7].split(";") if vcf else ():
            if x.startswith("END="):
                e = int(x[4:])
        e = max(e, s + 1)
        b = next((base + (s >> sh) for sh, base in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)) if s >> sh == e - 1 >> sh), 0)
        own = bins[-1].setdefault(b, [])
        if own and own[-1][1] == begin:
            own[-1][1] = stop
        else:
            own.append([begin, stop])
        for w in range(s >> 14, (e - 1 >> 14) + 1):
            while len(linear[-1]) <= w:
                linear[-1].append(begin)
    text = b"".join(n.encode() + b"\0" for n in names)
    out = b"TBI\1" + struct.pack("<8i", len(names), 2 if vcf else 0, columns[0] + 1, columns[1] + 1, 0 if vcf else columns[2] + 1, ord("#"), 0, len(text)) + text
    for b, w in zip(bins, linear, strict=True):
        out += struct.pack("<i", len(b)) + b"".join(struct.pack("<Ii", k, len(c)) + b"".join(struct.pack("<QQ", *x) for x in c) for k, c in b.items())
        out += struct.pack("<i", len(w)) + struct.pack(f"<{len(w)}Q", *w)
    fs, p = filesystem(f"{path}.tbi")
    with fs.open_output_stream(p, compression=None) as f:
        f.write(compress(out, "bgzf") + BGZF_END)
    return f"{path}.tbi"


def build_bai(path: str, spark=None) -> str:
    """Index a BAM file that is sorted by coordinate; written beside it. With a session tasks read ranges of the file, and what
    they found is joined in its order.
    """
    from helixframe.sinks.lines import filesystem

    from .alignments import header, indexed, join

    _, refs, _ = header(bgzf.Blocks(path))
    size = bgzf.size_of(path)
    if spark is None:
        parts = [indexed(path, 0, size)]
    else:
        from helixframe.session import ship

        ship(spark)
        sc = spark.sparkContext
        step = min(max(size // (4 * sc.defaultParallelism), 1 << 18), 32 << 20)
        ranges = [(a, min(a + step, size)) for a in range(0, size, step)]
        parts = sc.parallelize(ranges, len(ranges)).map(lambda r: indexed(path, *r)).collect()
    out = b"BAI\1" + struct.pack("<i", len(refs))
    for k in range(len(refs)):
        bins: dict[int, list[list[int]]] = {}
        windows: list[int] = []
        for found, further in parts:
            for b, chunks in found[k].items():
                for c in chunks:
                    join(bins.setdefault(b, []), c)
            for w, begin in further[k]:
                windows += [begin] * (w + 1 - len(windows))
        out += struct.pack("<i", len(bins)) + b"".join(struct.pack("<Ii", b, len(c)) + b"".join(struct.pack("<QQ", *x) for x in c) for b, c in bins.items())
        out += struct.pack("<i", len(windows)) + struct.pack(f"<{len(windows)}Q", *windows)
    fs, p = filesystem(f"{path}.bai")
    with fs.open_output_stream(p, compression=None) as f:
        f.write(out)
    return f"{path}.bai"
