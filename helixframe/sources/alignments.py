"""BAM: decoding over BGZF block ranges, encoding for the sink."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, InputPartition

from helixframe.functions.alignment import OPERATIONS
from helixframe.plans.regions import extract_regions

from . import bgzf, indexes
from .binary import Reader, dealt, option, pruned

#: Fixed value: the 4-bit base codes in order.
BASES = "=ACMGRSVTWYHKDBN"
CORE = [("name", "string"), ("chrom", "string"), ("start", "bigint"), ("end", "bigint"), ("flags", "bigint"), ("cigar", "string"), ("mapping_quality", "bigint"), ("mate_chrom", "string"), ("mate_start", "bigint"), ("sequence", "string"), ("quality_scores", "string"), ("template_length", "int")]
_PAIRS = np.frombuffer("".join(BASES[b >> 4] + BASES[b & 15] for b in range(256)).encode(), np.uint8).reshape(256, 2)
_CONSUMES = np.array([k < len(OPERATIONS) and OPERATIONS[k] in "MDN=X" for k in range(16)])
_HEAD = np.dtype([("size", "<i4"), ("ref", "<i4"), ("pos", "<i4"), ("l_name", "u1"), ("mapq", "u1"), ("bin", "<u2"), ("n_cigar", "<u2"), ("flag", "<u2"), ("l_seq", "<i4"), ("mate", "<i4"), ("mate_pos", "<i4"), ("tlen", "<i4")])
#: Decompressed bytes held at a time, and records decoded together.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 8192
_SCALAR = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I", "f": "<f"}
_SPARK = {"A": "string", "Z": "string", "H": "string", "f": "float", "c": "int", "C": "int", "s": "int", "S": "int", "i": "int", "I": "bigint"}
_ARROW = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "float": pa.float32()}


def header(blocks: bgzf.Blocks) -> tuple[str, list[tuple[str, int]], int]:
    """(SAM header text, references, stream position of the first record)."""
    blocks.need(0, 12)
    if blocks.get(0, 4) != b"BAM\x01":
        raise ValueError("not a BAM file")
    (n,) = struct.unpack("<i", blocks.get(4, 4))
    blocks.need(8, n + 4)
    text = blocks.get(8, n).rstrip(b"\0").decode()
    (count,) = struct.unpack("<i", blocks.get(8 + n, 4))
    at, refs = 12 + n, []
    for _ in range(count):
        blocks.need(at, 4)
        (k,) = struct.unpack("<i", blocks.get(at, 4))
        blocks.need(at + 4, k + 4)
        refs.append((blocks.get(at + 4, k - 1).decode(), struct.unpack("<i", blocks.get(at + 4 + k, 4))[0]))
        at += 8 + k
    return text, refs, at


def tags_of(data: bytes) -> Iterator[tuple[str, str, object]]:
    """(tag, type letter, value) of a record's tag bytes."""
    at = 0
    while at + 3 <= len(data):
        tag, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        if kind in "ZH":
            end = data.index(0, at)
            yield tag, kind, data[at:end].decode()
            at = end + 1
        elif kind == "A":
            yield tag, kind, chr(data[at])
            at += 1
        elif kind == "B":
            sub = chr(data[at])
            (n,) = struct.unpack_from("<i", data, at + 1)
            code = _SCALAR[sub]
            size = struct.calcsize(code)
            yield tag, f"B:{sub}", np.frombuffer(data, code, n, at + 5).tolist()
            at += 5 + n * size
        else:
            yield tag, kind, struct.unpack_from(_SCALAR[kind], data, at)[0]
            at += struct.calcsize(_SCALAR[kind])


def tag_type(kind: str) -> str:
    return f"array<{_SPARK[kind[2:]]}>" if kind.startswith("B:") else _SPARK[kind]


def plausible(blocks: bgzf.Blocks, at: int, refs: int, depth: int = 4) -> bool:
    """Whether records begin at a stream position: a chain of well-formed ones, or the end of the file."""
    for k in range(depth):
        if not blocks.need(at, 36):
            return k > 0 and at == blocks.base + len(blocks.data)
        size, ref, pos, l_name, _, _, n_cigar, _, l_seq, mate, mate_pos, _ = struct.unpack("<iiiBBHHHiiii", blocks.get(at, 36))
        least = 32 + l_name + 4 * n_cigar + (l_seq + 1) // 2 + l_seq
        if not (-1 <= ref < refs and -1 <= mate < refs and pos >= -1 and mate_pos >= -1 and l_name >= 2 and l_seq >= 0 and least <= size < 1 << 28):
            return False
        if not blocks.need(at + 36, l_name):
            return False
        name = blocks.get(at + 36, l_name)
        if name[-1] != 0 or not all(33 <= c <= 126 for c in name[:-1]):
            return False
        at += 4 + size
    return True


def spans(base: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the bytes of all spans one after another, where each begins in them and the last ends)."""
    ends = np.concatenate(([0], np.cumsum(lengths)))
    return base[np.repeat(starts - ends[:-1], lengths) + np.arange(ends[-1])], ends


def strings(data: np.ndarray, ends: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    """ASCII spans as a string array."""
    out = pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data, np.uint8)))
    return (pc.if_else(pa.array(~null), out, None) if null is not None else out).cast(pa.string())


def _texts(words: np.ndarray, ends: np.ndarray) -> pa.Array:
    """CIGAR texts of words; the distinct words are written once."""
    known, at = np.unique(words, return_inverse=True)
    each = pa.array([f"{w >> 4}{OPERATIONS[w & 15]}" for w in known.tolist()], pa.string()).take(pa.array(at.reshape(-1)))
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), each), "")


_WIDTH = np.zeros(256, np.int64)
for _k, _v in {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}.items():
    _WIDTH[ord(_k)] = _v


def tag_columns(data: np.ndarray, at: np.ndarray, stop: np.ndarray, wanted: dict[str, str]) -> dict[str, pa.Array]:
    """The wanted tags of all records, which step through their tags together."""
    n, at = len(at), at.copy()
    zeros = np.flatnonzero(data == 0)
    found: dict[str, list] = {t: [] for t in wanted}
    rows = np.flatnonzero(at + 3 <= stop)
    while len(rows):
        p = at[rows]
        kind = data[p + 2]
        size = 3 + _WIDTH[kind]
        text = (kind == ord("Z")) | (kind == ord("H"))
        if text.any():
            size[text] = zeros[np.searchsorted(zeros, p[text] + 3)] + 1 - p[text]
        many = kind == ord("B")
        if many.any():
            count = data[p[many][:, None] + np.arange(4, 8)].astype(np.uint32) @ np.array([1, 1 << 8, 1 << 16, 1 << 24], np.uint32)
            size[many] = 8 + count.astype(np.int64) * _WIDTH[data[p[many] + 3]]
        if (size <= 3).any():
            raise ValueError("unknown type of a BAM tag")
        for t in wanted:
            hit = (data[p] == ord(t[0])) & (data[p + 1] == ord(t[1]))
            if hit.any():
                found[t].append((rows[hit], p[hit], size[hit], kind[hit]))
        at[rows] += size
        rows = rows[at[rows] + 3 <= stop[rows]]
    out = {}
    for t, letter in wanted.items():
        type_ = tag_type(letter)
        if type_.startswith("array"):
            values: list = [None] * n
            for r, p, z, _ in found[t]:
                for i, a, k in zip(r.tolist(), p.tolist(), z.tolist(), strict=True):
                    values[i] = np.frombuffer(data[a + 8 : a + k].tobytes(), _SCALAR[chr(data[a + 3])]).tolist()
            out[t] = pa.array(values, pa.list_(_ARROW[type_[6:-1]]))
        elif type_ == "string":
            where, size = np.zeros(n, np.int64), np.full(n, -1, np.int64)
            for r, p, z, k in found[t]:
                where[r], size[r] = p + 3, z - 3 - (k != ord("A"))
            out[t] = strings(*spans(data, where, np.maximum(size, 0)), null=size < 0)
        else:
            values, null = np.zeros(n, np.float64 if type_ == "float" else np.int64), np.ones(n, bool)
            for r, p, _, k in found[t]:
                for x in np.unique(k).tolist():
                    i = k == x
                    code = np.dtype(_SCALAR[chr(x)])
                    values[r[i]] = data[p[i][:, None] + np.arange(3, 3 + code.itemsize)].copy().view(code).reshape(-1)
                null[r] = False
            out[t] = pa.array(values, mask=null).cast(_ARROW[type_])
    return out


def decode(raw: bytes, offsets: np.ndarray, refs: list[tuple[str, int]], names: list[str], wanted: dict[str, str], zero_based: bool) -> dict[str, pa.Array]:
    """The columns asked for of the records at these offsets, all at a time; what is not asked for is not decoded."""
    first, last = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(raw, np.uint8)[first : last + 4 + int.from_bytes(raw[last : last + 4], "little")]  # what other batches hold is not looked at
    offsets = offsets - first
    head = data[offsets[:, None] + np.arange(36)].copy().view(_HEAD).reshape(-1)
    ask = set(names)
    at = offsets + 36
    l_name, n_cigar, l_seq = head["l_name"].astype(np.int64), head["n_cigar"].astype(np.int64), head["l_seq"].astype(np.int64)
    cigar_at = at + l_name
    seq_at = cigar_at + 4 * n_cigar
    qual_at = seq_at + (l_seq + 1) // 2
    pos, shift = head["pos"].astype(np.int64), 0 if zero_based else 1
    out: dict[str, pa.Array] = {"flags": pa.array(head["flag"].astype(np.int64)), "mapping_quality": pa.array(head["mapq"].astype(np.int64)), "template_length": pa.array(head["tlen"].astype(np.int32))}
    out["start"] = pa.array(pos + shift, mask=pos < 0)
    out["mate_start"] = pa.array(head["mate_pos"].astype(np.int64) + shift, mask=head["mate_pos"] < 0)
    chroms = pa.array([r[0] for r in refs], pa.string())
    for column, ref in (("chrom", head["ref"]), ("mate_chrom", head["mate"])):
        if column in ask:
            out[column] = chroms.take(pa.array(ref, mask=ref < 0))
    if "name" in ask:
        out["name"] = strings(*spans(data, at, l_name - 1))
    if ask & {"cigar", "end"}:
        words, ends = spans(data, cigar_at, 4 * n_cigar)
        words, ends = words.view("<u4").astype(np.int64), ends // 4
        if "cigar" in ask:
            out["cigar"] = _texts(words, ends)
        sums = np.concatenate(([0], np.cumsum(np.where(_CONSUMES[words & 15], words >> 4, 0))))
        out["end"] = pa.array(pos + np.maximum(sums[ends[1:]] - sums[ends[:-1]], 1), mask=pos < 0)
    if "sequence" in ask:
        pairs, ends = spans(data, seq_at, (l_seq + 1) // 2)
        letters = _PAIRS[pairs].reshape(-1)
        odd = l_seq % 2 == 1
        letters = np.delete(letters, 2 * ends[1:][odd] - 1) if odd.any() else letters
        out["sequence"] = strings(letters, np.concatenate(([0], np.cumsum(l_seq))))
    if "quality_scores" in ask:
        has = l_seq > 0
        has[has] = data[qual_at[has]] != 255
        scores, ends = spans(data, qual_at, np.where(has, l_seq, 0))
        out["quality_scores"] = strings(np.minimum(scores, 93) + 33, ends)
    if wanted and ask & set(wanted):
        size = head["size"].astype(np.int64)
        out |= tag_columns(data, qual_at + l_seq, offsets + 4 + size, {t: k for t, k in wanted.items() if t in ask})
    return out


def opened(path: str, start: int, end: int) -> tuple[bgzf.Blocks, int, int] | None:
    """(blocks, stream position of the first record, virtual offset of the end) of a byte range; None: no record begins in it."""
    size = bgzf.size_of(path)
    top = bgzf.Blocks(path)
    _, refs, first = header(top)
    with bgzf.open_raw(path) as f:
        begin = bgzf.find_block(f, start, size)
        stop = bgzf.find_block(f, end, size) if end < size else size
    if begin >= stop:
        return None
    if start == 0:
        return top, first, stop << 16
    blocks, at = bgzf.Blocks(path, begin), 0
    while blocks.need(at, 36) and blocks.block_of(at) < stop and not plausible(blocks, at, len(refs)):
        at += 1
        if at > 1 << 28:  # no record is as long
            raise ValueError(f"no record begins behind byte {begin} of the BAM file")
    if not blocks.need(at, 36) or blocks.block_of(at) >= stop:
        return None  # one record covers the whole range
    return blocks, at, stop << 16


def records(blocks: bgzf.Blocks, at: int, stop: int) -> Iterator[np.ndarray]:
    """Where in ``blocks.data`` records begin, from stream position ``at`` on and before virtual offset ``stop``; valid until the next step."""
    limit = None  # stream position of the stop, once it is reached
    while True:
        blocks.fill_up(at - blocks.base + BATCH_BYTES, stop >> 16)
        if limit is None and blocks.at > stop >> 16 or not blocks.need(at, 4):
            # the last mark is the block of the stop, or the file ends before it
            limit = next((p + (stop & 0xFFFF) for p, b in reversed(blocks.marks) if b == stop >> 16), blocks.base + len(blocks.data))
        held = blocks.base + len(blocks.data)
        offsets, k, data = [], at - blocks.base, blocks.data
        behind = (held if limit is None else min(limit, held)) - blocks.base
        while k + 4 <= len(data) and k < behind:
            n = int.from_bytes(data[k : k + 4], "little")
            if k + 4 + n > len(data):
                break
            offsets.append(k)
            k += 4 + n
        if offsets:
            at = blocks.base + k
            yield np.array(offsets, np.int64)
            blocks.drop(at)
        if limit is not None and at >= limit:
            return
        if not offsets:
            if not blocks.need(at, 4):
                return
            (n,) = struct.unpack("<i", blocks.get(at, 4))
            if not blocks.need(at + 4, n):
                raise ValueError("BAM record cut off")


def indexed(path: str, start: int, end: int) -> tuple[list[dict[int, list[list[int]]]], list[list[tuple[int, int]]]]:
    """What the records that begin in a byte range add to an index, by reference: chunks by bin, and (window, virtual offset) of
    each record that reaches a further 16 kb window than all before it."""
    _, refs, _ = header(bgzf.Blocks(path))
    bins: list[dict[int, list[list[int]]]] = [{} for _ in refs]
    linear: list[list[tuple[int, int]]] = [[] for _ in refs]
    found = opened(path, start, end)
    if not found:
        return bins, linear
    blocks, at, stop = found
    for offsets in records(blocks, at, stop):
        data = np.frombuffer(blocks.data, np.uint8)
        head = data[offsets[:, None] + np.arange(36)].copy().view(_HEAD).reshape(-1)
        p = blocks.base + np.append(offsets, offsets[-1] + 4 + int(head["size"][-1]))
        places, names = (np.array(x, np.int64) for x in zip(*blocks.marks, strict=True))
        at = np.searchsorted(places, p, "right") - 1
        voffset = np.where(p >= blocks.base + len(data), blocks.at << 16, names[at] << 16 | p - places[at])
        ref, pos = head["ref"].astype(np.int64), head["pos"].astype(np.int64)
        key = np.where((ref < 0) | (pos < 0), -1, ref << 16 | head["bin"])
        first = np.flatnonzero(np.diff(key, prepend=-2))
        for k, a, b in zip(key[first].tolist(), voffset[first].tolist(), voffset[np.append(first[1:], len(key))].tolist(), strict=True):
            if k >= 0:
                join(bins[k >> 16].setdefault(k & 0xFFFF, []), [a, b])
        words, ends = spans(data, offsets + 36 + head["l_name"], 4 * head["n_cigar"].astype(np.int64))
        words, ends = words.view("<u4").astype(np.int64), ends // 4
        sums = np.concatenate(([0], np.cumsum(np.where(_CONSUMES[words & 15], words >> 4, 0))))
        last = pos + np.maximum(sums[ends[1:]] - sums[ends[:-1]], 1) - 1 >> 14
        for r in np.unique(ref[key >= 0]).tolist():
            mine = np.flatnonzero((ref == r) & (key >= 0))
            before = np.concatenate(([linear[r][-1][0] if linear[r] else -1], last[mine]))
            further = mine[last[mine] > np.maximum.accumulate(before)[:-1]]
            linear[r] += zip(last[further].tolist(), voffset[further].tolist(), strict=True)
    return bins, linear


def join(chunks: list[list[int]], more: list[int]) -> None:
    """Append a chunk, or lengthen the last one that it follows at once."""
    if chunks and chunks[-1][1] == more[0]:
        chunks[-1][1] = more[1]
    else:
        chunks.append(list(more))


@dataclass
class Chunks(InputPartition):
    """Ranges of virtual offsets."""

    ranges: list


class BamReader(Reader):
    """Byte ranges, or the chunks that an index beside the file names for the regions of pushed filters.

    A range owns the records that begin in it. A chunk's records are read whole and unique by their offsets; Spark evaluates
    the filters again.
    """

    filters: tuple = ()

    def pushFilters(self, filters):
        self.filters = tuple(filters)
        return iter(filters)

    def partitions(self):
        n, step = bgzf.size_of(self.path), int(option(self.options, "splitBytes", str(64 << 20)))
        regions = extract_regions(list(self.filters), self.zero_based())
        beside = indexes.find(self.path, option(self.options, "index") or None) if regions is not None else None
        if beside is None:
            return dealt(n, step)
        _, refs, _ = header(bgzf.Blocks(self.path))
        index = indexes.load(beside, [r[0] for r in refs])
        found: list[list[int]] = []
        for r in regions:
            if r.chrom in index.names:
                found += [list(c) for c in index.chunks(index.names.index(r.chrom), r.start - 1, r.end or index.reach)]
        out: list[list] = [[]]
        for a, b in sorted(found):
            if out[-1] and a <= out[-1][-1][1]:
                out[-1][-1][1] = max(b, out[-1][-1][1])
                continue
            if out[-1] and sum((y >> 16) - (x >> 16) for x, y in out[-1]) >= step:
                out.append([])
            out[-1].append([a, b])
        return [Chunks(x) for x in out]

    def read(self, part):
        _, refs, _ = header(bgzf.Blocks(self.path))
        if isinstance(part, Chunks):
            for a, b in part.ranges:
                blocks = bgzf.Blocks(self.path, a >> 16)
                if blocks.fill():
                    yield from self._records(blocks, a & 0xFFFF, b, refs)
            return
        for r in part.ranges:
            found = opened(self.path, r.start, r.end)
            if found:
                yield from self._records(*found, refs)

    def _records(self, blocks: bgzf.Blocks, at: int, stop: int, refs):
        for offsets in records(blocks, at, stop):
            for a in range(0, len(offsets), BATCH_ROWS):
                yield self._batch(blocks.data, offsets[a : a + BATCH_ROWS], refs)

    def zero_based(self) -> bool:
        return option(self.options, "zeroBased", "true") == "true"

    def wanted(self) -> dict[str, str]:
        return dict(x.split("=") for x in option(self.options, "tags").split(",") if x)

    def _batch(self, data: bytes, offsets: np.ndarray, refs) -> pa.RecordBatch:
        return self.batch(decode(data, offsets, refs, self.names, self.wanted(), self.zero_based()))


class BamSource(DataSource):
    """``tags``: comma-separated TAG=type letter, e.g. ``NM=i,RG=Z,ZB=B:S``."""

    @classmethod
    def name(cls):
        return "bam"

    def schema(self):
        wanted = dict(x.split("=") for x in option(self.options, "tags").split(",") if x)
        return pruned(CORE + [(t, tag_type(k)) for t, k in wanted.items()], self.options)

    def reader(self, schema):
        return BamReader(self.options, schema)


def infer_tags(path: str, rows: int = 100) -> dict[str, str]:
    """Tags of the first records with their type letters, sorted; integer widths are levelled to i."""
    blocks = bgzf.Blocks(path)
    _, _, at = header(blocks)
    found: dict[str, str] = {}
    for _ in range(rows):
        if not blocks.need(at, 4):
            break
        (n,) = struct.unpack("<i", blocks.get(at, 4))
        blocks.need(at + 4, n)
        r = blocks.get(at + 4, n)
        l_name, n_cigar, l_seq = r[8], struct.unpack_from("<H", r, 12)[0], struct.unpack_from("<i", r, 16)[0]
        for t, k, _ in tags_of(r[32 + l_name + 4 * n_cigar + (l_seq + 1) // 2 + l_seq :]):
            found.setdefault(t, "i" if k in "cCsS" else k)
        at += 4 + n
    return dict(sorted(found.items()))


_CODES = np.full(256, 15, np.uint8)
for _k, _b in enumerate(BASES):
    _CODES[[ord(_b), ord(_b.lower())]] = _k
_REF_OPS = np.array([o in "MDN=X" for o in OPERATIONS])
_OP = re.compile(r"(\d+)([MIDNSHP=X])")


def _ascii(column: pa.Array, code) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, lengths) of texts, one byte a character; null, '*' and '' are empty, ``code`` gives the byte of what is not ASCII."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    column = pc.if_else(pc.equal(column, "*"), "", column)
    if pc.sum(pc.binary_length(column)).as_py() != pc.sum(pc.utf8_length(column)).as_py():
        each = [bytes(ord(c) if c.isascii() else code(c) for c in x) for x in column.to_pylist()]
        column = pa.array(each, pa.large_binary())
    return _bytes(column)


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, lengths) of large strings without nulls."""
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8))[offsets[0] : offsets[-1]], np.diff(offsets)


def _whole(column: pa.Array, null: int, dtype: str, what: str, shift: int = 0) -> np.ndarray:
    """Integers in the width of the file; what does not fit is an error."""
    v = pc.fill_null(column.cast(pa.int64(), safe=False), null + shift).to_numpy(zero_copy_only=False) - shift
    if len(v) and (v.min() < np.iinfo(dtype).min or v.max() > np.iinfo(dtype).max):
        raise ValueError(f"{what} out of range")
    return v.astype(dtype)


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(CIGAR words one after another, their number by record, reference bases by record); distinct texts are parsed once."""
    known = pc.fill_null(column.cast(pa.string()), "").dictionary_encode()
    texts, spans_, sizes = [], [], []
    for c in known.dictionary.to_pylist():
        ops = [(int(n), OPERATIONS.index(o)) for n, o in _OP.findall(c)]
        if any(n >> 28 for n, _ in ops):
            raise ValueError("CIGAR length out of range")
        texts += [n << 4 | o for n, o in ops]
        sizes.append(len(ops))
        spans_.append(sum(n for n, o in ops if _REF_OPS[o]) or 1)
    index, sizes = known.indices.to_numpy(zero_copy_only=False), np.array(sizes, np.int64)
    begins = np.cumsum(sizes) - sizes
    words, _ = spans(np.array(texts, "<u4"), begins[index], sizes[index])
    return words, sizes[index], np.array(spans_, np.int64)[index]


def _tag_pieces(tag: str, kind: str, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, lengths by record) of one tag; a record without it has none."""
    head = tag.encode()
    if kind.startswith("B:"):
        code = np.dtype(_SCALAR[kind[2:]])
        each = [b"" if v is None else head + b"B" + kind[2:].encode() + struct.pack("<i", len(v)) + b"".join(struct.pack(_SCALAR[kind[2:]], x) for x in v) for v in column.to_pylist()]
        return _bytes(pa.array(each, pa.large_binary()))
    if pa.types.is_floating(column.type):
        column = pc.if_else(pc.is_nan(column), None, column)
    valid = pc.is_valid(column).to_numpy(zero_copy_only=False)
    if kind in "ZHA":
        if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
            column = pa.array([None if v is None else str(v) for v in column.to_pylist()], pa.string())
        text = pc.fill_null(column.cast(pa.large_string()), "")
        data, size = _bytes(pc.utf8_slice_codeunits(text, 0, 1) if kind == "A" else text)
        tail = np.where(valid, kind != "A", False).astype(np.int64)
        begin = np.tile(np.frombuffer(head + kind.encode(), np.uint8), int(valid.sum()))
        return _laid([(begin, 3 * valid), (data, size), (np.zeros(int(tail.sum()), np.uint8), tail)])
    code = np.dtype(_SCALAR[kind])
    value = column.filter(pa.array(valid))
    value = value.cast(pa.float64()).to_numpy(zero_copy_only=False).astype(code) if kind == "f" else _whole(value, 0, code.str, f"tag {tag}")
    out = np.empty((len(value), 3 + code.itemsize), np.uint8)
    out[:, :3] = np.frombuffer(head + kind.encode(), np.uint8)
    out[:, 3:] = value.view(np.uint8).reshape(len(value), code.itemsize)
    return out.reshape(-1), (3 + code.itemsize) * valid


def _laid(pieces: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, lengths by record) of records whose pieces, each (bytes, lengths by record), follow one another."""
    total = sum(n for _, n in pieces)
    at = np.cumsum(total) - total
    out = np.empty(int(total.sum()), np.uint8)
    for data, n in pieces:
        out[np.repeat(at - (np.cumsum(n) - n), n) + np.arange(len(data))] = data
        at = at + n
    return out, total


def encode(columns: dict[str, pa.Array], names: list[str], tags: dict[str, str], zero_based: bool) -> bytes:
    """The BAM records of a batch, all at a time."""
    n, shift = len(columns["flags"]), 0 if zero_based else 1
    if columns["flags"].null_count:
        raise ValueError("flags are null")
    if n and pc.max(columns["flags"]).as_py() > 65535:
        raise ValueError("flags over 65535")
    text = pc.fill_null(columns["name"].cast(pa.large_string()), "")
    name, l_name = _bytes(pc.if_else(pc.equal(text, ""), "*", text))
    words, n_cigar, span = _words(columns["cigar"])
    seq, l_seq = _ascii(columns["sequence"], lambda c: ord(c.upper()) if c.upper() in BASES else ord("N"))
    qual, l_qual = _ascii(columns["quality_scores"], ord)  # beyond one byte is an error
    ends = np.cumsum(l_seq)
    half = (l_seq + 1) // 2
    nibbles = np.zeros(2 * int(half.sum()), np.uint8)
    nibbles[np.repeat(2 * (np.cumsum(half) - half) - (ends - l_seq), l_seq) + np.arange(len(seq))] = _CODES[seq]
    scores = np.full(len(seq), 255, np.uint8)
    same = l_qual == l_seq
    mine, theirs = np.repeat(same, l_seq), np.repeat(same, l_qual)
    scores[mine] = np.maximum(qual[theirs].astype(np.int16) - 33, 0)
    refs = pa.array(names, pa.string())
    chrom, mate = columns["chrom"].cast(pa.string()), columns["mate_chrom"].cast(pa.string())
    ref = lambda x: pc.fill_null(pc.index_in(x, value_set=refs), -1).to_numpy(zero_copy_only=False)
    head = np.zeros(n, _HEAD)
    head["ref"], head["mate"] = ref(chrom), ref(pc.if_else(pc.equal(pc.fill_null(mate, ""), "="), chrom, mate))
    head["pos"], head["mate_pos"] = (_whole(columns[c], -1, "<i4", c, shift) for c in ("start", "mate_start"))
    for field, v in (("l_name", l_name + 1), ("n_cigar", n_cigar)):
        if n and v.max() > np.iinfo(_HEAD[field]).max:
            raise ValueError(f"{field} out of range")
        head[field] = v
    head["mapq"] = _whole(columns["mapping_quality"], 255, "u1", "mapping_quality")
    head["flag"] = _whole(columns["flags"], 0, "<u2", "flags")
    head["l_seq"], head["tlen"] = l_seq, _whole(columns["template_length"], 0, "<i4", "template_length")
    p = head["pos"].astype(np.int64)
    bin_ = np.where(p >= 0, 0, 4680)
    for s, base in ((26, 1), (23, 9), (20, 73), (17, 585), (14, 4681)):  # the smallest that holds both ends stays
        bin_ = np.where((p >= 0) & (p >> s == (p + span - 1) >> s), base + (p >> s), bin_)
    if n and bin_.max() > 65535:
        raise ValueError("start out of range")
    head["bin"] = bin_
    pieces = [(name, l_name), (np.zeros(n, np.uint8), np.ones(n, np.int64)), (words.view(np.uint8), 4 * n_cigar), (nibbles[::2] << 4 | nibbles[1::2], half), (scores, l_seq)]
    pieces += [_tag_pieces(t, k, columns[t]) for t, k in tags.items()]
    head["size"] = 32 + sum(z for _, z in pieces)
    out, _ = _laid([(head.view(np.uint8), np.full(n, 36, np.int64)), *pieces])
    return out.tobytes()


def bam_records(df: DataFrame, references: dict[str, int], tags: dict[str, str] | None = None, zero_based: bool = True) -> DataFrame:
    """BAM records, encoded in batches: a row has those of one batch, one after another."""
    from helixframe.session import ship

    ship(df.sparkSession)  # before the function is made, which takes the shipped code with it
    names, tags = list(references), tags or {}
    columns = [n for n, _ in CORE if n != "end"]

    def run(batches):
        held: list[pa.RecordBatch] = []

        def one():
            b = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([encode({c: b.column(c) for c in b.schema.names}, names, tags, zero_based)], pa.binary())], names=["value"])

        for b in batches:
            if b.num_rows:
                held.append(b)
            if sum(x.num_rows for x in held) >= BATCH_ROWS or sum(x.nbytes for x in held) >= BATCH_BYTES // 2:
                yield one()
        if held:
            yield one()

    return df.select(*columns, *tags).mapInArrow(run, "value binary")


def bam_header(references: dict[str, int], order: str = "unsorted") -> bytes:
    from helixframe.sinks.lines import sam_header

    text = sam_header(references, order).encode()
    return b"BAM\x01" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(references)) + b"".join(struct.pack("<i", len(n.encode()) + 1) + n.encode() + b"\0" + struct.pack("<i", k) for n, k in references.items())


def write_bam(df: DataFrame, path: str, references: dict[str, int], tags: dict[str, str] | None = None, zero_based: bool = True, sort: bool = False) -> None:
    from helixframe.sinks.lines import write_parts

    if sort:
        df = df.orderBy(F.col("chrom").asc_nulls_last(), F.col("start").asc_nulls_last())
    write_parts(bam_records(df, references, tags, zero_based), path, bam_header(references, "coordinate" if sort else "unsorted"), "bgzf", binary=True)
