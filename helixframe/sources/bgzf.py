"""Byte streams: plain, gzip of any number of members, and BGZF with block positions."""

from __future__ import annotations

import struct
import zlib

from helixframe.sinks.lines import filesystem

MAGIC = b"\x1f\x8b\x08\x04"


def open_raw(path: str):
    fs, p = filesystem(path)
    return fs.open_input_file(p)


def size_of(path: str) -> int:
    fs, p = filesystem(path)
    return fs.get_file_info(p).size


def compression(path: str) -> str:
    """plain, gzip or bgzf, by the first 18 bytes."""
    with open_raw(path) as f:
        head = f.read(18)
    if head[:2] != b"\x1f\x8b":
        return "plain"
    return "bgzf" if head[:4] == MAGIC and head[12:14] == b"BC" else "gzip"


def block_size(head: bytes) -> int:
    """Size of the BGZF block that begins with these bytes; 0: none begins here."""
    if len(head) < 18 or head[:4] != MAGIC or head[12:16] != b"BC\x02\x00":
        return 0
    return struct.unpack_from("<H", head, 16)[0] + 1


def find_block(f, at: int, end: int) -> int:
    """The first block at or behind ``at``: its header must fit and another block, or the end, must follow it."""
    if at == 0:
        return 0
    f.seek(at)
    data = f.read(min(end - at, 1 << 17))
    k = data.find(MAGIC)
    while k >= 0:
        n = block_size(data[k : k + 18])
        if n:
            f.seek(at + k + n)
            follow = f.read(18)
            if not follow or block_size(follow):
                return at + k
        k = data.find(MAGIC, k + 1)
    return end


class Blocks:
    """Decompressed bytes of a BGZF file from a block on; knows the block of each position."""

    def __init__(self, path: str, start: int = 0):
        self.f = open_raw(path)
        self.at = start  # of the next block
        self.data, self.base = b"", 0  # held bytes, and the stream position of the first
        self.marks: list[tuple[int, int]] = []  # (stream position, block)

    def _next(self) -> bytes | None:
        self.f.seek(self.at)
        head = self.f.read(18)
        n = block_size(head)
        if not n:
            return None
        body = head + self.f.read(n - 18)
        extra = struct.unpack_from("<H", body, 10)[0]
        self.at += n
        return zlib.decompress(body[12 + extra : -8], -15)

    def fill(self) -> bool:
        at, data = self.at, self._next()
        if data is None:
            return False
        self.marks.append((self.base + len(self.data), at))
        self.data += data
        return True

    def fill_up(self, size: int, last: int | None = None) -> None:
        """Hold ``size`` bytes, or what there is up to the block at ``last``; held bytes are copied once, not by block."""
        held, parts = len(self.data), [self.data]
        while held < size and (last is None or self.at <= last):
            at, data = self.at, self._next()
            if data is None:
                break
            self.marks.append((self.base + held, at))
            parts.append(data)
            held += len(data)
        if len(parts) > 1:
            self.data = b"".join(parts)

    def need(self, offset: int, n: int) -> bool:
        """Whether ``n`` bytes from stream position ``offset`` on are held; reads on as necessary."""
        self.fill_up(offset + n - self.base)
        return offset + n <= self.base + len(self.data)

    def get(self, offset: int, n: int) -> bytes:
        a = offset - self.base
        return self.data[a : a + n]

    def block_of(self, offset: int) -> int:
        for pos, block in reversed(self.marks):
            if pos <= offset:
                return block
        return -1

    def drop(self, offset: int) -> None:
        if offset - self.base > 1 << 20:
            self.data = self.data[offset - self.base :]
            self.base = offset
            keep = max((i for i, (p, _) in enumerate(self.marks) if p <= offset), default=0)
            self.marks = self.marks[keep:]


def gunzip(path: str):
    """Chunks of a gzip file, all members."""
    with open_raw(path) as f:
        z = zlib.decompressobj(31)
        while data := f.read(1 << 20):
            while data:
                out = z.decompress(data)
                if out:
                    yield out
                data = z.unused_data
                if z.eof:
                    z = zlib.decompressobj(31)
                    if not data:
                        break
                else:
                    data = b""


def read_all(path: str) -> bytes:
    """Small files as a whole, decompressed."""
    if compression(path) == "plain":
        with open_raw(path) as f:
            return f.read()
    return b"".join(gunzip(path))
