"""Words of UTF-8 bytes, hashed many texts at a time."""

from __future__ import annotations

import numpy as np

_BASE = 0xD6E8FEB86659FD93
_VALUES = np.random.default_rng(2).integers(1, 1 << 63, 256, dtype=np.uint64)
_VALUES[0] = 0
_KEPT: dict = {}


def byte_table(separators: bytes) -> np.ndarray:
    """A byte's stand-in, ASCII letters lower-cased; 0 for the separators, one of which stands for the byte 0."""
    out = np.arange(256, dtype=np.uint8)
    out[0x41:0x5B] += 32
    out[0] = separators[0]
    out[list(separators)] = 0
    return out


#: Words are runs of anything but space, tab, line feed, vertical tab, form feed and carriage return.
SPACED = byte_table(b"\x20\x09\x0a\x0b\x0c\x0d")


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _KEPT.get("n", 0) < n:
        size = max(n, 5 << 20)
        p, q = np.ones(size, np.uint64), np.ones(size, np.uint64)
        p[1:], q[1:] = _BASE, pow(_BASE, -1, 1 << 64)
        _KEPT.update(n=size, p=np.cumprod(p), q=np.cumprod(q))
    return _KEPT["p"], _KEPT["q"]


def words_of(data: bytes, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of the words."""
    low = table[np.frombuffer(data, np.uint8)]
    inside = np.zeros(len(low) + 2, np.int8)
    inside[1:-1] = low > 0
    edges = np.diff(inside)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    p, q = _powers(len(low) + 1)
    sums = np.zeros(len(low) + 1, np.uint64)
    np.cumsum(_VALUES[low] * p[: len(low)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * q[starts]
    return starts, ends, mix(h ^ ((ends - starts).astype(np.uint64) << np.uint64(57)))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingle_sets(texts: list[bytes], width: int, table: np.ndarray = SPACED) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's ``width``-word shingles; fewer words: of the whole sequence; none: empty."""
    out, batch, size = [], [], 0
    for t in texts:
        batch.append(t)
        size += len(t)
        if size >= 4 << 20:
            out += _sets(batch, width, table)
            batch, size = [], 0
    return out + (_sets(batch, width, table) if batch else [])


def _sets(texts: list[bytes], width: int, table: np.ndarray) -> list[np.ndarray]:
    starts, _, h = words_of(b"\n".join(texts), table)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    first = np.append(np.searchsorted(starts, begins), len(starts))
    n = len(h)
    rolled = np.zeros(max(n - width + 1, 0), np.uint64)
    for k in range(width):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(rolled)]
    rolled = mix(rolled)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            one = np.uint64(b - a)
            for x in h[a:b]:
                one = mix((np.array([one], np.uint64) * np.uint64(0x9E3779B97F4A7C15) + x))[0]
            out.append(np.array([one], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
