"""Token counts of a byte-level BPE by finite-state transducers.

Two transducers are compiled from the tokenizer's own file.

* The *splitter* reads characters as a few classes and marks where a pre-token starts. It has eight states, so a chunk of
  text is a map of eight states; all chunks' maps are computed side by side and composed by a parallel prefix scan, after
  which every chunk knows its entry state and is read once more for its marks.
* The *counter* reads the bytes of a pre-token; each transition is annotated with the change of the number of tokens. Its
  states are compiled when first needed and kept for the life of the worker. It rests on two facts of merge-ranked
  BPE: a token sequence is the encoding of its bytes exactly if each neighbouring pair is stable (no merge reaches across
  before both are complete), and so each prefix has exactly one possible last token. A state holds the last tokens, and
  token counts relative to the newest, of the positions at which a longer token may still start.

Distinct pre-tokens of a batch go through the counter once. Texts of any length are read in pieces cut at pre-token starts.

Defined cases: null and empty texts have 0 bytes and 0 tokens; the added token's string inside a text is one token, as
the library does by default; rows are independent, so repeated rows and ids and other columns do not matter.
"""

from __future__ import annotations

import hashlib
import json
import sys
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.session import ship

from .common import table

LIMIT = 1024
#: Characters of a piece and of a chunk of the scan.
PIECE, CHUNK = 1 << 20, 128
#: Compiled states before a worker starts compiling afresh, to bound its memory.
MOST_STATES = 180_000

#: Where fewer tokens can still come of the open bytes, a state lists those that may; this merges equal states.
FEW = 40

NONE, LETTER, NUMBER, OTHER, SPACED, BLANKS, TWO_LEFT, ONE_LEFT = range(8)
# symbols: letter, number, other, apostrophe of a 2- or 3-character contraction, a space or another white space before
# something else, white space before white space or the end; the same again where a text begins
S_LETTER, S_NUMBER, S_OTHER, S_SHORT, S_LONG, S_SPACE, S_BREAK, S_WHITE = range(8)
RESET = 8


def _splitter() -> tuple[np.ndarray, np.ndarray]:
    """(next state, starts a pre-token) by symbol and state."""
    nxt, mark = np.zeros((16, 8), np.uint8), np.zeros((16, 8), bool)
    for symbol in range(16):
        for state in range(8):
            q, s = (NONE, symbol - RESET) if symbol >= RESET else (state, symbol)
            if s in (S_LETTER, S_NUMBER):
                own = LETTER if s == S_LETTER else NUMBER
                if s == S_LETTER and q in (TWO_LEFT, ONE_LEFT):
                    to, new = (ONE_LEFT if q == TWO_LEFT else NONE), False
                else:
                    to, new = own, q not in (own, SPACED)
            elif s in (S_OTHER, S_SHORT, S_LONG):
                new = q not in (OTHER, SPACED)
                to = {S_SHORT: ONE_LEFT, S_LONG: TWO_LEFT}.get(s, OTHER) if new else OTHER
            elif s == S_WHITE:
                to, new = BLANKS, q != BLANKS
            else:
                to, new = (SPACED if s == S_SPACE else NONE), True
            nxt[symbol, state], mark[symbol, state] = to, new
    return nxt, mark


@cache
def _classes() -> np.ndarray:
    """0 letter, 1 number, 2 other, 3 white space, by code point."""
    import regex

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.full(0x110000, 2, np.uint8)
    for value, pattern in ((0, r"\p{L}+"), (1, r"\p{N}+"), (3, r"\s+")):
        for m in regex.finditer(pattern, every):
            a, b = m.span()
            a, b = a + 2048 * (a >= 0xD800), b + 2048 * (b > 0xD800)
            out[a:b] = value
    return out


def scan_states(symbols: np.ndarray) -> np.ndarray:
    """Where pre-tokens start, by chunk state maps and their prefix composition."""
    nxt, mark = _TABLES
    n = len(symbols)
    rows = -(-n // CHUNK)
    padded = np.full(rows * CHUNK, S_OTHER, np.uint8)
    padded[:n] = symbols
    columns = np.ascontiguousarray(padded.reshape(rows, CHUNK).T)
    flat = nxt.reshape(-1)
    maps = np.tile(np.arange(8, dtype=np.uint8), (rows, 1))
    for c in columns:
        maps = flat[(c[:, None].astype(np.intp) << 3) + maps]
    step = 1
    while step < rows:  # maps[i] becomes the composition of all chunks up to i
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step].astype(np.intp), 1)
        step *= 2
    state = np.zeros(rows, np.uint8)
    state[1:] = maps[:-1, 0]
    out = np.empty((CHUNK, rows), bool)
    marks = mark.reshape(-1)
    for k, c in enumerate(columns):
        at = (c.astype(np.intp) << 3) + state
        out[k], state = marks[at], flat[at]
    return out.T.reshape(-1)[:n]


_TABLES = _splitter()
_S, _T, _R, _V, _M, _L, _D, _E = (ord(c) for c in "strvmlde")


def symbols_of(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The splitter's symbols of code points; ``first`` marks where a text begins."""
    kind = _classes()[points]
    n = len(points)
    ahead = np.full(n, 9, np.uint8)  # the class of the next character of the same text
    ahead[:-1] = np.where(first[1:], 9, kind[1:])
    out = kind.copy()
    white = kind == 3
    before = white & (ahead < 3)
    out[white] = S_WHITE
    out[before] = S_BREAK
    out[before & (points == 32)] = S_SPACE
    at = np.flatnonzero((points == 39) & (ahead == 0))
    if len(at):
        a = points[at + 1]
        more = at + 2 < n
        b = np.where(more & ~first[np.minimum(at + 2, n - 1)], points[np.minimum(at + 2, n - 1)], 0)
        out[at[(a == _S) | (a == _T) | (a == _M) | (a == _D)]] = S_SHORT
        out[at[((a == _R) & (b == _E)) | ((a == _V) & (b == _E)) | ((a == _L) & (b == _L))]] = S_LONG
    return out + first * np.uint8(RESET)


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies write bytes with."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Counter:
    """The token-count transducer of one byte-level BPE file."""

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        letters = _byte_letters()
        self.added = [t["content"] for t in spec["added_tokens"]]
        plain = {k: bytes(letters[c] for c in k) for k in spec["model"]["vocab"] if k not in self.added}
        self.ids = {b: i for i, b in enumerate(plain.values())}
        self.length = [len(b) for b in plain.values()]
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            x, y = self.ids[plain[a]], self.ids[plain[b]]
            self.rank[x, y] = r
            self.made.setdefault(self.ids[plain[a] + plain[b]], (x, y, r))
        self.longer: dict[bytes, list[int]] = {}  # the tokens that begin with these bytes and are longer
        for b, i in self.ids.items():
            for k in range(len(b)):
                self.longer.setdefault(b[:k], []).append(i)
        self.left_of: dict[int, list[tuple[int, float]]] = {}
        self.right_of: dict[int, list[tuple[int, float]]] = {}
        self.stable: dict[tuple[int, int], bool] = {}
        self.clear()

    def clear(self) -> None:
        self.states: dict[tuple, int] = {}
        self.keys: list[tuple] = []
        self.moves = np.zeros(1 << 12 << 8, np.int32)  # by state and byte: next state * 16 + change + 8; 0: not compiled
        self.state((b"", ((-1, 0),)))

    def state(self, key: tuple) -> int:
        at = self.states.get(key)
        if at is None:
            at = self.states[key] = len(self.keys)
            self.keys.append(key)
            if at << 8 >= len(self.moves):
                self.moves = np.concatenate((self.moves, np.zeros_like(self.moves)))
        return at

    def spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """From the outermost byte to the token: each part and the rank of the merge that ends it."""
        parts, over = [], float("inf")
        while True:
            parts.append((token, over))
            if token not in self.made:
                return parts[::-1]
            over, token = self.made[token][2], self.made[token][side]

    def fits(self, a: int, b: int) -> bool:
        """Whether the encoding of both tokens' bytes is these two tokens."""
        key = (a, b)
        known = self.stable.get(key)
        if known is None:
            xs = self.right_of.get(a) or self.right_of.setdefault(a, self.spine(a, 1))
            ys = self.left_of.get(b) or self.left_of.setdefault(b, self.spine(b, 0))
            i = j = 0
            known = True
            while True:
                (x, end_x), (y, end_y) = xs[i], ys[j]
                across = self.rank.get((x, y), float("inf"))
                if across < end_x and across <= end_y and across != float("inf"):
                    known = False
                    break
                if i == len(xs) - 1 and j == len(ys) - 1:
                    break
                if end_x <= end_y:
                    i += 1
                else:
                    j += 1
            self.stable[key] = known
        return known

    def allowed(self, what: int | tuple, token: int) -> bool:
        """Whether a token may start where ``what`` stands: the token before, or -1 at the start, or all that may."""
        return token in what if isinstance(what, tuple) else what < 0 or self.fits(what, token)

    def move(self, at: int, byte: int) -> None:
        """Compile the transition of a state by a byte."""
        seen, last = self.keys[at]  # the open bytes; what may start at each open position, and its count relative to the newest
        grown = seen + bytes((byte,))
        for k, x in enumerate(last):  # from the longest suffix
            token = x and self.ids.get(grown[k:])
            if token is not None and self.allowed(x[0], token):
                break
        else:
            raise ValueError("the vocabulary lacks a byte")
        change = last[k][1] + 1
        rest: list[tuple | None] = []
        for k, x in enumerate(last):
            longer = x and self.longer.get(grown[k:])
            if longer:
                what = x[0]
                if isinstance(what, tuple) or len(longer) <= FEW:
                    what = tuple(t for t in longer if self.allowed(what, t))
                longer = (what, x[1] - change) if what != () else None
            rest.append(longer or None)
        keep = next((k for k, x in enumerate(rest) if x), len(rest))
        key = (grown[keep:], (*rest[keep:], (token, 0)))
        at_next = self.state(key)
        if not -8 <= change < 8:
            raise ValueError("a transition changes the count by more than the table holds")
        self.moves[at << 8 | byte] = at_next << 4 | (change + 8)

    def words(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Tokens of each pre-token, all read side by side, byte by byte."""
        if len(self.keys) > MOST_STATES:
            self.clear()
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        total, state = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        for j in range(int(lengths[0]) if len(lengths) else 0):
            n = int(np.searchsorted(-lengths, -j))  # those longer than j
            at = state[:n] << 8 | data[starts[:n] + j]
            got = self.moves[at]
            if not got.all():
                for key in np.unique(at[got == 0]).tolist():
                    self.move(key >> 8, key & 255)
                got = self.moves[at]
            total[:n] += (got & 15) - 8
            state[:n] = got >> 4
        out = np.empty_like(total)
        out[order] = total
        return out

    def counts(self, texts: list[str | None]) -> np.ndarray:
        """Tokens of each text."""
        out = np.zeros(len(texts), np.int64)
        batch, owners, size = [], [], 0
        for i, text in enumerate(texts):
            if not text:
                continue
            parts = [text]
            for added in self.added:
                if added in text:
                    parts = [p for x in parts for p in x.split(added)]
                    out[i] += len(parts) - 1
            for p in parts:
                while len(p) > PIECE:
                    cut = self._cut(p)
                    if cut == 0:
                        break
                    out[i] += self._count([p[:cut]], [0], 1)[0]
                    p = p[cut:]
                if p:
                    batch.append(p)
                    owners.append(i)
                    size += len(p)
                    if size >= PIECE:
                        out += self._count(batch, owners, len(texts))
                        batch, owners, size = [], [], 0
        if batch:
            out += self._count(batch, owners, len(texts))
        return out

    def _cut(self, text: str) -> int:
        """A place where a pre-token starts, before the end of the first piece; 0: one pre-token fills the text."""
        size = PIECE
        while True:
            piece = text[:size]
            points = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)
            first = np.zeros(len(points), bool)
            first[0] = True
            at = np.flatnonzero(scan_states(symbols_of(points, first)))
            at = at[at < len(points) - 4] if len(piece) < len(text) else at
            if len(at) > 1:
                return int(at[-1])
            if size >= len(text):
                return 0
            size *= 2

    def _count(self, texts: list[str], owners: list[int], n: int) -> np.ndarray:
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        begins = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        first = np.zeros(len(points), bool)
        first[begins] = True
        starts = np.flatnonzero(scan_states(symbols_of(points, first)))
        ends = np.append(starts[1:], len(points))
        powers, inverse, table_ = _powers(len(points))
        sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(table_[points & 0xFFFF] * powers[: len(points)] + (points >> np.uint32(16)).astype(np.uint64) * powers[: len(points)], out=sums[1:])
        keys = (sums[ends] - sums[starts]) * inverse[starts]
        keys ^= (ends - starts).astype(np.uint64) << np.uint64(56)
        _, where, which = np.unique(keys, return_index=True, return_inverse=True)
        data = np.frombuffer(joined.encode("utf-8", "surrogatepass"), np.uint8)
        if len(data) == len(points):
            begin, size = starts[where], (ends - starts)[where]
        else:
            at = np.zeros(len(points) + 1, np.int64)
            np.cumsum(1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000), out=at[1:])
            begin, size = at[starts[where]], at[ends[where]] - at[starts[where]]
        each = self.words(data, begin, size)
        owner = np.repeat(np.asarray(owners), lengths)[starts]
        return np.bincount(owner, weights=each[which], minlength=n).astype(np.int64)


_KEPT: dict = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of an odd multiplier and of its inverse modulo 2**64, and a random value per character."""
    if _KEPT.get("n", 0) < n:
        base = np.uint64(0x9E3779B97F4A7C15)
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        size = max(n, 2 * PIECE)
        p = np.ones(size + 1, np.uint64)
        q = np.ones(size + 1, np.uint64)
        p[1:], q[1:] = base, inverse
        _KEPT.update(n=size, p=np.cumprod(p), q=np.cumprod(q), t=np.random.default_rng(5).integers(1, 1 << 63, 1 << 16, dtype=np.uint64))
    return _KEPT["p"], _KEPT["q"], _KEPT["t"]


def counter_of(raw: bytes) -> Counter:
    """The compiled transducer, once for a worker."""
    kept = sys.__dict__.setdefault("_helixframe_tokenizers", {})
    key = hashlib.sha256(raw).hexdigest()
    if key not in kept:
        kept[key] = Counter(raw)
    return kept[key]


def token_counts(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row."""
    spark = docs.sparkSession
    ship(spark)
    with open(tokenizer_path, "rb") as f:
        vocabulary = spark.sparkContext.broadcast(f.read())  # a file of fixed size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = counter_of(vocabulary.value)
        for b in batches:
            texts = [x if isinstance(x, str) else None for x in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_bytes": b["n_bytes"], "n_tokens": counter.counts(texts)})

    slim = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)).cast("bigint").alias("n_bytes"), F.col(f"`{text}`").alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    out = slim.mapInPandas(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
