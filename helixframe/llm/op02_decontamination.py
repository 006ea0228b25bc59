"""Benchmark decontamination with an FM-index per training shard.

A shard is a few megabytes of whole texts. Its words are read over the phrases' alphabet: each word that occurs in a phrase
is a symbol, each stretch of other words, and each end of a document, is one break symbol, unequal to any other. The index
of the shard is built in full: suffix order by prefix doubling (packed keys first, then only what is still tied), the
Burrows-Wheeler sequence in a wavelet matrix with rank counts, and suffix positions sampled every ``SAMPLE`` words and
behind each break. All phrases are searched backwards at once; occurrences are located by walking back to a sampled
position, marked on the words of their documents and merged to removal spans.

Benchmark items go to the workers in blocks of bounded size; any number of blocks is searched one after the other.

Words are runs of ASCII digits, ASCII letters (lower-cased) and all characters beyond ASCII. A phrase is ``window``
consecutive words of an item; an item with fewer, but not none, is one phrase.

Defined cases: null or empty text has no words and stays as it is; null or wordless items have no phrases; rows are
independent, so repeated rows get the same result; several items with the same phrase all count; an empty benchmark leaves
everything clean; other columns are untouched.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.session import ship

from .common import schema_with, table

WINDOW = 10
SHARD_BYTES = 4 << 20
SAMPLE = 16
#: Bytes of items in a block that goes to the workers.
BLOCK_BYTES = 16 << 20

_LOWER = np.zeros(256, np.uint8)  # 0: not part of a word
_LOWER[0x30:0x3A] = np.arange(0x30, 0x3A)
_LOWER[0x61:0x7B] = np.arange(0x61, 0x7B)
_LOWER[0x41:0x5B] = np.arange(0x61, 0x7B)
_LOWER[0x80:] = np.arange(0x80, 0x100)
_BASE = 0xD6E8FEB86659FD93
_VALUES = np.random.default_rng(2).integers(1, 1 << 63, 256, dtype=np.uint64)
_VALUES[0] = 0
_KEPT: dict = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _KEPT.get("n", 0) < n:
        size = max(n, SHARD_BYTES + (1 << 18))
        p, q = np.ones(size, np.uint64), np.ones(size, np.uint64)
        p[1:], q[1:] = _BASE, pow(_BASE, -1, 1 << 64)
        _KEPT.update(n=size, p=np.cumprod(p), q=np.cumprod(q))
    return _KEPT["p"], _KEPT["q"]


def words_of(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of the words of UTF-8 text."""
    low = _LOWER[np.frombuffer(data, np.uint8)]
    inside = np.zeros(len(low) + 2, np.int8)
    inside[1:-1] = low > 0
    edges = np.diff(inside)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    p, q = _powers(len(low) + 1)
    sums = np.zeros(len(low) + 1, np.uint64)
    np.cumsum(_VALUES[low] * p[: len(low)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * q[starts]
    return starts, ends, h ^ (h >> np.uint64(29)) ^ ((ends - starts).astype(np.uint64) << np.uint64(57))


class Phrases:
    """A block of items as phrases over the alphabet of their words."""

    def __init__(self, items: list[tuple[object, str]], window: int):
        found = [(i, words_of((text or "").encode("utf-8", "surrogatepass"))[2]) for i, text in items]
        found = [(i, w) for i, w in found if len(w)]
        self.alphabet = np.unique(np.concatenate([w for _, w in found])) if found else np.zeros(0, np.uint64)
        owners: dict[tuple, set] = {}
        for i, w in found:
            ids = np.searchsorted(self.alphabet, w) + 1
            n = min(window, len(ids))
            for k in range(len(ids) - n + 1):
                owners.setdefault(tuple(ids[k : k + n].tolist()), set()).add(i)
        self.items = [sorted(v, key=str) for v in owners.values()]
        self.lengths = np.array([len(k) for k in owners], np.int64)
        self.symbols = np.zeros((len(owners), window), np.int64)  # from the last word to the first
        for r, k in enumerate(owners):
            self.symbols[r, : len(k)] = k[::-1]

    def read(self, hashes: np.ndarray) -> np.ndarray:
        """The symbols of words; 0: not in the alphabet."""
        at = np.minimum(np.searchsorted(self.alphabet, hashes), max(len(self.alphabet) - 1, 0))
        return np.where(self.alphabet[at] == hashes, at + 1, 0) if len(self.alphabet) else np.zeros(len(hashes), np.int64)


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Positions in the order of their suffixes. The text ends with a zero. Zeros are unequal symbols, ordered by position, before all others."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    place, bits = max(1, int(n).bit_length()), max(1, int(text.max()).bit_length())
    width = max(1, (63 - place) // bits)
    key, ended = np.zeros(n, np.int64), np.zeros(n, bool)
    for k in range(min(width, n)):
        here = np.zeros(n, np.int64)
        here[: n - k] = text[k:] if k else text
        ended |= here == 0
        key = (key << bits) | np.where(ended, 0, here)
    key = (key << place) | np.arange(n)
    key.sort()
    order = key & ((1 << place) - 1)
    key >>= place
    fresh = np.empty(n, bool)
    fresh[0] = True
    fresh[1:] = (key[1:] != key[:-1]) | ended[order[1:]]  # what has met its break is ordered by position
    group = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank = np.empty(n + 1, np.int64)
    rank[order], rank[n] = group, -1
    step = width
    while True:
        size_one = fresh & np.append(fresh[1:], True)
        tied = np.flatnonzero(~size_one)
        if not len(tied):
            return order
        at = order[tied]
        second = rank[np.minimum(at + step, n)]
        # within each tied group, by the rank of what follows
        again = np.lexsort((second, group[tied]))
        order[tied] = at[again]
        g, second = group[tied], second[again]
        fresh[tied[1:]] = (g[1:] != g[:-1]) | (second[1:] != second[:-1])
        group = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        rank[order[tied]] = group[tied]
        step *= 2


class Index:
    """An FM-index over symbols: wavelet matrix, symbol starts, sampled positions."""

    def __init__(self, text: np.ndarray, symbols: int):
        order = suffix_order(text)
        self.n = len(text)
        before = np.where(order > 0, text[order - 1], 0)  # the Burrows-Wheeler sequence
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=symbols + 1))))
        self.levels, self.zeros = [], []
        self.bits = max(1, int(symbols).bit_length())
        left = before.astype(np.int32)
        for b in range(self.bits - 1, -1, -1):
            bit = ((left >> b) & 1).astype(bool)
            ones = np.zeros(self.n + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.levels.append(ones)
            self.zeros.append(self.n - int(ones[-1]))
            left = np.concatenate((left[~bit], left[bit]))
        sampled = (order % SAMPLE == 0) | (before == 0)
        self.sample_rank = np.zeros(self.n + 1, np.int32)
        np.cumsum(sampled, out=self.sample_rank[1:])
        self.samples = order[sampled]

    def rank(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How often the symbol stands before the row."""
        start, at = np.zeros_like(row), row
        for k, (ones, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            bit = (symbol >> (self.bits - 1 - k)) & 1 == 1
            a, s = ones[at], ones[start]
            at, start = np.where(bit, zeros + a, at - a), np.where(bit, zeros + s, start - s)
        return at - start

    def symbol(self, row: np.ndarray) -> np.ndarray:
        out = np.zeros_like(row)
        for ones, zeros in zip(self.levels, self.zeros, strict=True):
            a = ones[row]
            bit = ones[row + 1] - a
            out = out * 2 + bit
            row = np.where(bit == 1, zeros + a, row - a)
        return out

    def search(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows (from, to) of the suffixes that begin with each phrase; phrases are given backwards."""
        lo, hi = np.zeros(len(symbols), np.int64), np.full(len(symbols), self.n, np.int64)
        open_ = np.arange(len(symbols))
        for k in range(symbols.shape[1]):
            open_ = open_[(lengths[open_] > k) & (hi[open_] > lo[open_])]
            if not len(open_):
                break
            c = symbols[open_, k]
            lo[open_] = self.starts[c] + self.rank(c, lo[open_])
            hi[open_] = self.starts[c] + self.rank(c, hi[open_])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows."""
        out, steps = np.empty(len(rows), np.int64), 0
        open_, rows = np.arange(len(rows)), rows.copy()
        while len(open_):
            r = rows[open_]
            known = self.sample_rank[r + 1] > self.sample_rank[r]
            out[open_[known]] = self.samples[self.sample_rank[r[known]]] + steps
            open_, r = open_[~known], r[~known]
            c = self.symbol(r)
            rows[open_] = self.starts[c] + self.rank(c, r)
            steps += 1
        return out


def _search_shard(texts: list[bytes], blocks: list[Phrases]) -> list[tuple[int, list, list, bytes]]:
    """For each text: words, hit word spans [(first, behind last)], items, text without the spans."""
    data = b"\x00".join(texts)
    starts, ends, hashes = words_of(data)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    first = np.append(np.searchsorted(starts, begins), len(starts))  # the first word of each text
    hit = np.zeros(len(starts) + 1, np.int64)
    items: dict[int, set] = {}
    for phrases in blocks:
        if not len(phrases.lengths) or not len(starts):
            continue
        ids = phrases.read(hashes)
        # a break before each text; one symbol for each stretch of other words
        lead = np.zeros(len(ids), bool)
        lead[first[:-1][first[:-1] < len(ids)]] = True
        keep = (ids > 0) | np.append(True, ids[:-1] > 0) | lead
        at = np.flatnonzero(keep)
        extra = lead[at] & (ids[at] > 0)
        where = np.repeat(at, 1 + extra)
        text = ids[where]
        text[(np.cumsum(1 + extra) - 1 - extra)[extra]] = 0
        index = Index(np.append(text, 0), len(phrases.alphabet))
        lo, hi = index.search(phrases.symbols, phrases.lengths)
        found = np.flatnonzero(hi > lo)
        if not len(found):
            continue
        times = (hi - lo)[found]
        which = np.repeat(found, times)
        rows = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + lo[which]
        word = where[index.locate(rows)]
        np.add.at(hit, word, 1)
        np.add.at(hit, word + phrases.lengths[which], -1)
        doc = np.searchsorted(first, word, "right") - 1
        for d, p in np.unique(np.stack((doc, which)), axis=1).T.tolist():
            items.setdefault(d, set()).update(phrases.items[p])
    marked = np.cumsum(hit[:-1]) > 0
    out = []
    for d, text in enumerate(texts):
        a, b = int(first[d]), int(first[d + 1])
        if d not in items:
            out.append((b - a, [], [], text))
            continue
        edges = np.diff(np.concatenate(([0], marked[a:b].astype(np.int8), [0])))
        spans = list(zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True))
        parts, last = [], 0
        for s, e in spans:
            parts.append(text[last : starts[a + s] - begins[d]])
            last = ends[a + e - 1] - begins[d]
        out.append((b - a, spans, sorted(items[d], key=str), b"".join((*parts, text[last:]))))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, keep_text: bool = True) -> DataFrame:
    """The rows of ``docs`` with a struct column ``leaks``: n_words, spans (word numbers), items, text without the spans.

    Without ``keep_text`` the text is left out.
    """
    spark = docs.sparkSession
    ship(spark)
    kind = benchmark.schema[item_id].dataType.simpleString()
    blocks, block, size = [], [], 0
    for i, t in benchmark.select(F.col(f"`{item_id}`"), F.col(f"`{item_text}`")).toLocalIterator():
        block.append((i, t))
        size += len(t or "")
        if size >= BLOCK_BYTES:
            blocks.append(spark.sparkContext.broadcast(pickle.dumps(Phrases(block, window))))
            block, size = [], 0
    blocks.append(spark.sparkContext.broadcast(pickle.dumps(Phrases(block, window))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        once = [pickle.loads(blocks[0].value)] if len(blocks) == 1 else None
        for b in batches:
            texts = [x.encode("utf-8", "surrogatepass") if isinstance(x, str) else b"" for x in b["text_"]]
            sizes = np.cumsum([len(x) for x in texts])
            shard = (sizes - 1) // SHARD_BYTES if len(sizes) else sizes
            found: list = []
            for s in np.unique(shard).tolist():
                a, e = np.searchsorted(shard, [s, s + 1])
                found += _search_shard(texts[a:e], once or (pickle.loads(x.value) for x in blocks))
            leaks = [
                {"n_words": n, "spans": [{"first": a, "behind": e} for a, e in spans], "items": items, "text": None if not keep_text or not isinstance(t, str) else t if not spans else cut.decode("utf-8", "surrogatepass")}
                for (n, spans, items, cut), t in zip(found, b["text_"], strict=True)
            ]
            yield pd.DataFrame({"row": b["row"], "leaks": leaks})

    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]) if len(docs.columns) > 1 else F.struct(F.lit(0).alias("none"))
    slim = docs.select(row.alias("row"), F.col(f"`{text}`").alias("text_"))
    leak = f"struct<n_words:bigint,spans:array<struct<first:bigint,behind:bigint>>,items:array<{kind}>,text:string>"
    return slim.mapInPandas(run, schema_with(slim, "row", leaks=leak))


def op2_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate(docs, table(spark, sf_dir, "benchmark"), keep_text=False)
    names = F.transform("leaks.items", lambda x: x.cast("string"))
    n_hit = F.aggregate("leaks.spans", F.lit(0).cast("bigint"), lambda a, s: a + s["behind"] - s["first"])
    return out.select(
        "row.doc_id",
        "leaks.n_words",
        n_hit.alias("n_hit"),
        F.size("leaks.items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(names), ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
grams AS (
  SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, array_to_string(w[k:k + least(len(w), {WINDOW}) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(len(w), {WINDOW}) + 1)) AS k FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM grams),
seen AS (
  SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS k FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, item_id, k, seen.n FROM seen JOIN grams USING (n, gram)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(k, k + n - 1)) AS p FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS sha
  FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
