"""Substring dedup by content-defined chunks.

A gear rolling hash over the last 32 bytes decides where a chunk ends, so a boundary depends on nothing but these bytes and
an insertion shifts no boundary beyond them. Ends fall on white space (one in ``EVERY_SPACE`` of them), and, for
text without any, on one character in ``EVERY_BYTE``; no chunk is longer than ``MOST_BYTES``. Chunks are compared by a 96-bit digest of their bytes.

The smallest document that has a chunk owns it, in the order (doc_id, hash of the text), those without an id last. In other
documents, and on later places of the same document, the chunk is a copy; a run of neighbouring copies of at least
``MIN_WORDS`` words, or ``MIN_BYTES`` bytes where few spaces stand, is removed, and a text of ``WHOLE_BYTES`` bytes or more that is a
copy as a whole; shorter runs are left: a passage of fifty words loses at most part of a chunk at either end. The sum of both digests is 96 bits, so among 10^12 different chunks a false
equality has a chance of about 10^-5.

Each document sends each of its digests once; these rows are written once, owners are reduced before the shuffle, and the
occurrences of a very common chunk are only streamed past its one row in a join of two plain exchanges, which adaptive
execution splits. What comes back to a document is at most its own chunks.

Defined cases: null stays null, empty stays empty; rows with equal doc_id and equal text are one document, all rows of which
get its result; rows with equal doc_id (or none) and different texts are different documents; a text of one word over and over
has few content-defined ends and is cut every ``MOST_BYTES`` bytes; an empty table gives an empty result; other columns are
untouched. The written table of copies stays for the lazy result, the others are deleted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.session import ship

from .common import Scratch, materialise, schema_with, table
from .words import mix

EVERY_SPACE, EVERY_BYTE = 4, 256
MOST_BYTES = 512
MIN_WORDS, MIN_BYTES = 35, 512
WHOLE_BYTES = 60
WINDOW = 32
SHARD_BYTES = 4 << 20

_GEAR = np.random.default_rng(1).integers(1, 1 << 32, 256, dtype=np.uint32)
_GEAR[0] = 0
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_VALUES = np.random.default_rng(4).integers(1, 1 << 63, 256, dtype=np.uint64)
_KEPT: dict = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_KEPT.get(base, ((),))[0]) < n:
        size = max(n, SHARD_BYTES + (1 << 19))
        p, q = np.ones(size, np.uint64), np.ones(size, np.uint64)
        p[1:], q[1:] = base, pow(base, -1, 1 << 64)
        _KEPT[base] = np.cumprod(p), np.cumprod(q)
    return _KEPT[base]


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash of the bytes up to each place: sum of gear[byte j places back] << j, 32 bits."""
    h, w = _GEAR[data], 1
    while w < WINDOW:
        more = h.copy()
        more[w:] += h[:-w] << np.uint32(w)
        h, w = more, 2 * w
    return h


def chunks(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each text: chunk ends, and two digests of each chunk."""
    gap = b"\x00" * WINDOW  # its gear is zero, so a text starts afresh
    data = np.frombuffer(gap.join(texts) + gap, np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.concatenate(([0], np.cumsum(sizes + WINDOW)[:-1]))
    h = gear(data) >> np.uint32(12)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    whole = np.ones(len(data), bool)
    whole[:-1] = (data[1:] & 0xC0) != 0x80  # no cut inside a character
    limit = 1 << 20
    ends = np.flatnonzero((space & (h < limit // EVERY_SPACE)) | (whole & (h < limit // EVERY_BYTE))) + 1
    last = begins + sizes
    text = np.searchsorted(begins, ends - 1, "right") - 1
    ends = ends[ends < last[text]]
    some = last[sizes > 0]
    ends = np.sort(np.concatenate((ends, some)))
    # text that repeats itself may have no end for long: cut what is longer than MOST_BYTES, from its start
    long = np.diff(ends, prepend=0)
    before = np.searchsorted(begins, ends - 1, "right") - 1
    since = np.maximum(ends - long, begins[before]) if len(ends) else ends
    more = (ends - since - 1) // MOST_BYTES
    if more.any():
        k = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1
        extra = np.repeat(since, more) + k * MOST_BYTES
        for _ in range(3):
            extra = np.where(whole[extra - 1], extra, extra + 1)
        ends = np.unique(np.concatenate((ends, extra)))
    text = np.searchsorted(begins, ends - 1, "right") - 1
    starts = np.concatenate(([0], ends[:-1]))
    new = np.append(True, text[1:] != text[:-1]) if len(ends) else np.zeros(0, bool)
    starts[new] = begins[text[new]]
    digests = []
    for base in _BASES:
        p, q = _powers(base, len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUES[data] * p[: len(data)], out=sums[1:])
        digests.append(mix((sums[ends] - sums[starts]) * q[starts] + (ends - starts).astype(np.uint64)).view(np.int64))
    cut = np.searchsorted(text, np.arange(len(texts) + 1))
    return [(ends[a:b] - begins[i], digests[0][a:b], digests[1][a:b] >> 32) for i, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))]


def _each(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    batch, size = [], 0
    for t in texts:
        batch.append(t)
        size += len(t)
        if size >= SHARD_BYTES:
            yield from chunks(batch)
            batch, size = [], 0
    if batch:
        yield from chunks(batch)


def _firsts(h1: np.ndarray) -> np.ndarray:
    """The first place of each digest in a document."""
    return np.unique(h1, return_index=True)[1]


def _bytes(x) -> bytes:
    return x.encode("utf-8", "surrogatepass") if isinstance(x, str) else b""


def copied_spans(text: bytes, ends: np.ndarray, copied: np.ndarray, min_words: int, min_bytes: int) -> list[tuple[int, int]]:
    """Byte spans of the runs of copied chunks that are long enough."""
    edges = np.diff(np.concatenate(([0], copied.astype(np.int8), [0])))
    starts = np.concatenate(([0], ends))
    runs = zip(starts[np.flatnonzero(edges == 1)].tolist(), starts[np.flatnonzero(edges == -1)].tolist(), strict=True)
    return [(a, b) for a, b in runs if b - a >= min_bytes or len(text[a:b].split()) >= min_words or b - a == len(text) >= WHOLE_BYTES]


def substring_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, min_bytes: int = MIN_BYTES) -> DataFrame:
    """The columns of ``docs`` but the text in struct ``row``, with struct ``dedup``: text, n_chunks, spans (bytes) removed."""
    spark = docs.sparkSession
    ship(spark)
    keep = Scratch()
    t = F.col(f"`{text}`")
    slim = docs.select(F.col(f"`{doc_id}`").alias("id"), F.xxhash64(t).alias("h0"), t.alias("text"))
    kind = slim.schema["id"].dataType.simpleString()

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for a in range(0, len(b), 512):
                part = b.iloc[a : a + 512]
                found = [(i, k, h1[k], h2[k]) for i, (_, h1, h2) in enumerate(_each([_bytes(x) for x in part["text"]])) for k in [_firsts(h1)] if len(k)]
                if found:
                    of = part[["id", "h0"]].iloc[np.repeat([x[0] for x in found], [len(x[1]) for x in found])].reset_index(drop=True)
                    yield of.assign(k=np.concatenate([x[1] for x in found]).astype(np.int32), h1=np.concatenate([x[2] for x in found]), h2=np.concatenate([x[3] for x in found]).astype(np.int32))

    places = keep.write(slim.where("text <> ''").mapInPandas(send, f"id {kind}, h0 bigint, k int, h1 bigint, h2 int"), "chunks-places")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h0")).alias("owner")
    # a chunk of one document alone has no copies, however many rows repeat that document
    owners = places.groupBy("h1", "h2").agg(first, F.max(F.struct(F.col("id").isNull().alias("none"), "id", "h0")).alias("last")).where(~F.col("owner").eqNullSafe(F.col("last")))
    owners = keep.write(owners.select("h1", "h2", F.col("owner.id").alias("owner"), F.col("owner.h0").alias("own0")), "chunks-owners")
    others = places.join(owners, ["h1", "h2"]).where(~(F.col("id").eqNullSafe(F.col("owner")) & (F.col("h0") == F.col("own0"))))
    copies = materialise(others.groupBy(F.col("id").alias("id_"), F.col("h0").alias("h0_")).agg(F.collect_set("k").alias("copies")), "chunks-copies")
    keep.clear()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            raw = [_bytes(x) for x in b["text_"]]
            out = []
            for t, original, mine, (ends, h1, _) in zip(raw, b["text_"], b["copies"], _each(raw), strict=True):
                spans = []
                if len(ends):
                    copied = np.ones(len(ends), bool)
                    first = _firsts(h1)
                    copied[first] = False
                    if mine is not None and len(mine):
                        gone = np.unique(h1[np.asarray(mine, np.int64)])
                        copied |= np.isin(h1, gone)
                    spans = copied_spans(t, ends, copied, min_words, min_bytes)
                if spans:
                    parts, last = [], 0
                    for s, e in spans:
                        parts.append(t[last:s])
                        last = e
                    original = b"".join((*parts, t[last:])).decode("utf-8", "surrogatepass")
                out.append({"text": original if isinstance(original, str) else None, "n_chunks": len(ends), "spans": [{"start": s, "end": e} for s, e in spans]})
            yield pd.DataFrame({"row": b["row"], "dedup": out})

    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text])
    whole = docs.select(row.alias("row"), F.col(f"`{doc_id}`").alias("id"), F.xxhash64(t).alias("h0"), t.alias("text_"))
    both = whole.join(copies, F.col("id").eqNullSafe(F.col("id_")) & (F.col("h0") == F.col("h0_")), "left").select("row", "text_", "copies")
    return both.mapInPandas(cut, schema_with(both, "row", dedup="struct<text:string,n_chunks:bigint,spans:array<struct<start:bigint,end:bigint>>>"))


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("dedup.spans", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"])
    return out.select("row.doc_id", "dedup.n_chunks", removed.alias("removed_bytes"), F.transform("dedup.spans", lambda s: F.concat_ws("-", s["start"], s["end"])).alias("spans"), (removed > 0).alias("has_copies"), "dedup.text")
