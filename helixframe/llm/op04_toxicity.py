"""Toxicity by a linear-chain conditional random field over words.

Learning uses a bounded sample of labelled rows (``SAMPLE_ROWS`` of each label, by hash order, never the held-out fifth).
Documents carry labels, words don't, so words are labelled first: a greedy cover picks the words and word beginnings that
explain toxic documents not yet explained and hardly occur in clean ones, each against a significance bound; their
occurrences in toxic documents are the labelled tokens. A two-tag chain is then trained on these tokens (features: the word,
its beginnings, its neighbours, and tag transitions) by its exact likelihood gradient. Forward-backward gives each word's
marginal; a document's score is a logistic function of its largest log-odds and its expected number of toxic words, fitted
to the sample's documents at the labels' true rates. Words over 0.5 are the offending offsets.

Two tags make the messages single ratios, so chunks of all documents run side by side and hand their ratio on to the next
chunk until nothing changes; texts of any length are read whole.

Defined cases: null or empty text scores like a text without words; a null doc_id is not held out and is not learnt from;
without any labelled row of both kinds every score is the rate of the labels seen (0 without any); repeated rows get equal
scores; null labels are not learnt from; other columns are untouched.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.session import ship

from .common import schema_with, table
from .words import _VALUES, _powers, mix

#: Labelled rows of each label that the model is fitted on, at most.
SAMPLE_ROWS = 1500
#: Of these, rows of each label whose words the chain is trained on.
TRAIN_ROWS = 700
#: Bytes of the word beginnings that are features.
BEGINNINGS = (3, 4, 5, 6, 8)
BITS = 18
CHUNK = 256
SPREAD = 20.0

_LETTERS = np.zeros(256, np.uint8)
_LETTERS[0x61:0x7B] = np.arange(0x61, 0x7B)
_LETTERS[0x41:0x5B] = np.arange(0x61, 0x7B)
_LETTERS[0x80:] = np.arange(0x80, 0x100)


class Words:
    """Words of several texts: byte offsets, owners, and hashed features."""

    def __init__(self, texts: list[bytes]):
        data = b"\n".join(texts)
        low = _LETTERS[np.frombuffer(data, np.uint8)]
        inside = np.zeros(len(low) + 2, np.int8)
        inside[1:-1] = low > 0
        edges = np.diff(inside)
        self.starts, self.ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.begins = np.concatenate(([0], np.cumsum(sizes + 1)[:-1])).astype(np.int64)
        self.first = np.append(np.searchsorted(self.starts, self.begins), len(self.starts))
        p, q = _powers(len(low) + 1)
        sums = np.zeros(len(low) + 1, np.uint64)
        np.cumsum(_VALUES[low] * p[: len(low)], out=sums[1:])
        length = self.ends - self.starts
        at = lambda to, salt: mix((sums[to] - sums[self.starts]) * q[self.starts] + np.uint64(salt))
        self.word = at(self.ends, 1)
        self.own = [self.word]  # features of the word itself; 0: none
        for k in BEGINNINGS:
            self.own.append(np.where(length > k, at(np.minimum(self.starts + k, self.ends), 100 + k), 0))

    @classmethod
    def of_many(cls, texts: list[bytes]) -> Words:
        """For learning: as if all texts were read at once, with working memory for a few of them; no offsets."""
        parts, batch, size = [], [], 0
        for t in texts:
            batch.append(t)
            size += len(t)
            if size >= 2 << 20:
                parts.append(cls(batch))
                batch, size = [], 0
        if batch or not parts:
            parts.append(cls(batch))
        out = cls.__new__(cls)
        out.own = [np.concatenate(x) for x in zip(*(p.own for p in parts), strict=True)]
        out.word = out.own[0]
        out.first = np.concatenate(([0], np.cumsum(np.concatenate([np.diff(p.first) for p in parts]))))
        return out

    def indexes(self, size: int) -> Iterator[np.ndarray]:
        """The places of the features in a table of ``size`` weights: the word's own, then its neighbours."""
        mask = np.uint64(size - 1)
        for f in self.own:
            yield (f & mask).astype(np.int32)
        new = np.zeros(len(self.word), bool)
        new[self.first[:-1][self.first[:-1] < len(new)]] = True
        for salt in (7, 9):
            near = (mix(self.word + np.uint64(salt)) & mask).astype(np.int32)
            out = np.zeros(len(near), np.int32)
            if salt == 7:
                out[1:] = np.where(new[1:], 0, near[:-1])
            else:
                out[:-1] = np.where(new[1:], 0, near[1:])
            yield out

    def unary(self, weights: np.ndarray) -> np.ndarray:
        total = np.full(len(self.word), weights[1], np.float64)
        for i in self.indexes(len(weights)):
            total += weights[i]
        return total


def _scan(x: np.ndarray, first: np.ndarray, t: np.ndarray, back: bool) -> np.ndarray:
    """Message ratios along each sequence. ``t``: exp of the transition scores, t[from][to].

    Forward: out = x * (t01 + t11 out') / (t00 + t10 out'), starting with x. Back: out = (t10 + t11 y) / (t00 + t01 y) with
    y = x' out' of the word behind, starting with 1.
    """
    n = len(x)
    if back:
        x, first = x[::-1], n - first[::-1]
    lengths = np.diff(first)
    chunks = -(-lengths // CHUNK)
    owner = np.repeat(np.arange(len(lengths)), chunks)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    start = first[:-1][owner] + number * CHUNK
    size = np.minimum(lengths[owner] - number * CHUNK, CHUNK)
    out = np.empty(n)
    entry = np.full(len(start), np.nan)  # nan: a sequence begins
    todo = np.arange(len(start))
    while len(todo):
        todo = todo[np.argsort(-size[todo], kind="stable")]
        s, z, carry = start[todo], size[todo], entry[todo]
        for j in range(int(z[0])):
            m = int(np.searchsorted(-z, -j))
            at = s[:m] + j
            if back:
                now = np.where(np.isnan(carry[:m]), 1.0, (t[1][0] + t[1][1] * carry[:m]) / (t[0][0] + t[0][1] * carry[:m]))
                out[at] = now
                carry[:m] = now * x[at]
            else:
                now = x[at] * np.where(np.isnan(carry[:m]), 1.0, (t[0][1] + t[1][1] * carry[:m]) / (t[0][0] + t[1][0] * carry[:m]))
                out[at] = carry[:m] = now
        last = out[start + size - 1] * (x[start + size - 1] if back else 1.0)
        want = np.where(number[1:] > 0, last[:-1], np.nan)
        stale = ~((entry[1:] == want) | (np.isnan(entry[1:]) & np.isnan(want)))
        entry[1:] = want
        todo = np.flatnonzero(stale) + 1
    return out[::-1] if back else out


def marginal_odds(unary: np.ndarray, first: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Log-odds of the toxic tag of every word."""
    if not len(unary):
        return unary
    x, t = np.exp(np.clip(unary, -SPREAD, SPREAD)), np.exp(transitions)
    return np.log(_scan(x, first, t, False)) + np.log(_scan(x, first, t, True))


def _counts(words: Words, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The features of words and in how many of the documents each stands."""
    each = [np.unique(np.concatenate([f[words.first[d] : words.first[d + 1]] for f in words.own])) for d in docs.tolist()]
    return np.unique(np.concatenate(each), return_counts=True) if each else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def seeds(words: Words, toxic: np.ndarray, rate: float) -> np.ndarray:
    """Features that explain the toxic documents.

    First a greedy cover by log-likelihood ratio; then features that stand in a good part as many toxic documents as the
    cover's, as pure as they, on words that none of them marks: documents with several toxic words need one for the cover.
    """
    clean = np.flatnonzero(~toxic)
    kinds, against = _counts(words, clean)
    weight = (1 - rate) / max(rate, 1e-9) * toxic.sum() / max(len(clean), 1)  # a clean document of the sample in units of toxic ones

    def judged(docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        f, t = _counts(words, docs)
        f, t = f[f != 0], t[f != 0]
        at = np.minimum(np.searchsorted(kinds, f), max(len(kinds) - 1, 0))
        c = (np.where(kinds[at] == f, against[at], 0) + 0.02) * weight if len(kinds) else np.full(len(f), 0.02 * weight)
        share = t / (t + c)
        return f, t, np.where(share > rate, t * np.log(share / rate) + c * np.log((1 - share) / (1 - rate)), 0)

    def specific(equal: np.ndarray) -> np.uint64:  # of equals: the word, else its longest beginning
        return next(e[0] for x in (words.own[0], *words.own[:0:-1]) if len(e := equal[np.isin(equal, x)]))

    found, times = [], []
    marked = np.zeros(len(words.word), bool)
    open_ = np.flatnonzero(toxic)
    owner = np.repeat(np.arange(len(toxic)), np.diff(words.first))

    def take(best: np.uint64, t: int) -> None:
        found.append(int(best))
        times.append(t)
        for x in words.own:
            marked[x == best] = True

    while len(open_):
        f, t, gain = judged(open_)
        if not len(f) or gain.max() < np.log(len(f)) + 3:
            break
        best = specific(f[gain >= gain.max() - 1e-9])
        take(best, int(t[f == best][0]))
        open_ = np.setdiff1d(open_, owner[marked])
    if found:
        f, t, gain = judged(np.flatnonzero(toxic))
        every = [int(t[f == x][0]) for x in np.array(found, np.uint64) if (f == x).any()]
        least = max(0.25 * np.median(every), (np.log(len(f)) + 3) / np.log(1 / rate))
        for g in np.argsort(-gain, kind="stable"):
            if gain[g] < 0.25 * np.median(every) * np.log(1 / rate) or t[g] < least:
                break
            equal = f[(gain == gain[g]) & (t == t[g])]
            best = specific(equal)
            at = np.logical_or.reduce([x == best for x in words.own])
            if marked[at & toxic[owner]].mean() < 0.5:
                take(best, int(t[g]))
    return np.array(found, np.uint64)


def train(words: Words, tags: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transitions by gradient ascent of the likelihood of the tags (Adagrad, small decay)."""
    weights, transitions = np.zeros(1 << BITS), np.zeros((2, 2))
    weights[1] = -4.0  # the bias sits at an index of its own
    index = list(words.indexes(len(weights)))
    sums, trans_sums = np.full(len(weights), 1e-3), np.full((2, 2), 1.0)
    new = np.zeros(len(tags), bool)
    new[words.first[:-1][words.first[:-1] < len(tags)]] = True
    inner = ~new[1:]
    for _ in range(rounds):
        u = np.full(len(tags), weights[1])
        for i in index:
            u += weights[i]
        odds = marginal_odds(u, words.first, transitions)
        p = 1 / (1 + np.exp(-np.clip(odds, -SPREAD, SPREAD)))
        miss = tags - p
        grad = np.zeros_like(weights)
        for i in index:
            grad += np.bincount(i, weights=miss, minlength=len(weights))
        grad[1] += miss.sum()
        grad -= 0.01 * weights
        sums += grad**2
        weights += 0.5 * grad / np.sqrt(sums)
        # pairs: the joint of neighbours under the model against the tags
        x = np.exp(np.clip(u, -SPREAD, SPREAD))
        a, b = _scan(x, words.first, np.exp(transitions), False), _scan(x, words.first, np.exp(transitions), True)
        left, right = a[:-1][inner], (x * b)[1:][inner]
        t = np.exp(transitions)
        joint = np.stack([t[0][0] + 0 * left, t[0][1] * right, t[1][0] * left, t[1][1] * left * right])
        model = (joint / joint.sum(0)).sum(1).reshape(2, 2)
        seen = np.bincount((tags[:-1] * 2 + tags[1:])[inner].astype(int), minlength=4).reshape(2, 2)
        g = (seen - model) - 0.1 * transitions
        g -= g[0][0]  # only differences count
        trans_sums += g**2
        transitions = np.clip(transitions + 0.3 * g / np.sqrt(trans_sums), -6, 6)
    return weights, transitions


def document_features(odds: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Largest log-odds and log of the expected number of toxic words, for each document."""
    out = np.tile([-SPREAD, 0.0], (len(first) - 1, 1))
    some = np.flatnonzero(np.diff(first) > 0)
    if len(some):
        p = 1 / (1 + np.exp(-np.clip(odds, -SPREAD, SPREAD)))
        out[some, 0] = np.clip(np.maximum.reduceat(odds, first[some]), -SPREAD, SPREAD)
        out[some, 1] = np.log1p(np.add.reduceat(p, first[some]))
    return out


def calibrate(x: np.ndarray, y: np.ndarray, rate: float) -> np.ndarray:
    """Logistic coefficients (bias first) at the true rate of the label, by Newton steps with a small ridge."""
    x = np.column_stack((np.ones(len(x)), x))
    w = np.where(y > 0, rate / max(y.mean(), 1e-9), (1 - rate) / max(1 - y.mean(), 1e-9))
    beta = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (w * p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(x.shape[1])
        beta = beta + np.linalg.solve(h, x.T @ (w * (y - p)) - 0.5 * beta)
    return beta


def fit(texts: list[bytes], toxic: np.ndarray, rate: float) -> dict:
    if not toxic.any() or toxic.all():
        return {"rate": float(rate)}
    words = Words.of_many(texts)
    kinds = seeds(words, toxic, rate)
    # the chain learns from some of the rows, the calibration from all
    part = np.sort(np.concatenate([np.flatnonzero(toxic)[:TRAIN_ROWS], np.flatnonzero(~toxic)[:TRAIN_ROWS]]))
    words = Words.of_many([texts[i] for i in part])
    tags = np.zeros(len(words.word), np.float64)
    for f in words.own:
        tags[np.isin(f, kinds)] = 1
    tags *= np.repeat(toxic[part], np.diff(words.first))
    weights, transitions = train(words, tags)
    del words
    x = []
    for a in range(0, len(texts), 256):
        some = Words.of_many(texts[a : a + 256])
        x.append(document_features(marginal_odds(some.unary(weights), some.first, transitions), some.first))
    return {"weights": weights.astype(np.float32), "transitions": transitions, "beta": calibrate(np.concatenate(x), toxic.astype(float), rate)}


def score_texts(model: dict, texts: list[bytes]) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
    """Scores and offending (start, end) byte offsets."""
    if "rate" in model:
        return np.full(len(texts), model["rate"]), [[] for _ in texts]
    words = Words(texts)
    odds = marginal_odds(words.unary(model["weights"]), words.first, model["transitions"])
    x = document_features(odds, words.first)
    z = model["beta"][0] + x @ model["beta"][1:]
    bad = np.flatnonzero(odds > 0)
    owner = np.searchsorted(words.first, bad, "right") - 1
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    for d, s, e in zip(owner.tolist(), (words.starts[bad] - words.begins[owner]).tolist(), (words.ends[bad] - words.begins[owner]).tolist(), strict=True):
        spans[d].append((s, e))
    return 1 / (1 + np.exp(-np.clip(z, -30, 30))), spans


def held_out(doc_id) -> F.Column:
    """Whether crc32 of the id as text is divisible by five; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = SAMPLE_ROWS) -> dict:
    """A model from a bounded sample of the labelled rows outside the held-out fifth."""
    known = labels.select(F.col(f"`{doc_id}`").alias("id_"), F.col(f"`{label}`").alias("y_")).where("id_ is not null and y_ is not null").where(~held_out(F.col("id_")))
    total = dict(known.groupBy((F.col("y_") == 1).alias("y")).count().collect())
    rate = total.get(True, 0) / max(sum(total.values()), 1)
    picked = None
    for y in (True, False):
        some = known.where((F.col("y_") == 1) == y).orderBy(F.xxhash64("id_"), "id_", "y_").limit(rows)
        picked = some if picked is None else picked.union(some)
    sample = docs.select(F.col(f"`{doc_id}`").alias("id_"), F.col(f"`{text}`").alias("t_")).join(F.broadcast(picked), "id_").select("t_", "y_")
    ship(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if not parts:
            return
        every = pd.concat(parts, ignore_index=True).drop_duplicates()
        yield pd.DataFrame({"model": [pickle.dumps(fit([_bytes(x) for x in every["t_"]], (every["y_"] == 1).to_numpy(bool), rate))]})

    # one task on an executor fits the bounded sample, in an order of its own
    fitted = sample.repartition(1).sortWithinPartitions(F.xxhash64("t_"), "t_", "y_").mapInPandas(run, "model binary").collect()
    return pickle.loads(fitted[0][0]) if fitted else {"rate": float(rate)}


def _bytes(x) -> bytes:
    return x.encode("utf-8", "surrogatepass") if isinstance(x, str) else b""


def toxicity(docs: DataFrame, model: dict, text: str = "text", keep_text: bool = True, with_spans: bool = True) -> DataFrame:
    """The columns of ``docs`` but the text in struct ``row``; ``text`` (null without ``keep_text``); struct ``toxicity``: score,
    spans of offending characters.
    """
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)  # a table of fixed size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            raw = [_bytes(x) for x in b["text_"]]
            scores, spans = np.zeros(len(raw)), []
            sizes = np.cumsum([len(x) for x in raw])
            for part in np.unique(sizes // (1 << 20)).tolist():
                at = np.flatnonzero(sizes // (1 << 20) == part)
                scores[at], found = score_texts(sent.value, [raw[i] for i in at])
                spans += found
            tox = []
            for t, s, marks in zip(raw, scores.tolist(), spans, strict=True):
                where = []
                if with_spans and marks:
                    letters = np.cumsum((np.frombuffer(t, np.uint8) & 0xC0) != 0x80)
                    where = [{"start": int(letters[a] - 1), "end": int(letters[e - 1])} for a, e in marks]
                tox.append({"score": s, "spans": where})
            yield pd.DataFrame({"row": b["row"], "text": b["text_"] if keep_text else None, "toxicity": tox})

    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text])
    slim = docs.select(row.alias("row"), F.col(f"`{text}`").alias("text_"))
    return slim.mapInPandas(run, schema_with(slim, "row", text="string", toxicity="struct<score:double,spans:array<struct<start:bigint,end:bigint>>>"))


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, table(spark, sf_dir, "labels"))
    out = toxicity(docs, model, keep_text=False, with_spans=False)
    score = F.col("toxicity.score")
    return out.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))
