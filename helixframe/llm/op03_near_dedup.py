"""MinHash near-dedup by an inverted join of signature coordinates, confirmed on full shingle sets.

1. Each text's set of word shingles gives a signature of ``COORDINATES`` minima. Equal sets are one class from here on;
   a class is a node.
2. Nodes are posted under each (coordinate, value). Values that one node has alone can't collide. A pair at the similarity
   asked for agrees in at least ``MATCHES`` coordinates but with a chance of about one in a million, and then shares a value
   among the ``COORDINATES - MATCHES + 1`` rarest of either (prefix filter): a node with too few shared values leaves, and
   only rare values are posted, so frequent lines and words make no long postings.
3. Postings are merged by representatives. In a round each posting has one pivot, the node whose values are the most common;
   its other nodes meet the pivot. Collisions are counted over the whole signatures, pairs below the match threshold, of
   incompatible sizes or already connected are skipped, the rest is confirmed on the full sets. A posting whose nodes are all
   connected is finished, else it goes on without its pivot. A group of copies is finished by its first pivot, so what is
   compared grows with the postings, not with their squares.
4. Nodes that stay in unfinished postings are posted anew under the rarest shingles of their sets (a pair at the similarity
   shares one of the ``(100 - percent)%`` rarest and one more), counted among these nodes: whoever has that many shingles
   alone is proven to be linked with none of them. As a pair's first common shingle has none that is common before it, its
   places in both orders bound the sizes that fit. Rounds as before follow.
5. What is unfinished even then is compared in blocks: the nodes outside a posting's largest component meet all that they
   aren't connected with. No pair is left out, and no pairs are written: only links that connect something.

Defined cases: null, empty or wordless text has an empty set, its own component and is kept; equal texts are linked; a
text with fewer words than a shingle is one shingle of all its words; repeated rows get the same result; a null doc_id has a
null component_id unless linked with others. Beside a row with an id, linked rows with a null doc_id are not kept; where no
row of a component has an id, one text is kept, that of the smallest hashes. An empty table gives an empty result; other
columns are left out. The result is a written table in the shared folder; all others are deleted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.session import ship

from .common import Scratch, by_group, components, materialise, table
from .words import shingle_sets

WORDS = 5
PERCENT = 80
COORDINATES, MATCHES = 64, 34
#: Nodes that meet one pivot, or one another, in a group of rows.
BLOCK = 64
#: Rounds of representatives before the next, finer way takes what is unfinished.
ROUNDS = 3

_RNG = np.random.default_rng(3)
_A = _RNG.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) | np.uint64(1)
_B = _RNG.integers(1, 1 << 63, COORDINATES, dtype=np.uint64)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """The minima of each nonempty set; zeros for an empty one."""
    out = np.zeros((len(sets), COORDINATES), np.int32)
    full = [i for i, s in enumerate(sets) if len(s)]
    for a in range(0, len(full), 256):
        part = full[a : a + 256]
        flat = np.concatenate([sets[i] for i in part])
        at = np.concatenate(([0], np.cumsum([len(sets[i]) for i in part])[:-1]))
        for k in range(COORDINATES):
            h = ((flat * _A[k] + _B[k]) >> np.uint64(32)).astype(np.uint32)
            out[part, k] = np.minimum.reduceat(h, at).view(np.int32)
    return out


def _bytes(x) -> bytes:
    return x.encode("utf-8", "surrogatepass") if isinstance(x, str) else b""


def link_block(labels: np.ndarray, sigs: np.ndarray, sets: list[np.ndarray], percent: int, left: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Index pairs that match and connect different groups; ``labels`` says what is connected already.

    ``left``: one end of each pair must be marked; None: all pairs.
    """
    n = len(labels)
    sizes = np.fromiter(map(len, sets), np.int64, n)
    root = {x: x for x in labels.tolist()}

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    tries = []
    for i in range(n - 1):
        j = np.arange(i + 1, n)
        j = j[(labels[j] != labels[i]) & (np.minimum(sizes[j], sizes[i]) * 100 >= percent * np.maximum(sizes[j], sizes[i]))]
        if left is not None and not left[i]:
            j = j[left[j]]
        if len(j):
            hits = (sigs[j] == sigs[i]).sum(1)
            good = hits >= MATCHES
            tries += zip(hits[good].tolist(), [i] * int(good.sum()), j[good].tolist(), strict=True)
    found = []
    for _, i, j in sorted(tries, reverse=True):
        a, b = find(labels[i].item()), find(labels[j].item())
        if a != b:
            if _confirmed(sets[i], sets[j], percent):
                root[a] = b
                found.append((i, j))
    return found


def _confirmed(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = np.concatenate((x, y))
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(both) - common)


def meet(pairs: DataFrame, sets: DataFrame, percent: int, keep: Scratch) -> DataFrame:
    """The pairs (node, pivot) that match; a pivot's partners are dealt into blocks, its own row goes to each of them."""
    blocks = keep.write(pairs.groupBy("pivot").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")), "near-blocks")
    left = pairs.join(blocks, "pivot").select("pivot", F.pmod(F.xxhash64("node"), "blocks").alias("block"), "node").join(sets, "node")
    right = blocks.select("pivot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"), F.col("pivot").alias("node")).join(sets, "node")

    def body(g: pd.DataFrame) -> Iterator[pd.DataFrame]:
        node, pivot = g["node"].to_numpy(), g["pivot"].iloc[0]
        own = int(np.flatnonzero(node == pivot)[0])
        sigs = np.stack([np.frombuffer(x, np.int32) for x in g["sig"]])
        one = np.frombuffer(g["set"].iloc[own], np.uint64)
        hits = (sigs == sigs[own]).sum(1) >= MATCHES
        hits[own] = False
        good = [i for i in np.flatnonzero(hits).tolist() if _confirmed(one, np.frombuffer(g["set"].iloc[i], np.uint64), percent)]
        if good:
            yield pd.DataFrame({"u": node[good], "v": pivot})

    rows = left.unionByName(right.select(*left.columns))
    return by_group(rows, ["pivot", "block"], body, "u bigint, v bigint")


def _label(nodes: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``nodes`` with the ``label`` of column node."""
    if labels is None:
        return nodes.withColumn("label", F.col("node"))
    return nodes.join(labels.select("node", F.col("label").alias("known")), "node", "left").withColumn("label", F.coalesce("known", "node")).drop("known")


def _most(percent: int) -> Column:
    return F.floor(F.col("n") * 100 / percent + 1e-6)


def _able(rows: DataFrame, keep: Scratch) -> DataFrame:
    """The rows of postings with several components, without nodes that no other size there fits."""
    some = rows.groupBy("value").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min("n").alias("least")).where("low <> high").select("value", "least")
    return keep.write(rows.join(some, "value").where("most >= least").drop("least"), "near-open")


def stars(postings: DataFrame, sets: DataFrame, links: DataFrame | None, labels: DataFrame | None, percent: int, keep: Scratch) -> tuple[DataFrame | None, DataFrame | None, DataFrame | None]:
    """Rounds of representatives over (value, node, n, most, weight): links, labels, and what is unfinished, with label.

    ``most`` is the largest set that the node can match through this posting.
    """
    active = _able(_label(postings, labels).withColumn("met", F.lit(False)), keep)
    for _ in range(ROUNDS):
        # not yet connected with an earlier pivot first, then the most central
        best = F.max(F.struct((~F.col("met")).alias("fresh"), "weight", "node", "n", "most", "label")).alias("p")
        pivots = active.groupBy("value").agg(best, F.count("*").alias("c"), F.min("label").alias("low"), F.max("label").alias("high")).where("c > 1 and low <> high")
        pivots = keep.write(pivots.select("value", F.col("p.node").alias("pivot"), F.col("p.n").alias("m"), F.col("p.most").alias("m_most"), F.col("p.label").alias("to")), "near-pivots")
        rows = keep.write(active.join(pivots, "value").where("node <> pivot"), "near-ties")
        fit = (F.col("m") <= F.col("most")) & (F.col("n") <= F.col("m_most"))
        pairs = keep.write(rows.where(fit & (F.col("label") != F.col("to"))).select("node", "pivot").distinct(), "near-pairs")
        found = meet(pairs, sets, percent, keep)
        links = keep.write(found if links is None else links.union(found), "near-links")
        labels = keep.adopt(components(links, "near-fine"))
        rest = _label(rows.drop("label", "m", "m_most", "to"), labels)
        to = labels.select(F.col("node").alias("pivot"), F.col("label").alias("to"))
        rest = rest.join(to, "pivot", "left").withColumn("met", F.col("met") | F.coalesce(F.col("label") == F.col("to"), F.lit(False))).drop("to", "pivot")
        active = _able(keep.write(rest, "near-rest"), keep)
        if not active.limit(1).count():
            return links, labels, None
    return links, labels, active.drop("met")


def rare_shingles(active: DataFrame, sets: DataFrame, percent: int, keep: Scratch) -> DataFrame:
    """The nodes of unfinished postings, posted under the rarest shingles of their sets."""
    nodes = keep.write(active.groupBy("node").agg(F.first("n").alias("n"), F.first("weight").alias("weight")), "near-stubborn")

    def spell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for a in range(0, len(b), 64):
                part = [np.frombuffer(x, np.int64) for x in b["set"].iloc[a : a + 64]]
                yield pd.DataFrame({"node": np.repeat(b["node"].iloc[a : a + 64].to_numpy(), [len(x) for x in part]), "value": np.concatenate(part)})

    spelt = keep.write(nodes.join(sets, "node").select("node", "set").mapInPandas(spell, "node bigint, value bigint"), "near-spelt")
    shared = spelt.groupBy("value").count().where("count > 1")
    all_ = spelt.join(shared, "value").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("count", "value"))).alias("all"))
    # the shingles that a node has alone come first and are posted nowhere
    alone = F.col("n") - F.size("all")
    prefix = F.slice("all", F.lit(1), F.greatest(F.floor(F.col("n") * (100 - percent) / 100) + 1 - alone, F.lit(0)).cast("int"))
    posted = all_.join(nodes, "node").select("node", "n", "weight", alone.alias("alone"), F.posexplode(prefix).alias("i", "p"))
    # a pair meets at the first shingle that both have, so none of those before it is common
    most = F.floor((F.col("n") - F.col("alone") - F.col("i")) * (100 + percent) / percent + 1e-6) - F.col("n")
    return keep.write(posted.select("p.value", "node", "n", F.least(most, _most(percent)).alias("most"), "weight"), "near-rare")


def _links(rows: DataFrame, percent: int) -> DataFrame:
    """(u, v) found within each group (g1, g2, g3) of rows (.., node, label, left, sig, set)."""

    def body(g: pd.DataFrame) -> Iterator[pd.DataFrame]:
        left = g["left"].to_numpy(bool)
        sigs, sets = np.stack([np.frombuffer(x, np.int32) for x in g["sig"]]), [np.frombuffer(x, np.uint64) for x in g["set"]]
        found = link_block(g["label"].to_numpy(), sigs, sets, percent, None if left.all() else left)
        node = g["node"].to_numpy()
        if found:
            yield pd.DataFrame({"u": [node[i] for i, _ in found], "v": [node[j] for _, j in found]})

    return by_group(rows, ["g1", "g2", "g3"], body, "u bigint, v bigint")


def in_blocks(active: DataFrame, sets: DataFrame, percent: int, keep: Scratch) -> DataFrame:
    """Links between the nodes outside the largest component of an unfinished posting and all others of the posting."""
    main = active.groupBy("value", "label").count().groupBy("value").agg(F.max_by("label", "count").alias("main"), F.ceil(F.sum("count") / BLOCK).alias("blocks"))
    state = keep.write(active.join(main, "value").select("value", "node", "label", "blocks", (F.col("label") != F.col("main")).alias("left")), "near-state")
    outside = state.where("left").groupBy("value").agg(F.ceil(F.count("*") / BLOCK).alias("lefts"))
    state = state.join(outside, "value").withColumn("right_block", F.pmod(F.xxhash64("node"), "blocks")).withColumn("left_block", F.pmod(F.xxhash64("node"), "lefts"))
    # each node as itself against every block of outsiders; each outsider in addition against every block of nodes
    zero = F.lit(0).cast("bigint")
    rights = state.select(F.col("value").alias("g1"), F.explode(F.sequence(zero, F.col("lefts") - 1)).alias("g2"), F.col("right_block").alias("g3"), "node", "label", F.lit(False).alias("left"))
    lefts = state.where("left").select(F.col("value").alias("g1"), F.col("left_block").alias("g2"), F.explode(F.sequence(zero, F.col("blocks") - 1)).alias("g3"), "node", "label", F.lit(True).alias("left"))
    return _links(rights.union(lefts).join(sets, "node"), percent)


def near_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, t1, t2) for every row; t1, t2 hash its text."""
    spark = docs.sparkSession
    ship(spark)
    keep = Scratch()
    t = F.col(f"`{text}`")
    keyed = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(t).alias("t1"), F.xxhash64(F.lit(7), t).alias("t2"), t.alias("text"))
    kind = keyed.schema["doc_id"].dataType.simpleString()

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for b in batches:
            sets = shingle_sets([_bytes(x) for x in b["text"]], words)
            digests = np.array([np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64) for s in sets]).reshape(-1, 2)
            sig = signatures(sets)
            yield pd.DataFrame({"doc_id": b["doc_id"], "t1": b["t1"], "t2": b["t2"], "n": [len(s) for s in sets], "d1": digests[:, 0], "d2": digests[:, 1], "sig": list(sig)})

    signed = keep.write(keyed.mapInPandas(sign, f"doc_id {kind}, t1 bigint, t2 bigint, n bigint, d1 bigint, d2 bigint, sig array<int>"), "near-signed")
    full = signed.where("n > 0")
    nodes = full.groupBy("d1", "d2").agg(F.min("doc_id").alias("low"), F.min(F.struct("t1", "t2")).alias("lead"), F.first(F.struct("doc_id", "t1", "t2", "n", "sig")).alias("one"))
    nodes = keep.write(nodes.select(F.monotonically_increasing_id().alias("node"), "d1", "d2", "low", "lead", "one.*"), "near-nodes")

    # coordinate-value pairs that several nodes have, rarest first, and the prefix of each node
    posted = nodes.select("node", "n", F.posexplode("sig").alias("k", "x")).select("node", "n", F.xxhash64("k", "x").alias("value"))
    shared = keep.write(posted.groupBy("value").count().where("count > 1"), "near-shared")
    mine = posted.join(shared, "value").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("count", "value"))).alias("all"), F.sum("count").alias("weight"))
    # of the first COORDINATES - MATCHES + 1 in the order of frequency, the unshared come first
    prefix = F.slice("all", 1, F.greatest(F.size("all") - (MATCHES - 1), F.lit(0)))
    postings = keep.write(mine.where(F.size("all") >= MATCHES).select("node", "n", "weight", F.explode(prefix).alias("p")).select("p.value", "node", "n", "weight"), "near-postings")
    pairable = postings.groupBy("value").count().where("count > 1").select("value")
    postings = keep.write(postings.join(pairable, "value").withColumn("most", _most(percent)), "near-collisions")

    # the full sets of the nodes that collide with any, and their signatures
    who = postings.select("node").distinct().join(nodes, "node").select("node", "sig", F.col("doc_id").alias("id_"), F.col("t1").alias("t1_"), F.col("t2").alias("t2_"))
    who = keep.write(who, "near-members")
    wanted = keyed.join(who, F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("t1") == F.col("t1_")) & (F.col("t2") == F.col("t2_")))
    wanted = wanted.groupBy("node").agg(F.first("sig").alias("sig"), F.first("text").alias("text"))  # once, however often the row is repeated

    def collect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = shingle_sets([_bytes(x) for x in b["text"]], words)
            yield pd.DataFrame({"node": b["node"], "sig": [np.asarray(x, np.int32).tobytes() for x in b["sig"]], "set": [s.tobytes() for s in sets]})

    sets = keep.write(wanted.mapInPandas(collect, "node bigint, sig binary, set binary"), "near-sets")
    links, labels, active = stars(postings, sets, None, None, percent, keep)
    if active is not None:
        links, labels, active = stars(rare_shingles(active, sets, percent, keep), sets, links, labels, percent, keep)
    if active is not None:
        labels = keep.adopt(components(keep.write(links.union(in_blocks(active, sets, percent, keep)), "near-links"), "near-fine"))

    where = keep.write(_label(nodes, labels).select("d1", "d2", "low", "lead", "label"), "near-where")
    lowest = where.groupBy("label").agg(F.min("low").alias("component_id"), F.min("lead").alias("first"))
    named = keep.write(where.join(lowest, "label").select(F.col("d1").alias("d1_"), F.col("d2").alias("d2_"), "component_id", "first"), "near-named")
    out = signed.select("doc_id", "t1", "t2", "n", "d1", "d2").join(named, (F.col("d1") == F.col("d1_")) & (F.col("d2") == F.col("d2_")), "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    # where no row has an id, the text of the smallest hashes stands for the component
    kept = F.when(F.col("n") == 0, True).when(F.col("component_id").isNull(), F.struct("t1", "t2") == F.col("first")).otherwise(F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    out = materialise(out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"), "t1", "t2"), "near-result")
    keep.clear()
    return out


def op3_near_dedup(spark, sf_dir: str) -> DataFrame:
    """The whole documents table, four-word shingles."""
    return near_dedup(table(spark, sf_dir, "documents"), words=4).select("doc_id", "n_shingles", "component_id", "kept")
