"""Embedding near-dedup by product quantisation with inverted lists.

Vectors are scaled by their largest component, so that no square over- or underflows, and then normalised; equal vectors of a
label are one class with a weight from here on. Coarse centroids (k-means of the unit vectors) and residual subspace codebooks are fitted
on a bounded sample (``SAMPLE_ROWS`` classes by hash order). Every class is coded: its nearest centroid, a byte for ``PART`` components.

A label of at most ``EXACT_ROWS`` classes has the centroids' lists. A class stands in its own and asks in those whose bisecting plane
with its own is no farther than the radius of the similarity and whose number is higher: any pair within the radius meets in the
list of one of the two, once. No link is lost.

On vectors without clusters nearly every plane is within the radius, so this is quadratic, and larger labels have overlapping lists
instead: random directions, drawn without regard to the data, and a class stands in all whose product with it is ``reach``
or more. Their number is such that a pair at the similarity has no list in common with a chance of ``MISS`` (closer pairs with
less), whatever the vectors; work and copies then grow with the table. A pair counts in its first common list.

Lists are compared by codes alone: ids and codes are all that is copied. Two codes' distance less both coding errors is a lower
bound, so candidates lose nothing. Only vectors with a candidate are fetched, and their links found by exact cosine in double precision.

A list of more than ``BLOCK`` classes is compared in units of two blocks. A unit returns each vector's number of links and the
spanning links of its local components, never its pairs; a dense group costs the square of its size.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components, and rows with a null label, link
with nothing and are kept; vectors of different length are not compared; equal vectors are linked; repeated rows (equal
ids) count as separate vectors; finite vectors of any size are compared by direction alone; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.session import discard, ship

from .common import components, table
from .common import materialise as written

SIMILARITY = 0.93
SAMPLE_ROWS = 16_384
#: Classes of a centroid's list, at the mean of the largest label that has such lists.
LIST_ROWS = 8192
#: Larger labels have overlapping lists, of about so many classes, in directions of at most this reach.
EXACT_ROWS = 65_536
OVERLAP_ROWS, MOST_REACH, MISS = 2048, 3.0, 1e-6
#: With such labels, lists are compared in so many rounds, one after another.
OVERLAP_ROUNDS = 2
PART, CODES, FIT_ROWS = 3, 256, 4096
BLOCK = 8192
TILE = 256


def materialise(df: DataFrame, name: str) -> DataFrame:
    """``materialise`` whose shuffle files go with the write that made them, not when the driver next collects garbage."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = conf.get(key, None)
    conf.set(key, "true")
    try:
        return written(df, name)
    finally:
        conf.unset(key) if was is None else conf.set(key, was)


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = np.argmin((c**2).sum(1) - 2 * x @ c.T, 1)
        sums = np.stack([np.bincount(near, col, len(c)) for col in x.T], 1)
        n = np.bincount(near, minlength=len(c))
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def units(e) -> np.ndarray:
    """The vectors at length one, whatever their size: from the smallest to the largest doubles."""
    x = np.stack(e).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Quantiser:
    """Coarse centroids and residual codebooks for one length of vectors."""

    def __init__(self, sample: np.ndarray, lists: int):
        self.centroids = kmeans(sample, lists)
        residual = (sample - self.centroids[self.nearest(sample)])[:FIT_ROWS]
        dim = sample.shape[1]
        self.parts = [(a, min(a + PART, dim)) for a in range(0, dim, PART)]
        self.books = [kmeans(residual[:, a:b], CODES, rounds=5, seed=11 + a) for a, b in self.parts]
        #: a code's bytes: number of the centroid, distance of the vector from its code (rounded up), a byte for each part
        self.form = np.dtype([("home", "<u2"), ("miss", "<f4"), ("codes", "u1", (len(self.parts),))])

    def nearest(self, x: np.ndarray) -> np.ndarray:
        return np.argmin((self.centroids**2).sum(1) - 2 * x @ self.centroids.T, 1)

    def code(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x), self.form)
        out["home"] = self.nearest(x)
        residual = x - self.centroids[out["home"]]
        residual = np.hstack((residual, np.ones((len(x), 1)))).astype(np.float32)
        for m, ((a, b), book) in enumerate(zip(self.parts, self.books, strict=True)):
            out["codes"][:, m] = np.argmin(residual[:, [*range(a, b), -1]] @ np.vstack((-2 * book.T, (book**2).sum(1))).astype(np.float32), 1)
        out["miss"] = np.sqrt(((x - self.decode(out)) ** 2).sum(1)) * (1 + 1e-6) + 1e-7
        return out

    def decode(self, codes: np.ndarray) -> np.ndarray:
        x = self.centroids[codes["home"]]
        for m, ((a, b), book) in enumerate(zip(self.parts, self.books, strict=True)):
            x[:, a:b] += book[codes["codes"][:, m]]
        return x

    def probes(self, x: np.ndarray, home: np.ndarray, radius: float) -> list[np.ndarray]:
        """A row's own list, and those of higher number whose bisecting plane with it is within the radius; rounding only adds to them."""
        c = self.centroids
        d = (c**2).sum(1) - 2 * x @ c.T
        own, at = np.unique(home, return_inverse=True)
        apart = np.stack([np.sqrt(((c - c[h]) ** 2).sum(1)) for h in own])[at]
        near = d - d[np.arange(len(x)), home][:, None] <= 2 * apart * (radius + 1e-9) + 1e-12
        near &= np.arange(len(c)) > home[:, None]
        near[np.arange(len(x)), home] = True
        return [np.flatnonzero(row) for row in near]

    def sides(self, codes: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows whose products are (radius + both misses)^2 - (distance of the codes)^2, as left and as right sides."""
        x, miss = self.decode(codes), codes["miss"].astype(np.float64)[:, None]
        r, size, one = radius + miss, (x**2).sum(1, keepdims=True), np.ones((len(x), 1))
        return np.hstack((2 * x, 2 * r, r**2 - size, one)).astype(np.float32), np.hstack((x, miss, one, miss**2 - size)).astype(np.float32)


def by_unit(df: DataFrame, keys: list[str], body, schema: str) -> DataFrame:
    """``body`` over the rows of each unit as one Arrow table; a unit of many batches is joined once."""
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)

    def run(batches):
        held = []
        for b in batches:
            if not b.num_rows:
                continue
            new = np.zeros(b.num_rows, bool)
            new[0] = bool(held) and any(b.column(k)[0] != held[-1].column(k)[0] for k in keys)
            for k in keys:
                new[1:] |= pc.not_equal(b.column(k).slice(1), b.column(k).slice(0, b.num_rows - 1)).to_numpy(zero_copy_only=False)
            ends = [*np.flatnonzero(new).tolist(), b.num_rows]
            if ends[0]:
                held.append(b.slice(0, ends[0]))
            for a, e in zip(ends[:-1], ends[1:], strict=True):
                if held:
                    yield from body(pa.Table.from_batches(held))
                held = [b.slice(a, e - a)]
        if held:
            yield from body(pa.Table.from_batches(held))

    return df.repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def sided(t: pa.Table) -> tuple[pa.Table, int, bool]:
    """A unit's rows, left ones first; how many these are; whether they are compared among themselves."""
    first, node = t["first"].to_numpy(), t["node"].to_numpy()
    return t.take(np.lexsort((node, ~first))), int(first.sum()), t["i"][0] == t["j"][0]


def upper(t: float) -> float:
    return math.erfc(t / math.sqrt(2)) / 2


class Directions:
    """Overlapping lists for labels of ``n`` classes: random directions, enough that a pair misses all with chance ``MISS``."""

    def __init__(self, dim: int, n: int, similarity: float):
        grid = np.linspace(0, 8, 4001)
        self.reach = min(MOST_REACH, next((t for t in grid.tolist() if upper(t) <= OVERLAP_ROWS / n), MOST_REACH))
        a = np.linspace(self.reach, self.reach + 10, 20_001)
        s = math.sqrt(max(1 - similarity**2, 1e-12))
        both = np.exp(-(a**2) / 2) / math.sqrt(2 * math.pi) * [upper((self.reach - similarity * v) / s) for v in a.tolist()]
        self.lists = math.ceil(math.log(1 / MISS) / (((both[:-1] + both[1:]) / 2).sum() * (a[1] - a[0])))
        self.at = np.random.default_rng(23).standard_normal((self.lists, dim)).astype(np.float32)

    def lists_of(self, x: np.ndarray) -> list[np.ndarray]:
        """Ascending numbers of the lists in which each row stands."""
        rows, cols = np.nonzero(x.astype(np.float32) @ self.at.T >= self.reach)
        return np.split(cols, np.searchsorted(rows, np.arange(1, len(x))))


def tiles(n_left: int, n_right: int, within: bool):
    """(first left row, columns from): sides are the left rows themselves, where ``within``, and then the right rows."""
    for a in range(0, n_left, TILE):
        yield a, min(a + TILE, n_left), (a if within else n_left), n_left + n_right


def candidates(left: np.ndarray, left_again: np.ndarray, right: np.ndarray, within: bool) -> np.ndarray:
    """Which rows, left ones first, have a candidate at all."""
    alive, cols = np.zeros(len(left) + len(right), bool), np.vstack((left_again, right))
    for a, b, c0, c1 in tiles(len(left), len(right), within):
        for c in range(c0, c1, 1024):
            near = left[a:b] @ cols[c : min(c + 1024, c1)].T
            if within and c < b:  # no row with itself
                k = np.arange(max(a, c), min(b, c + 1024))
                near[k - a, k - c] = -1
            if near.max(initial=-1) >= -1e-4:
                hit = near >= -1e-4
                alive[a:b] |= hit.any(1)
                alive[c : c + hit.shape[1]] |= hit.any(0)
    return alive


def shared(mine: list[np.ndarray], theirs: list[np.ndarray]) -> np.ndarray:
    """Which rows have a number in common."""
    both = np.intersect1d(np.concatenate(mine), np.concatenate(theirs))

    def marks(lists):
        out = np.zeros((len(lists), len(both)), np.float32)
        for k, x in enumerate(lists):
            at = np.searchsorted(both, x)
            fits = at < len(both)
            at, x = at[fits], x[fits]
            out[k, at[both[at] == x]] = 1
        return out

    return marks(mine) @ marks(theirs).T > 0.5


def links(x: np.ndarray, node: np.ndarray, w: np.ndarray, n_left: int, within: bool, similarity: float, earlier: list[np.ndarray] | None):
    """(nodes, a node of the same component, links by weight) of one unit; earlier: for each row, its lists before this one."""
    n, top, big = np.zeros(len(x), np.int64), node.astype(np.int64).copy(), np.int64(2**63 - 1)
    us, vs = [], []
    for a, b, c0, c1 in tiles(n_left, len(x) - n_left, within):
        linked = x[a:b] @ x[c0:c1].T >= similarity
        if within:  # each pair once, and no row with itself
            linked[:, : n_left - c0] &= np.arange(c0, n_left) > np.arange(a, b)[:, None]
        rows, cols = np.flatnonzero(linked.any(1)), np.flatnonzero(linked.any(0))
        if not len(rows):
            continue
        part, rows, cols = linked[np.ix_(rows, cols)], rows + a, cols + c0
        own = part if earlier is None else part & ~shared([earlier[k] for k in rows], [earlier[k] for k in cols])
        n[rows] += own @ w[cols]
        n[cols] += own.T @ w[rows]
        both = np.union1d(rows, cols)
        was = top[both]
        while True:
            before = top[both]
            top[cols] = np.minimum(top[cols], np.where(part, top[rows][:, None], big).min(0))
            top[rows] = np.minimum(top[rows], np.where(part, top[cols][None, :], big).min(1))
            if (before == top[both]).all():
                break
        new = both[top[both] != was]
        us.append(node[new])
        vs.append(top[new])
    counted = np.flatnonzero(n)
    us, vs = np.concatenate((*us, node[counted])), np.concatenate((*vs, node[counted]))
    return us.astype(np.int64), vs.astype(np.int64), np.concatenate((np.zeros(len(us) - len(counted), np.int64), n[counted]))


def near_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", similarity: float = SIMILARITY) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""
    spark = vectors.sparkSession
    ship(spark)
    single = isinstance(getattr(vectors.schema[embedding].dataType, "elementType", None), T.FloatType)
    kind = np.float32 if single else np.float64
    e = F.col(f"`{embedding}`").cast("array<float>" if single else "array<double>")
    rows = vectors.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{label}`").alias("label"), e.alias("e"))
    fine = F.col("label").isNotNull() & F.col("e").isNotNull() & (F.size("e") > 0) & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("e", lambda x: x != 0)
    # equal vectors are one class, by 128 bits; 0.0 is added so that both zeros are one
    key = F.when(F.coalesce(fine, F.lit(False)), F.transform("e", lambda x: x + F.lit(0).cast("float" if single else "double")))
    keyed = rows.withColumn("key", key).withColumn("k1", F.xxhash64("label", "key")).withColumn("k2", F.xxhash64(F.lit(7), "label", "key"))
    classes = keyed.where("key is not null").groupBy("k1", "k2").agg(F.count("*").alias("w"), F.min("vec_id").alias("low"), F.first(F.struct("label", "e")).alias("one"))
    classes = classes.select("k1", "k2", "w", "low", F.col("one.label").cast("string").alias("label"), F.col("one.e").alias("e"))

    def pack(batches):
        for b in batches:
            e = b.column("e")
            at = np.asarray(e.offsets)
            raw = pa.py_buffer(np.ascontiguousarray(e.values.to_numpy(zero_copy_only=False), kind))
            vec = pa.Array.from_buffers(pa.binary(), len(e), [None, pa.py_buffer((at * np.dtype(kind).itemsize).astype(np.int32)), raw])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(np.diff(at).astype(np.int32)), vec], names=[*b.schema.names[:-1], "dim", "vec"])

    low = T._parse_datatype_string("k1 long, k2 long, w long").fields + [T.StructField("low", classes.schema["low"].dataType)]
    packed = T.StructType(low + T._parse_datatype_string("label string, dim int, vec binary").fields)
    classes = materialise(classes.mapInArrow(pack, packed).select(F.monotonically_increasing_id().alias("node"), "*"), "vec-classes")

    def unpacked(vec) -> np.ndarray:
        return units(np.frombuffer(b"".join(vec), kind).reshape(len(vec), -1))

    per_label = classes.groupBy("dim", "label").agg(F.count("*").alias("n"))
    sizes = per_label.groupBy("dim").agg(F.max(F.when(F.col("n") <= EXACT_ROWS, F.col("n"))), F.max("n")).collect()  # one row per length of vectors
    wide = {(r["dim"], r["label"]) for r in per_label.where(F.col("n") > EXACT_ROWS).collect()}  # one row per EXACT_ROWS classes at most
    fitted = {}
    for dim, most, all_ in sizes:
        sample = classes.where(F.col("dim") == dim).orderBy(F.xxhash64("k1"), "k1", "k2").limit(SAMPLE_ROWS).select("vec").toPandas()
        x = unpacked(sample["vec"])
        lists = max(1, min(-(-(most or EXACT_ROWS) // LIST_ROWS), len(x), 1 << 16))
        fitted[dim] = Quantiser(x, lists), (Directions(dim, all_, similarity) if all_ > EXACT_ROWS else None)
    sent = spark.sparkContext.broadcast(fitted)  # bounded by SAMPLE_ROWS, EXACT_ROWS and MOST_REACH
    radius = float(np.sqrt(2 - 2 * similarity))

    def place(batches):
        for b in batches:
            for dim, g in b.groupby("dim"):
                q, directions = sent.value[dim]
                for a in range(0, len(g), 1024):
                    p = g.iloc[a : a + 1024]
                    x = unpacked(p["vec"])
                    codes = q.code(x)
                    over = np.array([(dim, v) in wide for v in p["label"]])
                    lists = np.empty(len(x), object)
                    for which, stand in ((over, lambda k: directions.lists_of(x[k])), (~over, lambda k: q.probes(x[k], codes["home"][k].astype(np.int64), radius))):  # noqa: B023
                        for k, v in zip(np.flatnonzero(which), stand(which) if which.any() else (), strict=True):
                            lists[k] = v.astype(np.int32)
                    yield pd.DataFrame({"node": p["node"].to_numpy(), "label": p["label"].to_numpy(), "dim": dim, "home": np.where(over, -1, codes["home"].astype(np.int64)), "code": [c.tobytes() for c in codes], "lists": list(lists)})

    placed = materialise(classes.select("node", "label", "dim", "vec").mapInPandas(place, "node bigint, label string, dim int, home int, code binary, lists array<int>"), "vec-placed")
    member = (F.col("home") < 0) | (F.col("home") == F.col("list"))
    common = ["label", "dim", "list"]
    rounds = OVERLAP_ROUNDS if wide else 1

    def entries(*nth: int) -> DataFrame:
        lists = F.filter("lists", lambda v: F.pmod(v, F.lit(rounds)).isin(*nth)) if rounds > 1 else F.col("lists")
        return placed.select("node", "label", "dim", "home", "code", F.explode(lists).alias("list")).withColumn("member", member)

    cells = entries(*range(rounds)).groupBy(*common).agg(F.count("*").alias("n"), F.count_if("member").alias("members")).where(F.col("n") > BLOCK)
    cells = materialise(cells.select(*common, F.ceil(F.col("members") / BLOCK).cast("int").alias("mb"), F.ceil((F.col("n") - F.col("members")) / BLOCK).cast("int").alias("ab")), "vec-cells")
    # lists of one unit need no row there; the others are at most one for BLOCK entries
    zero = F.lit(0)
    block = F.when(F.col("mb").isNull(), zero).when(F.col("member"), F.pmod(F.xxhash64("node"), "mb")).otherwise(F.col("mb") + F.pmod(F.xxhash64("node"), F.greatest("ab", F.lit(1)))).cast("int")
    none = F.array().cast("array<struct<i:int,j:int>>")
    pairs = lambda lo, hi, f: F.when(hi >= lo, F.transform(F.sequence(lo, F.greatest(lo, hi)), f)).otherwise(none)
    first = pairs(F.col("b"), F.col("mb") + F.col("ab") - 1, lambda k: F.struct(F.col("b").alias("i"), k.alias("j")))
    second = pairs(zero, F.when(F.col("member"), F.col("b")).otherwise(F.col("mb")) - 1, lambda k: F.struct(k.alias("i"), F.col("b").alias("j")))
    alone = F.array(F.struct(zero.alias("i"), zero.alias("j")))
    at = F.when(F.col("mb").isNull(), alone).when(F.col("member"), F.concat(first, second)).otherwise(second)
    unit = [*common, "i", "j"]

    def dealt(nth: int) -> DataFrame:
        out = entries(nth).join(F.broadcast(cells), common, "left").withColumn("b", block).select(*common, "b", "member", "node", "code", F.explode(at).alias("at"))
        return out.select(*common, F.col("at.i").alias("i"), F.col("at.j").alias("j"), (F.col("member") & (F.col("b") == F.col("at.i"))).alias("first"), "node", "code")

    def sift(t: pa.Table):
        if len(t) < 2 or not pc.any(t["first"]).as_py():
            return
        q, _ = sent.value[t["dim"][0].as_py()]
        t, n, within = sided(t.select([*unit, "first", "node", "code"]))
        left, right = q.sides(np.frombuffer(b"".join(t["code"].to_pylist()), q.form), radius)
        alive = candidates(left[:n], right[:n], right[n:], within)
        if alive.any():
            yield from t.drop_columns("code").filter(pa.array(alive)).to_batches()

    def confirm(t: pa.Table):
        t, n, within = sided(t)
        earlier, list_ = None, t["list"][0].as_py()
        if t["lists"].null_count == 0:
            earlier = [v[v < list_] for v in (np.asarray(v, np.int32) for v in t["lists"].to_pylist())]
        u, v, count = links(unpacked(t["vec"].to_pylist()), t["node"].to_numpy(), t["w"].to_numpy(), n, within, similarity, earlier)
        if len(u):
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(count)], names=["u", "v", "n"])

    parts = []
    for nth in range(rounds):  # a part of the lists at a time: so much less lies on disk at once
        kept = materialise(by_unit(dealt(nth), unit, sift, "label string, dim int, list int, i int, j int, first boolean, node bigint"), "vec-candidates")
        fetched = kept.join(classes.select("node", "w", "vec"), "node").join(placed.select("node", F.when(F.col("home") < 0, F.col("lists")).alias("lists")), "node")
        parts.append(materialise(by_unit(fetched, unit, confirm, "u bigint, v bigint, n bigint"), "vec-links"))
        discard(kept)
    discard(placed, cells)
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    counts = found.groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("others"))
    comp = components(found.select("u", "v"), "vec")
    named = classes.select("node", "k1", "k2", "w", "low").join(counts, "node", "left").join(comp, "node", "left")
    named = named.select("k1", "k2", "w", "low", F.coalesce("others", F.lit(0)).alias("others"), F.coalesce("label", "node").alias("comp"))
    named = materialise(named, "vec-named")
    discard(classes, *parts, comp)
    lowest = materialise(named.groupBy("comp").agg(F.min("low").alias("component_id")), "vec-lowest")
    final = materialise(named.join(lowest, "comp").select(F.col("k1").alias("k1_"), F.col("k2").alias("k2_"), (F.col("w") - 1 + F.col("others")).alias("n_links"), "component_id"), "vec-final")
    discard(named, lowest)
    out = keyed.select("vec_id", "k1", "k2", F.col("key").isNotNull().alias("some")).join(final, F.col("some") & (F.col("k1") == F.col("k1_")) & (F.col("k2") == F.col("k2_")), "left")
    component = F.coalesce(F.col("component_id"), F.col("vec_id")).cast("bigint")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op7_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
