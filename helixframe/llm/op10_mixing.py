"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree (DataFrame functions only).

1. Words are counted for every document; sources get their totals, weights and targets. Targets follow by water-filling:
   ``min(level * weight, 2 * size)`` with the one level that uses up the whole budget. That is what capping and resharing
   by weight, repeated until no source is above its cap, ends with.
2. A source's documents fall into blocks by a seeded hash, so the block number is itself a random permutation. Whole passes
   over the source and then its first blocks are taken, while they fit the target. In the one block where the target
   ends, documents are taken from the largest down while they fit, so the rest left over is smaller than what one more
   document would add.
3. Each source's drawn blocks are a quota. A binary tree over the output shards splits the quotas of all sources at once:
   at every node the left half of the shards gets a multivariate-hypergeometric draw (conditional hypergeometrics source
   by source, by inverse distribution from a seeded uniform number). The leaves give each shard its exact number of blocks
   of every source, as disjoint ranges of the permutation. Within a shard, rows are ordered by a seeded hash.

Defined cases: null or empty text has size 0 and is never taken; a null source is a source of its own, ordered last;
an empty table gives an empty result; repeated rows are separate rows; a source with no words has target 0; a null
doc_id hashes as a value of its own. The number of sources is taken to be small enough for one task to hold one row per
source (millions), never their documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialise, table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SEED = 20240607
#: Documents of a block, at the mean, and blocks of a source at most; more documents make blocks larger.
BLOCK_DOCS = 128
MOST_BLOCKS = 1 << 14
#: The draws look at so many standard deviations around the mean; what lies beyond is below the precision of doubles.
SIGMAS = 40


def _uniform(*parts: Column | str) -> Column:
    """A number in (0, 1) from a hash."""
    return (F.pmod(F.xxhash64(F.lit(SEED), *parts), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def _hypergeometric(n: Column, good: Column, total: Column, u: Column) -> Column:
    """How many of ``good`` marked ones fall into ``n`` drawn from ``total``, by the inverse distribution at ``u``."""
    given = F.struct(n.cast("double").alias("n"), good.cast("double").alias("g"), total.cast("double").alias("t"), u.alias("u"))

    def support(v):
        mean = v["n"] * v["g"] / F.greatest(v["t"], F.lit(1.0))
        sd = F.sqrt(F.greatest(mean * (1 - v["g"] / F.greatest(v["t"], F.lit(1.0))), F.lit(0.0))) + 1
        low = F.ceil(F.greatest(F.lit(0.0), v["n"] + v["g"] - v["t"], mean - SIGMAS * sd))
        high = F.floor(F.least(v["n"], v["g"], mean + SIGMAS * sd))
        return F.struct(v["n"].alias("n"), v["g"].alias("g"), v["t"].alias("t"), v["u"].alias("u"), low.alias("low"), high.alias("high"))

    def logs(v):  # log p(x) / p(low) for x from low to high, and their largest
        ratio = lambda x: F.log((v["g"] - x + 1) * (v["n"] - x + 1)) - F.log(x * (v["t"] - v["g"] - v["n"] + x))
        steps = F.when(v["high"] > v["low"], F.transform(F.sequence(v["low"] + 1, v["high"]), lambda x: ratio(x.cast("double")))).otherwise(F.array().cast("array<double>"))
        start = F.struct(F.lit(0.0).alias("at"), F.lit(0.0).alias("top"), F.array(F.lit(0.0)).alias("all"))
        step = lambda a, r: _let(a["at"] + r, lambda x: F.struct(x.alias("at"), F.greatest(a["top"], x).alias("top"), F.concat(a["all"], F.array(x)).alias("all")))
        return F.struct(v["low"].alias("low"), v["high"].alias("high"), v["u"].alias("u"), F.aggregate(steps, start, step).alias("x"))

    def weights(v):
        return F.struct(v["low"].alias("low"), v["high"].alias("high"), v["u"].alias("u"), F.transform(v["x"]["all"], lambda x: F.exp(x - v["x"]["top"])).alias("w"))

    def choice(v):
        aim = v["u"] * F.aggregate(v["w"], F.lit(0.0), lambda a, x: a + x)
        start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).cast("bigint").alias("k"))
        walk = lambda aimed: F.aggregate(v["w"], start, lambda a, x: _let(a["sum"] + x, lambda c: F.struct(c.alias("sum"), (a["k"] + F.when(c < aimed, 1).otherwise(0)).alias("k"))))["k"]
        return F.least(v["low"] + _let(aim, walk), v["high"]).cast("bigint")

    return _let(_let(_let(_let(given, support), logs), weights), choice)


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, docs) -> with target: water-filled shares of ``share`` times all sizes.

    One row per source; these windows hold sources only.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("w", w).withColumn("cap", most * F.col("source_size").cast("double"))
    everything = Window.partitionBy()
    by_cap = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source"))
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("budget", share * F.sum("source_size").over(everything))
    s = s.withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("open", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    # the level if this source and all with larger caps stay open; the first that stays below its cap has the true one
    s = s.withColumn("level", (F.col("budget") - F.col("capped")) / F.col("open"))
    s = s.withColumn("true", F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level"))).over(everything))
    fits = Window.partitionBy().orderBy(F.when(F.col("level") * F.col("w") <= F.col("cap"), 0).otherwise(1), F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source"))
    level = F.first("level").over(fits)
    some = F.max(F.when(F.col("level") * F.col("w") <= F.col("cap"), 1).otherwise(0)).over(everything)
    return s.select("source", "source_size", "docs", F.when(some == 1, F.least(level * F.col("w"), F.col("cap"))).otherwise(F.col("cap")).alias("target"))


def split_tree(quotas: DataFrame, shards: int) -> DataFrame:
    """(source, quota) -> (source, counts): how many of a source's drawn blocks each of ``shards`` output shards gets.

    Counts of a source add up to its quota and shards differ in total by the rounding of halves only.
    """
    nodes = quotas.agg(F.sort_array(F.collect_list(F.struct(F.col("source").isNotNull().alias("known"), "source", "quota"))).alias("s")).select(F.lit(1).cast("bigint").alias("node"), "s")
    for _ in range(shards.bit_length() - 1):
        total = F.aggregate("s", F.lit(0).cast("bigint"), lambda a, x: a + x["quota"])
        nodes = nodes.withColumn("total", total).withColumn("left", F.floor((F.col("total") + F.when(_uniform("node") < 0.5, 0).otherwise(1)) / 2).cast("bigint"))
        start = F.struct(F.col("left").alias("n"), F.col("total").alias("of"), F.array().cast("array<bigint>").alias("drawn"))

        def draw(a, x):
            one = _hypergeometric(a["n"], x["quota"], a["of"], _uniform("node", x["source"]))
            return F.transform(F.array(one), lambda k: F.struct((a["n"] - k).alias("n"), (a["of"] - x["quota"]).alias("of"), F.concat(a["drawn"], F.array(k)).alias("drawn")))[0]

        nodes = nodes.withColumn("drawn", F.aggregate("s", start, draw)["drawn"])
        part = lambda take: F.zip_with("s", "drawn", lambda x, k: F.struct(x["known"].alias("known"), x["source"].alias("source"), take(x, k).alias("quota")))
        children = F.array(
            F.struct((F.col("node") * 2).alias("node"), part(lambda x, k: k).alias("s")),
            F.struct((F.col("node") * 2 + 1).alias("node"), part(lambda x, k: x["quota"] - k).alias("s")),
        )
        nodes = nodes.select(F.explode(children).alias("c")).select("c.node", "c.s")
    leaves = nodes.select("node", F.explode("s").alias("x")).select("node", "x.source", "x.quota")
    return leaves.groupBy("source").agg(F.transform(F.sort_array(F.collect_list(F.struct("node", "quota"))), lambda x: x["quota"]).alias("counts"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", shards: int = 16, weights=WEIGHTS, share: float = SHARE, most: float = MOST, keep_row: bool = False) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, copies, taken, places.

    ``places`` has one (shard, place) per copy; sorting a shard's rows by place shuffles it. With ``keep_row`` the whole
    input row comes along as struct ``row``.
    """
    if shards < 1 or shards & (shards - 1):
        raise ValueError("shards must be a power of two")
    size = F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)), F.lit(0)).cast("bigint")
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if keep_row else []
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), size.alias("size"), *row)
    rows = rows.withColumn("key", F.xxhash64(F.lit(SEED), "doc_id", "size"))
    slim = materialise(rows.select("doc_id", "source", "size", "key"), "mix-sizes")
    aims = targets(slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs")), weights, share, most)
    aims = aims.withColumn("blocks", F.least(F.greatest(F.ceil(F.col("docs") / BLOCK_DOCS), F.lit(1)), F.lit(MOST_BLOCKS)).cast("bigint"))
    aims = aims.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + F.lit(1e-12))).otherwise(0).cast("bigint"))
    aims = materialise(aims.withColumn("rest", F.greatest(F.col("target") - F.col("passes") * F.col("source_size"), F.lit(0.0))), "mix-targets")

    def with_source(df: DataFrame, other: DataFrame) -> DataFrame:
        return df.join(other.withColumnRenamed("source", "source_"), F.col("source").eqNullSafe(F.col("source_"))).drop("source_")

    # where each source's rest ends: the first block that does not fit
    blocked = with_source(slim, aims).withColumn("block", F.pmod("key", "blocks"))
    words = blocked.groupBy("source", "block").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    cum = F.sum("words").over(Window.partitionBy("source").orderBy("block"))
    over = words.withColumn("cum", cum).where(F.col("cum") > F.col("rest"))
    over = over.groupBy("source").agg(F.min(F.struct("block", (F.col("rest") - F.col("cum") + F.col("words")).alias("gap"))).alias("cut"))
    cuts = aims.join(over.withColumnRenamed("source", "source_"), F.col("source").eqNullSafe(F.col("source_")), "left").drop("source_")
    cuts = materialise(cuts.select("source", "source_size", "target", "blocks", "passes", F.coalesce("cut.block", "blocks").alias("cut"), F.coalesce("cut.gap", F.lit(0.0)).alias("gap")), "mix-cuts")
    # in that block: from the largest down, while they fit
    edge = with_source(slim, cuts).where(F.pmod("key", "blocks") == F.col("cut")).groupBy("source", "key", "size").agg(F.count("*").alias("n"), F.first("gap").alias("gap"))
    edge = edge.where("size > 0").groupBy("source").agg(F.first("gap").alias("gap"), F.sort_array(F.collect_list(F.struct((F.col("size") * F.col("n")).alias("w"), "key")), asc=False).alias("all"))
    fold = F.aggregate(
        "all",
        F.struct(F.col("gap").alias("left"), F.array().cast("array<bigint>").alias("keys")),
        lambda a, x: F.when(x["w"] <= a["left"], F.struct((a["left"] - x["w"]).alias("left"), F.concat(a["keys"], F.array(x["key"])).alias("keys"))).otherwise(a),
    )
    chosen = materialise(edge.select("source", F.explode(fold["keys"]).alias("key")), "mix-edge")
    quotas = cuts.select("source", (F.col("passes") * F.col("blocks") + F.col("cut")).alias("quota"))
    plan = with_source(cuts, split_tree(quotas, shards).withColumn("ends", F.transform("counts", lambda c, i: F.aggregate(F.slice("counts", 1, i + 1), F.lit(0).cast("bigint"), lambda a, v: a + v))).select("source", "ends"))
    plan = materialise(plan, "mix-plan")

    out = with_source(rows if keep_row else slim, plan).withColumn("block", F.pmod("key", "blocks"))
    c = chosen.select(F.col("source").alias("source_"), F.col("key").alias("key_"), F.lit(True).alias("picked"))
    out = out.join(c, F.col("source").eqNullSafe(F.col("source_")) & (F.col("key") == F.col("key_")) & (F.col("block") == F.col("cut")), "left").drop("source_", "key_")
    more = F.when((F.col("block") < F.col("cut")) | F.col("picked"), 1).otherwise(0)
    copies = F.when(F.col("size") > 0, F.col("passes") + more).otherwise(0).cast("int")
    out = out.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))
    slots = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.col("copies") - 1), lambda k: k * F.col("blocks") + F.col("block"))).otherwise(F.array().cast("array<bigint>"))
    place = F.transform(slots, lambda s: F.struct(F.when(s < F.col("ends")[shards - 1], F.size(F.filter("ends", lambda e: e <= s))).otherwise(F.pmod(F.xxhash64(F.lit(SEED), "key"), F.lit(shards))).cast("int").alias("shard"), F.xxhash64(F.lit(SEED), s, "key").alias("place")))
    return out.withColumn("places", place).select("doc_id", "source", "size", "source_size", "target", "copies", "taken", "places", *(["row"] if keep_row else []))


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    """The whole documents table, mixed."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", F.col("places.shard").alias("shards"))
