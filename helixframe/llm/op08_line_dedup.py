"""Line dedup: maximal repeated runs of lines from prefix doubling over line ids (DataFrame functions only).

Lines become ids, and only lines that occur more than once stay in play: a unique line ends every repeat. Round k knows
the bucket of the 2^k lines from each position on in the suffix order, as an order-preserving rank over the distinct pairs of
ranks of round k - 1 (the range-sorted distinct pairs are numbered, then joined back). Positions whose bucket has one member
leave, so rounds end after the logarithm of the longest repeat, with few rows in the late ones.

Buckets are the longest-common-prefix intervals of depth 2^k. The intervals between 2^k and 2^(k+1) lines follow by halving:
a bucket is a problem whose nodes are the first positions of its sub-buckets of the next round; nodes that agree on the
next 2^(k-1) lines too, by their ranks there, become a problem of their own, and its first node stands for them in the old
one. Each halving keeps the sum of (nodes - 1), so rows don't grow. After k halvings a problem is one interval: its
positions share exactly ``length`` lines, its first position is the first copy, and ``copies`` counts all members. Each
position is a later node of one interval at most, that of the longest run from it on that stands earlier too.

A run is a maximal block of consecutive lines that also stands earlier, in the order (doc_id, line). It counts when it has
at least two lines, or is one line of ``min_chars`` characters. Its later copies are deleted, the first one stays; a
copy may overlap its first one. Runs that overlap each other are each deleted, whichever documents hold their first copies.

Skew: a line that is in a third of all rows is aggregated before the shuffle, and only streamed past its one class row in
joins of two plain exchanges, which adaptive execution splits. Windows run within a document.

Defined cases: null text stays null and has no lines; lines of white space only are transparent: they are not counted,
and go only inside a deleted run; a null doc_id sorts first; rows with equal doc_id and text are one document and both get
its result; an empty table gives an empty result; other columns are untouched; a document of more than 2^28 lines that are
not blank is an error, since positions would run into the next document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise, table

MIN_CHARS = 20
#: Bits of a position that number the lines of a document.
LINE_BITS = 28


def _hashes(x: Column | str) -> tuple[Column, Column]:
    return F.xxhash64(x), F.xxhash64(F.lit(7), x)


def _ranked(classes: DataFrame, *by: str) -> DataFrame:
    """The distinct rows with an order-preserving number ``rank`` in place of ``by`` order."""
    stored = materialise(classes, "lines-classes")
    out = materialise(stored.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("rank", F.monotonically_increasing_id()), "lines-ranks")
    discard(stored)
    return out


def _dense(keys: DataFrame, *by: str) -> DataFrame:
    """Rows numbered 0, 1, ... in the order ``by``; what goes to the driver is one count per partition."""
    s = materialise(keys.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("id", F.monotonically_increasing_id()), "lines-docs")
    part = F.shiftright("id", 33)
    sizes = sorted(s.groupBy(part.alias("p")).count().collect())
    starts, at = [], 0
    for p, n in sizes:
        starts.append((p, at))
        at += n
    if not starts:
        return s.withColumn("doc", F.col("id")).drop("id")
    first = keys.sparkSession.createDataFrame(starts, "p long, start long")
    return s.withColumn("p", part).join(F.broadcast(first), "p").withColumn("doc", F.col("start") + F.col("id").bitwiseAND(F.lit((1 << 33) - 1))).drop("id", "p", "start")


def _numbered_lines(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(lines, order): each line that is not blank under its position, and the documents in their order."""
    t = F.col(f"`{text}`")
    t1, t2 = _hashes(t)

    def line(x, j):
        h1, h2 = _hashes(x)
        return F.struct(j.alias("j"), h1.alias("h1"), h2.alias("h2"), F.length(x).alias("n"), (F.trim(x, F.lit(" \t\r")) != "").alias("some"))

    per_doc = docs.where(t.isNotNull()).select(F.col(f"`{doc_id}`").alias("doc_id"), t1.alias("t1"), t2.alias("t2"), F.filter(F.transform(F.split(t, "\n"), line), lambda x: x["some"]).alias("lines"))
    per_doc = stored = materialise(per_doc, "lines-of-docs")
    keys = per_doc.groupBy("doc_id", "t1", "t2").count()
    order = materialise(_dense(keys, "doc_id", "t1", "t2"), "lines-order")
    if order.where("count > 1").limit(1).count():
        per_doc = per_doc.dropDuplicates(["doc_id", "t1", "t2"])
    o = order.select(F.col("doc_id").alias("d_"), F.col("t1").alias("t1_"), F.col("t2").alias("t2_"), "doc")
    numbered = per_doc.join(o, F.col("doc_id").eqNullSafe(F.col("d_")) & (F.col("t1") == F.col("t1_")) & (F.col("t2") == F.col("t2_")))
    fits = F.when(F.size("lines") > 1 << LINE_BITS, F.raise_error(F.lit("a document has too many lines")).cast("bigint")).otherwise(F.shiftleft("doc", LINE_BITS))
    lines = numbered.select(fits.alias("start"), F.posexplode("lines").alias("i", "x")).select((F.col("start") + F.col("i")).alias("pos"), F.col("x.h1").alias("r"), F.col("x.h2").alias("r2"), F.col("x.n").alias("n"), F.col("x.j").alias("j"))
    out = materialise(lines, "lines-all")
    discard(stored)
    return out, order


def _classes(df: DataFrame) -> DataFrame:
    """The pairs (r, r2) that occur more than once: their rank, number and first position."""
    return _ranked(df.groupBy("r", "r2").agg(F.count("*").alias("c"), F.min("pos").alias("first")).where("c > 1"), "r", "r2")


def _nodes(pairs: DataFrame, length: int) -> DataFrame:
    """Problems of ``length`` shared lines: (length, first, c, pos, w), where the node at ``pos`` stands for ``w`` of ``c`` positions."""
    w = F.when(F.col("up").isNull(), F.lit(1).cast("bigint")).when(F.col("pos") == F.col("up.first"), F.col("up.c"))
    return pairs.select(F.lit(length).cast("bigint").alias("length"), "first", "c", "pos", w.alias("w")).where("w < c")


def _halve(problems: DataFrame, ranks: DataFrame, step: int) -> DataFrame:
    """Nodes that agree on ``step`` more lines become problems of their own; the first of them stays in the old one."""
    ahead = ranks.select(F.col("pos").alias("at"), F.col("r").alias("next"))
    x = materialise(problems.withColumn("at", F.col("pos") + F.col("length")).join(ahead, "at", "left").drop("at"), "lines-ahead")
    by = ["length", "first", "next"]
    alike = x.where("next is not null").groupBy(*by).agg(F.count("*").alias("n"), F.min("pos").alias("first2"), F.sum("w").alias("w2")).where("n > 1").drop("n")
    new = F.struct((F.col("length") + step).alias("length"), F.col("first2").alias("first"), F.col("w2").alias("c"), "pos", "w")
    old = F.struct("length", "first", "c", "pos", F.coalesce("w2", "w").alias("w"))
    both = x.join(alike, by, "left").select(F.explode(F.when(F.col("w2").isNull(), F.array(old)).when(F.col("pos") == F.col("first2"), F.array(new, old)).otherwise(F.array(new))).alias("x"))
    out = materialise(both.select("x.*").where("w < c"), "lines-problems")
    discard(x)
    return out


def repeated_intervals(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(base, intervals) of ``lines`` (pos, r, r2, n, j), where (r, r2) identifies the line's text; a stored ``lines`` is deleted.

    base: (pos, n, j) of the lines that occur more than once; intervals: (pos, length, first, copies) for every position that
    starts a run standing earlier too: the longest such run, its first copy, and how often it occurs.
    """
    named = _classes(lines)
    level = materialise(lines.join(named, ["r", "r2"]).select("pos", "n", "j", F.col("rank").alias("r"), "first", "c"), "lines-level")
    discard(named, lines)
    base, ranks, nodes = level.select("pos", "n", "j"), [], []
    while True:
        step = 1 << len(ranks)
        ranks.append(level)
        w = Window.partitionBy(F.shiftright("pos", LINE_BITS)).orderBy("pos")
        r2 = F.when(F.lead("pos", step).over(w) == F.col("pos") + step, F.lead("r", step).over(w))
        pairs = materialise(level.select("pos", "r", "first", "c", r2.alias("r2")), "lines-pairs")
        named = _classes(pairs.where("r2 is not null"))
        up = named.select("r", "r2", F.struct("rank", "first", "c").alias("up"))
        found = named.limit(1).count()
        both = materialise(pairs.join(up, ["r", "r2"], "left").select("pos", "first", "c", "up"), "lines-level")
        discard(pairs, named)
        nodes.append(_nodes(both, step))
        if not found:
            break
        level = both.where("up is not null").select("pos", F.col("up.rank").alias("r"), F.col("up.first").alias("first"), F.col("up.c").alias("c"))
    problems = None
    for k in reversed(range(len(ranks) - 1)):
        start = nodes[k + 1] if problems is None else problems.unionByName(nodes[k + 1])
        before, problems = problems, _halve(start, ranks[k], 1 << k)
        discard(*([] if before is None else [before]))
    done = nodes[0] if problems is None else problems.unionByName(nodes[0])
    return base, done.where("pos <> first").select("pos", "length", "first", F.col("c").alias("copies"))


def repeated_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, t1, t2, runs, n_deleted, repeats) for each document with something to delete; t1, t2 hash its text.

    Lines are numbered over all lines of the text, from 0. ``runs``: what is deleted, sorted (start, end, lines), both ends
    included. ``repeats``: the maximal runs that it consists of, sorted (start, lines, copies, first_doc_id, first_line).
    """
    lines, order = _numbered_lines(docs, doc_id, text)
    base, intervals = repeated_intervals(lines)
    counts = (F.col("length") > 1) | (F.col("n") >= min_chars)
    reach = F.when(counts, F.col("pos") + F.col("length"))
    doc = F.shiftright("pos", LINE_BITS)
    w = Window.partitionBy(doc).orderBy("pos")
    # every line of a deleted run is a repeated line, so it is in base
    seen = base.join(intervals, "pos", "left").withColumn("reach", reach).withColumn("till", F.max("reach").over(w))
    seen = seen.withColumn("before", F.lag("till").over(w)).where(F.col("till") > F.col("pos"))
    gone = materialise(seen.select(doc.alias("doc"), "pos", "j", "length", "first", "copies", (F.col("reach") > F.coalesce("before", F.lit(0))).alias("maximal")), "lines-gone")
    island = F.col("pos") - F.row_number().over(Window.partitionBy("doc").orderBy("pos"))
    runs = gone.withColumn("island", island).groupBy("doc", "island").agg(F.min("j").alias("start"), F.max("j").alias("end"), F.count("*").alias("lines"))
    runs = runs.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("start", "end", "lines"))).alias("runs"), F.sum("lines").alias("n_deleted"))
    maximal = gone.where("maximal").select("doc", "j", "length", "copies", "first", F.shiftright("first", LINE_BITS).alias("first_doc"))
    maximal = maximal.join(base.select(F.col("pos").alias("first"), F.col("j").alias("first_line")), "first")
    maximal = maximal.join(order.select(F.col("doc").alias("first_doc"), F.col("doc_id").alias("first_doc_id")), "first_doc")
    repeats = maximal.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct(F.col("j").alias("start"), F.col("length").alias("lines"), "copies", "first_doc_id", "first_line"))).alias("repeats"))
    return order.join(runs, "doc").join(repeats, "doc").select("doc_id", "t1", "t2", "runs", "n_deleted", "repeats")


def line_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """The rows of ``docs`` with a struct column ``dedup``: text after deletion, n_lines, n_deleted, runs, repeats."""
    runs = materialise(repeated_runs(docs, doc_id, text, min_chars), "lines-runs")
    t = F.col(f"`{text}`")
    t1, t2 = _hashes(t)
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{doc_id}`").alias("id_"), t.alias("text_"), t1.alias("t1_"), t2.alias("t2_"))
    r = runs.select("doc_id", "t1", "t2", F.col("runs").alias("runs_"), "n_deleted", F.col("repeats").alias("repeats_"))
    both = row.join(r, F.col("id_").eqNullSafe(F.col("doc_id")) & (F.col("t1_") == F.col("t1")) & (F.col("t2_") == F.col("t2")), "left")
    all_lines = F.split("text_", "\n")
    # what stands between the runs: slices of the lines
    starts = F.concat(F.array(F.lit(0)), F.transform("runs_", lambda x: x["end"] + 1))
    ends = F.concat(F.transform("runs_", lambda x: x["start"]), F.array(F.size(all_lines)))
    kept = F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice(all_lines, a + 1, F.greatest(b - a, F.lit(0)))))
    n_lines = F.coalesce(F.when(F.col("text_").isNotNull(), F.size(F.filter(all_lines, lambda x: F.trim(x, F.lit(" \t\r")) != ""))), F.lit(0)).cast("bigint")
    out = F.struct(
        F.when(F.col("n_deleted").isNull(), F.col("text_")).otherwise(F.array_join(kept, "\n")).alias("text"),
        n_lines.alias("n_lines"),
        F.coalesce("n_deleted", F.lit(0)).cast("bigint").alias("n_deleted"),
        F.coalesce("runs_", F.array().cast("array<struct<start:int,end:int,lines:bigint>>")).alias("runs"),
        F.coalesce("repeats_", F.array().cast(runs.schema["repeats"].dataType)).alias("repeats"),
    )
    return both.select("row", out.alias("dedup"))


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    """The whole documents table without later copies of repeated line runs."""
    return line_dedup(table(spark, sf_dir, "documents")).select("row.doc_id", "dedup.n_lines", "dedup.n_deleted", "dedup.text")


ORACLE_SQL = f"""
WITH lines AS (
  SELECT doc_id, j, line, row_number() OVER (PARTITION BY doc_id ORDER BY j) AS i
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS j FROM documents)
  WHERE trim(line, ' ' || chr(9) || chr(13)) <> ''),
pairs AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS after FROM lines),
seen AS (
  SELECT *,
    length(line) >= {MIN_CHARS} AND row_number() OVER (PARTITION BY line ORDER BY doc_id, i) > 1 AS one,
    after IS NOT NULL AND row_number() OVER (PARTITION BY line, after ORDER BY doc_id, i) > 1 AS two
  FROM pairs),
marked AS (SELECT *, one OR two OR coalesce(lag(two) OVER (PARTITION BY doc_id ORDER BY i), false) AS gone FROM seen),
docs AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_deleted,
    string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone) AS kept
  FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_deleted, 0)::BIGINT AS n_deleted,
  CASE WHEN coalesce(n_deleted, 0) = 0 THEN d.text ELSE coalesce(kept, '') END AS text
FROM documents d LEFT JOIN docs USING (doc_id)
"""
