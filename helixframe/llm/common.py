"""Shared parts of the operators: table access, hashing, components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.session import discard, materialise

#: What counts as white space between words where a contract says ``[^\\x20\\x09-\\x0D]+``.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under internal names: other columns, whatever their names, can't clash."""
    return df.select(*[F.col(f"`{src}`").alias(dst) for dst, src in columns.items()])


class Scratch:
    """Intermediate tables of one operator call; ``clear`` deletes them once its result is written."""

    def __init__(self):
        self.tables: list[DataFrame] = []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        out = materialise(df, name)
        self.tables.append(out)
        return out

    def adopt(self, df: DataFrame) -> DataFrame:
        self.tables.append(df)
        return df

    def clear(self) -> None:
        discard(*self.tables)
        self.tables.clear()


def components(edges: DataFrame, name: str = "cc", max_rounds: int = 200) -> DataFrame:
    """Connected components of undirected edges (u, v): rows (node, label), label = smallest node of the component.

    Smallest labels travel along edges and jump along labels, so rounds grow with the logarithm of the diameter in
    practice. Each round is a written table. Messages are reduced before the shuffle, and a node with very many edges is
    only on the streamed side of a join of two plain exchanges, which adaptive execution splits.
    Nodes appear only if they have an edge; an empty input gives an empty output.
    """
    both = materialise(
        edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct(), f"{name}-edges"
    )
    labels = materialise(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("u"), F.min("v")).alias("label")), f"{name}-labels")
    for _ in range(max_rounds):
        told = both.join(labels.withColumnRenamed("node", "u"), "u").groupBy(F.col("v").alias("node")).agg(F.min("label").alias("other"))
        step = labels.join(told, "node", "left").select("node", F.least("label", F.coalesce("other", "label")).alias("next"), "label")
        step = materialise(step, f"{name}-step")
        up = step.select(F.col("node").alias("next"), F.col("next").alias("jump"))
        moved = materialise(
            step.join(up, "next", "left").select("node", F.least("next", F.coalesce("jump", "next")).alias("label"), F.col("label").alias("was")), f"{name}-labels"
        )
        changed = moved.where("label <> was").limit(1).count()
        discard(step, labels)
        labels = moved.select("node", "label")
        labels._helixframe_path = moved._helixframe_path
        if not changed:
            discard(both)
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def schema_with(df: DataFrame, *columns: str, **more: str) -> T.StructType:
    """The named columns of ``df`` with their types, whatever the names inside them, and further ones by type string."""
    extra = T._parse_datatype_string(", ".join(f"{n} {t}" for n, t in more.items()))
    return T.StructType([df.schema[c] for c in columns] + list(extra.fields))


def by_group(df: DataFrame, keys: list[str], body, schema: str) -> DataFrame:
    """``body`` over the rows of each group as one pandas frame, several groups per task and batch.

    Groups are of bounded size by construction of the caller; rows of a group that spans Arrow batches are joined.
    """
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = df.repartition(parts, *keys).sortWithinPartitions(*keys)

    def run(batches):
        import pandas as pd

        rest = None
        for b in batches:
            b = b if rest is None else pd.concat((rest, b), ignore_index=True)
            if not len(b):
                continue
            last, same = b[keys].iloc[-1], True
            for k in keys:
                same = same & (b[k] == last[k])
            rest = b[same]
            for _, g in b[~same].groupby(keys, sort=False):
                yield from body(g)
        if rest is not None and len(rest):
            yield from body(rest)

    return dealt.mapInPandas(run, schema)
