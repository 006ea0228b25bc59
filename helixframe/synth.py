"""Genomics-shaped tables derived from the relational ones; each has the same definition in SQL beside its query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as variants, their line items as samples: lists DP, GQ, GT in a total order of the items."""
    item = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount")
    v = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(item)).alias("x"))
    gts = F.array(*[F.lit(g) for g in ("0/0", "0/1", "1/1", "./.")])
    return v.select(
        F.concat(F.lit("chr"), (1 + F.col("l_orderkey") % 22).cast("string")).alias("chrom"),
        (F.col("l_orderkey") * 100).alias("start"),
        (F.col("l_orderkey") * 100 + 1).alias("end"),
        F.col("l_orderkey").alias("id"),
        F.transform("x", lambda e: e["l_quantity"].cast("int")).alias("DP"),
        F.transform("x", lambda e: F.round(e["l_discount"] * 1000).cast("int")).alias("GQ"),
        F.transform("x", lambda e: F.get(gts, e["l_linenumber"] % 4)).alias("GT"),
    )


COHORT_SQL = """SELECT 'chr' || (1 + l_orderkey % 22) AS chrom, l_orderkey * 100 AS start, l_orderkey * 100 + 1 AS "end", l_orderkey AS id,
  list(l_quantity::INT ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount) AS DP,
  list(round(l_discount * 1000)::INT ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount) AS GQ,
  list(['0/0', '0/1', '1/1', './.'][l_linenumber % 4 + 1] ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount) AS GT
FROM lineitem GROUP BY l_orderkey"""


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("o_orderkey") * 7
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("chr"), (F.col("o_custkey") % 22).cast("string")).alias("chrom"), start.alias("start"), (start + F.col("o_custkey") % 1000 + 1).alias("end"), F.col("o_orderpriority").alias("name"), F.col("o_orderkey").alias("id"))


INTERVALS_SQL = """SELECT 'chr' || (o_custkey % 22) AS chrom, o_orderkey * 7 AS start, o_orderkey * 7 + o_custkey % 1000 + 1 AS "end",
  o_orderpriority AS name, o_orderkey AS id FROM orders"""


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and a shifted second copy of each, as records of overlapping region files."""
    o = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 5000).alias("k"), F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("ok"))
    both = o.withColumn("copy", F.lit(0)).union(o.withColumn("copy", F.lit(1)))
    start = F.col("k") * 1000 + F.col("copy") * 400_000 + 1
    low = F.floor((F.col("k") * 1000) / 1_000_000) * 1_000_000
    return both.select(
        F.concat(F.lit("chr"), (F.col("k") % 22).cast("string")).alias("chrom"),
        F.concat(F.lit("T"), F.col("k").cast("string")).alias("stable_id"),
        F.when((F.col("ok") + F.col("copy")) % 2 == 0, "Ensembl").otherwise("RefSeq").alias("source"),
        F.when(F.col("c") % 7 != 0, F.col("c")).alias("db_id"),
        start.alias("start"),
        F.when(F.col("ok") % 3 != 0, start + 10).alias("cds_start"),
        F.concat(F.lit("cache/"), (low + 1).cast("bigint").cast("string"), F.lit("-"), (low + 1_000_000).cast("bigint").cast("string"), F.lit(".gz")).alias("source_file"),
        F.concat(F.lit("E"), (F.col("c") % 10).cast("string")).alias("exon_id"),
        (F.col("ok") % 4).alias("exon_number"),
        F.col("ok").alias("row_id"),
        F.col("copy"),
    )


TRANSCRIPTS_SQL = """SELECT 'chr' || (k % 22) AS chrom, 'T' || k AS stable_id, CASE WHEN (ok + copy) % 2 = 0 THEN 'Ensembl' ELSE 'RefSeq' END AS source,
  CASE WHEN c % 7 <> 0 THEN c END AS db_id, k * 1000 + copy * 400000 + 1 AS start, CASE WHEN ok % 3 <> 0 THEN k * 1000 + copy * 400000 + 11 END AS cds_start,
  'cache/' || ((k * 1000) // 1000000 * 1000000 + 1) || '-' || ((k * 1000) // 1000000 * 1000000 + 1000000) || '.gz' AS source_file,
  'E' || (c % 10) AS exon_id, ok % 4 AS exon_number, ok AS row_id, copy
FROM (SELECT o_orderkey % 5000 AS k, o_custkey AS c, o_orderkey AS ok, unnest([0, 1]) AS copy FROM orders)"""
