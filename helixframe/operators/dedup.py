"""Which copy of an annotation record to keep when files overlap: window ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REGION = 1_000_000


def region_preference(start: Column | str = "start", source_file: Column | str = "source_file", region: int = REGION) -> Column:
    """0 where the record's file is that of the region its start lies in, else 1."""
    start = F.col(start) if isinstance(start, str) else start
    file = F.col(source_file) if isinstance(source_file, str) else source_file
    low = F.floor((start - 1) / region) * region
    name = F.concat(F.lit("/"), (low + 1).cast("bigint").cast("string"), F.lit("-"), (low + region).cast("bigint").cast("string"), F.lit(".gz"))
    return F.when(F.endswith(file, name), 0).otherwise(1)


def _first(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("rank_", rank).where("rank_ = 1").drop("rank_")


def chromosomes(df: DataFrame, chroms: list[str] | None) -> DataFrame:
    """Rows of one or several chromosomes; None: all."""
    return df if chroms is None else df.where(F.col("chrom") == chroms[0]) if len(chroms) == 1 else df.where(F.col("chrom").isin(chroms))


def dedup_transcripts(df: DataFrame, chroms: list[str] | None = None) -> DataFrame:
    order = [(F.col("source") != "Ensembl").asc(), F.col("db_id").asc_nulls_last(), region_preference().asc(), F.col("cds_start").asc_nulls_last(), F.col("source_file").asc()]
    return _first(chromosomes(df, chroms), ["chrom", "stable_id"], order)


def dedup_exons(df: DataFrame, chroms: list[str] | None = None) -> DataFrame:
    return _first(chromosomes(df, chroms), ["chrom", "transcript_id", "exon_number"], [F.col("stable_id").asc_nulls_last()])


def dedup_translations(df: DataFrame, chroms: list[str] | None = None) -> DataFrame:
    order = [region_preference().asc(), F.col("cdna_coding_start").asc_nulls_last(), F.col("source_file").asc()]
    return _first(chromosomes(df, chroms), ["chrom", "transcript_id"], order)


def export(df: DataFrame, path: str, by: tuple[str, ...] = ("chrom", "start"), rows_per_file: int = 0) -> None:
    """Parquet, range-partitioned and sorted, so row groups have narrow ranges to prune by."""
    out = df.repartitionByRange(*by).sortWithinPartitions(*by).write
    (out.option("maxRecordsPerFile", rows_per_file) if rows_per_file else out).parquet(path)
