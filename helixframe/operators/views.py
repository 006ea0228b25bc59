"""Long view of a cohort: one row per variant and sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CORE = ("chrom", "start", "end", "id", "ref", "alt", "qual", "filter")


def long_view(df: DataFrame, samples: list[str], fields: list[str], genotypes: str = "genotypes") -> DataFrame:
    """Core columns, ``sample_id`` and one column per genotype field; INFO columns are left out.

    Every variant gives as many rows as there are declared samples; a list that is shorter gives nulls. No sample or
    no field: the frame itself. Names are literals here, so any character in them is safe.
    """
    if not samples or not fields:
        return df
    core = [F.col(f"`{c}`") for c in CORE if c in df.columns]
    each = df.select(*core, F.col(f"`{genotypes}`").alias("g_"), F.posexplode(F.array(*[F.lit(s) for s in samples])).alias("i_", "sample_id"))
    return each.select(*core, "sample_id", *[F.get(F.col("g_").getField(f), F.col("i_")).alias(f) for f in fields])


def register_long_view(df: DataFrame, name: str, samples: list[str] | None = None, fields: list[str] | None = None, genotypes: str = "genotypes") -> bool:
    """Create the temporary view ``{name}_long``; samples and fields come from the column's metadata unless given.

    Returns whether a view was made: frames without a cohort column are left alone.
    """
    if genotypes not in df.columns:
        return False
    meta = df.schema[genotypes].metadata or {}
    samples = samples if samples is not None else meta.get("bio.samples", [])
    fields = fields if fields is not None else df.schema[genotypes].dataType.fieldNames()
    if not samples or not fields:
        return False
    long_view(df, list(samples), list(fields), genotypes).createOrReplaceTempView(f"{name}_long")
    return True
