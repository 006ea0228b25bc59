"""Interval overlap join by bins: an equi-join on (chrom, bin) with the exact condition above it.

An interval is listed in each bin it touches; an overlap is reported only from the bin where the later start lies, so
no pair appears twice and no distinct is needed. Intervals far longer than the bin size go to a coarser level of bins (powers
of eight), so their rows stay few; a probe visits every level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = 5


def _level(length: Column, size: int) -> Column:
    out = F.lit(LEVELS - 1)
    for k in range(LEVELS - 2, -1, -1):
        out = F.when(length <= size * 8**k, k).otherwise(out)
    return out


def interval_join(left: DataFrame, right: DataFrame, size: int = 16_384) -> DataFrame:
    """Pairs of half-open (chrom, start, end) intervals that overlap; columns prefixed l_ and r_."""
    a = left.select([F.col(f"`{c}`").alias(f"l_{c}") for c in left.columns]).where("l_end > l_start")
    b = right.select([F.col(f"`{c}`").alias(f"r_{c}") for c in right.columns]).where("r_end > r_start")
    width = lambda level: F.lit(size) * F.pow(F.lit(8), level).cast("bigint")
    b = b.withColumn("level_", _level(F.col("r_end") - F.col("r_start"), size))
    b = b.withColumn("bin_", F.explode(F.sequence(F.floor(F.col("r_start") / width(F.col("level_"))), F.floor((F.col("r_end") - 1) / width(F.col("level_"))))))
    a = a.withColumn("level_", F.explode(F.array(*[F.lit(k) for k in range(LEVELS)])))
    a = a.withColumn("bin_", F.explode(F.sequence(F.floor(F.col("l_start") / width(F.col("level_"))), F.floor((F.col("l_end") - 1) / width(F.col("level_"))))))
    same = (F.col("l_chrom") == F.col("r_chrom")) & (a["level_"] == b["level_"]) & (a["bin_"] == b["bin_"])
    overlap = (F.col("l_start") < F.col("r_end")) & (F.col("r_start") < F.col("l_end"))
    later = F.floor(F.greatest("l_start", "r_start") / width(a["level_"])) == a["bin_"]
    return a.join(b, same & overlap & later).select([c for c in a.columns + b.columns if c[0] in "lr" and c not in ("level_", "bin_")])
