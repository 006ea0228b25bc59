"""Genotype and list functions over array columns, as native expressions, and as SQL functions.

Null rules: a null list gives null; null elements keep their place in comparisons (null), take three-valued logic in
``list_and``, are ignored by averages and counts. ``vcf_set_gts`` replaces only where the mask is false: a null or missing
mask element keeps the genotype, a null genotype stays null.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

MISSING = "./."
_INT = r"^[0-9]+$"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def list_avg(values: Column | str) -> Column:
    """Mean of the elements that are not null; null if there is none."""
    some = F.filter(_c(values), lambda e: e.isNotNull())
    total = F.aggregate(some, F.lit(0.0), lambda a, e: a + e.cast("double"))
    return F.when(F.size(some) > 0, total / F.size(some))


def list_gte(values: Column | str, threshold) -> Column:
    t = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return F.transform(_c(values), lambda e: e >= t)


def list_lte(values: Column | str, threshold) -> Column:
    t = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return F.transform(_c(values), lambda e: e <= t)


def list_and(a: Column | str, b: Column | str) -> Column:
    """Element-wise AND, as long as the shorter list."""
    a, b = _c(a), _c(b)
    n = F.least(F.size(a), F.size(b))
    return F.when(a.isNotNull() & b.isNotNull(), F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x & y))


def vcf_set_gts(genotypes: Column | str, mask: Column | str, replacement: Column | str = MISSING) -> Column:
    """Genotypes with those replaced whose mask is false."""
    m = _c(mask)
    r = replacement if isinstance(replacement, Column) else F.lit(replacement)
    return F.transform(_c(genotypes), lambda g, i: F.when(g.isNull(), g).when(F.coalesce(F.get(m, i), F.lit(True)), g).otherwise(r))


def _alleles(genotypes: Column) -> Column:
    """All called alleles of a genotype list, as integers."""
    called = F.flatten(F.transform(F.filter(genotypes, lambda g: g.isNotNull()), lambda g: F.split(g, r"[/|]")))
    return F.transform(F.filter(called, lambda a: a.rlike(_INT)), lambda a: a.cast("int"))


def vcf_an(genotypes: Column | str) -> Column:
    """Number of called alleles."""
    g = _c(genotypes)
    return F.when(g.isNotNull(), F.size(_alleles(g)))


def _alt_count(alt: Column | None) -> Column:
    if alt is None:
        return F.lit(0)
    return F.when(alt.isNull() | (alt == "") | (alt == "."), 0).otherwise(F.size(F.split(alt, r"\|")))


def vcf_ac(genotypes: Column | str, alt: Column | str | None = None) -> Column:
    """Count of each alternate allele; as long as the ALT list, or the largest allele seen if that is more."""
    g = _c(genotypes)
    alleles = _alleles(g)
    n = F.greatest(_alt_count(None if alt is None else _c(alt)), F.coalesce(F.array_max(alleles), F.lit(0)))
    counts = F.transform(F.sequence(F.lit(1), n), lambda k: F.size(F.filter(alleles, lambda a: a == k)))
    return F.when(g.isNull(), F.lit(None)).when(n > 0, counts).otherwise(F.array().cast("array<int>"))


def vcf_af(genotypes: Column | str, alt: Column | str | None = None) -> Column:
    """Frequency of each alternate allele; nulls if nothing is called."""
    g = _c(genotypes)
    an = vcf_an(g)
    return F.transform(vcf_ac(g, alt), lambda c: F.when(an > 0, c.cast("double") / an))


def alt_dosage(genotype: Column | str) -> Column:
    """Number of alleles 1 in a genotype as a byte; null if any allele is missing."""
    parts = F.split(_c(genotype), r"[/|]")
    return F.when(F.forall(parts, lambda a: a.rlike(_INT)), F.size(F.filter(parts, lambda a: a == "1")).cast("tinyint"))


_SQL = {
    "list_avg(x array<double>) RETURNS double": "CASE WHEN size(filter(x, e -> e IS NOT NULL)) > 0 THEN aggregate(filter(x, e -> e IS NOT NULL), 0D, (a, e) -> a + e) / size(filter(x, e -> e IS NOT NULL)) END",
    "list_gte(x array<double>, t double) RETURNS array<boolean>": "transform(x, e -> e >= t)",
    "list_lte(x array<double>, t double) RETURNS array<boolean>": "transform(x, e -> e <= t)",
    "list_and(a array<boolean>, b array<boolean>) RETURNS array<boolean>": "CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN zip_with(slice(a, 1, least(size(a), size(b))), slice(b, 1, least(size(a), size(b))), (x, y) -> x AND y) END",
    "vcf_set_gts(gt array<string>, mask array<boolean>, rep string DEFAULT './.') RETURNS array<string>": "transform(gt, (g, i) -> CASE WHEN g IS NULL THEN g WHEN coalesce(get(mask, i), true) THEN g ELSE rep END)",
    "vcf_alleles(gt array<string>) RETURNS array<int>": "transform(filter(flatten(transform(filter(gt, g -> g IS NOT NULL), g -> split(g, '[/|]'))), a -> a RLIKE '^[0-9]+$'), a -> cast(a AS int))",
    "vcf_an(gt array<string>) RETURNS int": "CASE WHEN gt IS NOT NULL THEN size(vcf_alleles(gt)) END",
    "vcf_allele_number(gt array<string>, alt string) RETURNS int": "greatest(CASE WHEN alt IS NULL OR alt IN ('', '.') THEN 0 ELSE size(split(alt, '[|]')) END, coalesce(array_max(vcf_alleles(gt)), 0))",
    "vcf_ac(gt array<string>, alt string DEFAULT NULL) RETURNS array<int>": "CASE WHEN gt IS NULL THEN NULL WHEN vcf_allele_number(gt, alt) > 0 THEN transform(sequence(1, vcf_allele_number(gt, alt)), k -> size(filter(vcf_alleles(gt), a -> a = k))) ELSE cast(array() AS array<int>) END",
    "vcf_af(gt array<string>, alt string DEFAULT NULL) RETURNS array<double>": "transform(vcf_ac(gt, alt), c -> CASE WHEN vcf_an(gt) > 0 THEN cast(c AS double) / vcf_an(gt) END)",
}


def register_functions(spark: SparkSession) -> None:
    """The functions under the same names in SQL; they inline into Catalyst plans."""
    for head, body in _SQL.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
