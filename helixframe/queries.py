"""Queries over the derived tables, each with the same result in SQL."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import synth
from .functions import alignment, cohort
from .operators import dedup, intervals, views
from .session import shared_dir
from .sinks import lines as sink
from .sources import text as src
from .synth import COHORT_SQL, INTERVALS_SQL, TRANSCRIPTS_SQL, table

QUERIES: dict = {}


class _Oracles(dict):
    """SQL by query; ``x -> e`` in it is written as a named lambda."""

    def __setitem__(self, name: str, sql: str) -> None:
        super().__setitem__(name, re.sub(r"\b([a-z]) -> ", r"lambda \1: ", sql))


ORACLES = _Oracles()

_WITH = f"WITH cohort AS ({COHORT_SQL}), intervals AS ({INTERVALS_SQL}), transcripts AS ({TRANSCRIPTS_SQL}) "


def query(sql: str | None = None):
    """Register a query under its function's name; ``sql`` follows the common tables."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = _WITH + sql
        return f

    return add


def _text(x):
    return F.array_join(F.transform(x, lambda e: e.cast("string")), ",", "NULL")


def _sql_text(x: str) -> str:
    return f"array_to_string(list_transform({x}, e -> coalesce(e::VARCHAR, 'NULL')), ',')"


def _scratch(spark: SparkSession, suffix: str) -> str:
    """A path for rendered files that executors share."""
    return f"{shared_dir(spark).removeprefix('file:')}/helixframe-{uuid.uuid4().hex}{suffix}"


_MASKED = "list_transform(list_zip(GT, DP, GQ), x -> CASE WHEN x[2] >= 10 AND x[3] >= 20 THEN x[1] ELSE './.' END)"
_ALLELES = "list_filter(flatten(list_transform({g}, g -> string_split(g, '/'))), a -> a <> '.')"


def _masked(df: DataFrame) -> DataFrame:
    mask = cohort.list_and(cohort.list_gte("DP", 10), cohort.list_gte("GQ", 20))
    return df.withColumn("GT2", cohort.vcf_set_gts("GT", mask))


# --- functions -----------------------------------------------------------------------------------------------------


@query("SELECT id, round(list_avg(DP), 6) AS dp, round(list_avg(GQ), 6) AS gq FROM cohort")
def list_avg(spark, d):
    return synth.cohort(spark, d).select("id", F.round(cohort.list_avg("DP"), 6).alias("dp"), F.round(cohort.list_avg("GQ"), 6).alias("gq"))


@query(f"SELECT id, {_sql_text('list_transform(DP, e -> e >= 20)')} AS m FROM cohort")
def list_gte(spark, d):
    return synth.cohort(spark, d).select("id", _text(cohort.list_gte("DP", 20)).alias("m"))


@query(f"SELECT id, {_sql_text('list_transform(GQ, e -> e <= 50)')} AS m FROM cohort")
def list_lte(spark, d):
    return synth.cohort(spark, d).select("id", _text(cohort.list_lte("GQ", 50)).alias("m"))


@query(f"SELECT id, {_sql_text('list_transform(list_zip(DP, GQ), x -> x[1] >= 10 AND x[2] >= 20)')} AS m FROM cohort")
def list_and(spark, d):
    return synth.cohort(spark, d).select("id", _text(cohort.list_and(cohort.list_gte("DP", 10), cohort.list_gte("GQ", 20))).alias("m"))


@query(f"SELECT id, {_sql_text(_MASKED)} AS gt FROM cohort")
def vcf_set_gts(spark, d):
    return _masked(synth.cohort(spark, d)).select("id", _text(F.col("GT2")).alias("gt"))


@query(f"SELECT id, len({_ALLELES.format(g='GT')})::INT AS an FROM cohort")
def vcf_an(spark, d):
    return synth.cohort(spark, d).select("id", cohort.vcf_an("GT").alias("an"))


_AC = f"""SELECT id, alleles, n, list_transform(generate_series(1, n), k -> len(list_filter(alleles, a -> a = k::VARCHAR))) AS ac FROM (
  SELECT id, alleles, greatest({{alt}}, coalesce(list_max(list_transform(alleles, a -> a::INT)), 0)) AS n FROM (SELECT id, {_ALLELES.format(g="GT")} AS alleles FROM cohort))"""


@query(f"SELECT id, {_sql_text('ac')} AS ac FROM ({_AC.format(alt=0)})")
def vcf_ac(spark, d):
    return synth.cohort(spark, d).select("id", _text(cohort.vcf_ac("GT")).alias("ac"))


@query(f"SELECT id, {_sql_text('ac')} AS ac FROM ({_AC.format(alt=2)})")
def vcf_ac_alt(spark, d):
    return synth.cohort(spark, d).select("id", _text(cohort.vcf_ac("GT", F.lit("A|T"))).alias("ac"))


@query(f"SELECT id, CASE WHEN len(alleles) > 0 AND n > 0 THEN round(ac[1] / len(alleles), 6) END AS af FROM ({_AC.format(alt=0)})")
def vcf_af(spark, d):
    return synth.cohort(spark, d).select("id", F.round(F.get(cohort.vcf_af("GT"), 0), 6).alias("af"))


@query(f"SELECT id, CASE WHEN len(alleles) > 0 THEN round(ac[2] / len(alleles), 6) END AS af2, n::INT AS n FROM ({_AC.format(alt=2)})")
def vcf_af_alt(spark, d):
    af = cohort.vcf_af("GT", F.lit("A|T"))
    return synth.cohort(spark, d).select("id", F.round(F.get(af, 1), 6).alias("af2"), F.size(af).alias("n"))


@query("SELECT id, (len(string_split(GT[1], '/')) - len(list_filter(string_split(GT[1], '/'), a -> a <> '1')))::INT AS ds FROM cohort WHERE GT[1] <> './.' UNION ALL SELECT id, NULL FROM cohort WHERE GT[1] = './.'")
def dosage_alt_count(spark, d):
    return synth.cohort(spark, d).select("id", cohort.alt_dosage(F.get("GT", 0)).cast("int").alias("ds"))


_PIPE = f"""m AS (SELECT chrom, {_ALLELES.format(g=_MASKED)} AS alleles FROM cohort WHERE list_avg(GQ) >= 20),
s AS (SELECT chrom, len(alleles) AS an, len(list_filter(alleles, a -> a = '1')) AS ac FROM m)
SELECT chrom, count(*) AS variants, sum(an)::BIGINT AS an, sum(ac)::BIGINT AS ac, round(sum(ac) / sum(an), 6) AS af FROM s GROUP BY chrom"""


def cohort_pipeline(spark, d):
    """Masked genotypes of good variants, recounted and summed by chromosome."""
    v = _masked(synth.cohort(spark, d).where(cohort.list_avg("GQ") >= 20))
    v = v.select("chrom", cohort.vcf_an("GT2").alias("an"), F.coalesce(F.get(cohort.vcf_ac("GT2"), 0), F.lit(0)).alias("ac"))
    return v.groupBy("chrom").agg(F.count("*").alias("variants"), F.sum("an").alias("an"), F.sum("ac").alias("ac"), F.round(F.sum("ac") / F.sum("an"), 6).alias("af"))


QUERIES["cohort_pipeline"] = cohort_pipeline
ORACLES["cohort_pipeline"] = _WITH.rstrip() + ", " + _PIPE


def cohort_pipeline_sql(spark, d):
    """The same through SQL functions over a view."""
    cohort.register_functions(spark)
    synth.cohort(spark, d).createOrReplaceTempView("helixframe_cohort")
    return spark.sql("""
      WITH m AS (SELECT chrom, vcf_set_gts(GT, list_and(list_gte(DP, 10), list_gte(GQ, 20))) AS gt FROM helixframe_cohort WHERE list_avg(GQ) >= 20)
      SELECT chrom, count(*) AS variants, sum(vcf_an(gt)) AS an, sum(coalesce(get(vcf_ac(gt), 0), 0)) AS ac,
        round(sum(coalesce(get(vcf_ac(gt), 0), 0)) / sum(vcf_an(gt)), 6) AS af FROM m GROUP BY chrom""")


QUERIES["cohort_pipeline_sql"] = cohort_pipeline_sql
ORACLES["cohort_pipeline_sql"] = ORACLES["cohort_pipeline"]

# --- long view -----------------------------------------------------------------------------------------------------

_SAMPLES = [f"S{k}" for k in range(1, 8)]
_LONG = "long AS (SELECT chrom, start, id, 'S' || k AS sample_id, GT[k] AS GT, DP[k] AS DP FROM (SELECT *, unnest(generate_series(1, 7)) AS k FROM cohort))"


def _long(spark, d):
    v = synth.cohort(spark, d).select("chrom", "start", "end", "id", F.struct("GT", "DP").alias("genotypes"))
    return views.long_view(v, _SAMPLES, ["GT", "DP"]).drop("end")


def long_view(spark, d):
    return _long(spark, d)


def long_view_het_count(spark, d):
    return _long(spark, d).groupBy("sample_id").agg(F.count(F.when(F.col("GT") == "0/1", 1)).alias("hets"), F.count("GT").alias("called"))


def long_view_compare(spark, d):
    """Variants where two samples differ: a self join of the long view."""
    v = _long(spark, d)
    a, b = v.where("sample_id = 'S1'").select("id", F.col("GT").alias("a")), v.where("sample_id = 'S2'").select("id", F.col("GT").alias("b"))
    return a.join(b, "id").where("a <> b").groupBy("a", "b").agg(F.count("*").alias("n"))


for _f, _sql in (
    (long_view, "SELECT * FROM long"),
    (long_view_het_count, "SELECT sample_id, count(*) FILTER (WHERE GT = '0/1') AS hets, count(GT) AS called FROM long GROUP BY sample_id"),
    (long_view_compare, "SELECT x.GT AS a, y.GT AS b, count(*) AS n FROM long x JOIN long y ON x.id = y.id AND x.sample_id = 'S1' AND y.sample_id = 'S2' AND x.GT <> y.GT GROUP BY 1, 2"),
):
    QUERIES[_f.__name__] = _f
    ORACLES[_f.__name__] = _WITH.rstrip() + ", " + _LONG + " " + _sql

# --- export dedup --------------------------------------------------------------------------------------------------

_PREF = "CASE WHEN ends_with(source_file, '/' || ((start - 1) // 1000000 * 1000000 + 1) || '-' || ((start - 1) // 1000000 * 1000000 + 1000000) || '.gz') THEN 0 ELSE 1 END"


@query(f"SELECT row_id, copy, ({_PREF})::INT AS pref FROM transcripts")
def region_preference(spark, d):
    return synth.transcripts(spark, d).select("row_id", "copy", dedup.region_preference().alias("pref"))


@query(f"SELECT chrom, stable_id, source, db_id, {_PREF} AS pref, cds_start, 1::BIGINT AS n FROM (SELECT *, rank() OVER (PARTITION BY chrom, stable_id ORDER BY source <> 'Ensembl', db_id NULLS LAST, {_PREF}, cds_start NULLS LAST, source_file) AS rn FROM transcripts) WHERE rn = 1 GROUP BY ALL")
def dedup_transcript(spark, d):
    out = dedup.dedup_transcripts(synth.transcripts(spark, d))
    return out.select("chrom", "stable_id", "source", "db_id", dedup.region_preference().alias("pref"), "cds_start", F.lit(1).cast("bigint").alias("n"))


@query("SELECT chrom, stable_id AS transcript_id, exon_number, min(exon_id) AS exon FROM transcripts GROUP BY ALL")
def dedup_exon(spark, d):
    e = synth.transcripts(spark, d).withColumnsRenamed({"stable_id": "transcript_id", "exon_id": "stable_id"})
    return dedup.dedup_exons(e).select("chrom", "transcript_id", "exon_number", F.col("stable_id").alias("exon"))


@query(f"SELECT DISTINCT chrom, stable_id AS transcript_id, pref, cds_start FROM (SELECT *, {_PREF} AS pref, rank() OVER (PARTITION BY chrom, stable_id ORDER BY {_PREF}, cds_start NULLS LAST, source_file) AS rn FROM transcripts WHERE chrom IN ('chr1', 'chr2')) WHERE rn = 1")
def dedup_translation(spark, d):
    t = synth.transcripts(spark, d).withColumnsRenamed({"stable_id": "transcript_id"}).withColumn("cdna_coding_start", F.col("cds_start"))
    return dedup.dedup_translations(t, ["chr1", "chr2"]).select("chrom", "transcript_id", dedup.region_preference().alias("pref"), "cds_start")


# --- coordinates, filters, relational ------------------------------------------------------------------------------


@query("SELECT chrom, count(*) AS n, sum(\"end\" - start)::BIGINT AS bases FROM intervals GROUP BY chrom")
def coords_zero(spark, d):
    return synth.intervals(spark, d).groupBy("chrom").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("bases"))


@query("SELECT id, chrom, start + 1 AS start, \"end\" FROM intervals WHERE chrom = 'chr3' AND start + 1 <= 20000 AND \"end\" >= 5000")
def filter_region(spark, d):
    v = synth.intervals(spark, d).withColumn("start", F.col("start") + 1)
    return v.where((F.col("chrom") == "chr3") & (F.col("start") <= 20000) & (F.col("end") >= 5000)).select("id", "chrom", "start", "end")


@query("SELECT id FROM intervals WHERE chrom IN ('chr1', 'chr7', 'chrX')")
def filter_in_chrom(spark, d):
    return synth.intervals(spark, d).where(F.col("chrom").isin("chr1", "chr7", "chrX")).select("id")


@query("SELECT id FROM intervals WHERE start BETWEEN 1000 AND 9000 AND NOT start BETWEEN 2000 AND 3000")
def filter_between(spark, d):
    return synth.intervals(spark, d).where(F.col("start").between(1000, 9000) & ~F.col("start").between(2000, 3000)).select("id")


@query("SELECT id FROM intervals WHERE start IN (7, 14, NULL) OR (id < 50 AND start NOT IN (21, 28))")
def filter_null_in(spark, d):
    return synth.intervals(spark, d).where("start IN (7, 14, NULL) OR (id < 50 AND start NOT IN (21, 28))").select("id")


@query("SELECT id FROM intervals WHERE chrom = 'chr1' AND chrom = 'chr2'")
def filter_contradiction(spark, d):
    return synth.intervals(spark, d).where("chrom = 'chr1' AND chrom = 'chr2'").select("id")


@query("SELECT l_returnflag, count(*) AS n FROM lineitem WHERE (l_linenumber & 4) = 4 GROUP BY 1")
def filter_bitflag(spark, d):
    return table(spark, d, "lineitem").where(F.col("l_linenumber").bitwiseAND(4) == 4).groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query('SELECT a.id AS a, b.id AS b FROM intervals a JOIN intervals b ON a.chrom = b.chrom AND a.start < b."end" AND b.start < a."end" AND a.id < b.id')
def interval_overlaps(spark, d):
    v = synth.intervals(spark, d).select("chrom", "start", "end", "id")
    return intervals.interval_join(v, v).where("l_id < r_id").select(F.col("l_id").alias("a"), F.col("r_id").alias("b"))


@query("SELECT count(*) AS n FROM lineitem")
def count_star(spark, d):
    return table(spark, d, "lineitem").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def limit_topk(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct(spark, d):
    return table(spark, d, "lineitem").select("l_returnflag", "l_linestatus").distinct()


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_quantity), 6) AS q, max(l_shipdate)::DATE::VARCHAR AS last FROM lineitem GROUP BY 1, 2")
def group_by(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.avg("l_quantity"), 6).alias("q"), F.max("l_shipdate").cast("date").cast("string").alias("last"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def left_anti(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def self_join(spark, d):
    n = table(spark, d, "nation")
    a, b = n.alias("a"), n.alias("b")
    return a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))).select(F.col("a.n_name").alias("a"), F.col("b.n_name").alias("b"))


@query("SELECT n_name, k FROM nation, generate_series(1, 3) AS s(k)")
def cross_series(spark, d):
    return table(spark, d, "nation").select("n_name", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(3).cast("bigint"))).alias("k"))


@query("SELECT o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1")
def row_number(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").withColumn("rn", F.row_number().over(w)).where("rn = 1").select("o_orderkey")


@query("SELECT CASE WHEN l_quantity < 10 THEN 'low' WHEN l_quantity < 40 THEN 'mid' ELSE 'high' END AS band, sum(l_linenumber)::BIGINT AS s FROM lineitem GROUP BY 1")
def case_cast(spark, d):
    band = F.when(F.col("l_quantity") < 10, "low").when(F.col("l_quantity") < 40, "mid").otherwise("high")
    return table(spark, d, "lineitem").groupBy(band.alias("band")).agg(F.sum("l_linenumber").cast("bigint").alias("s"))


@query("SELECT row_id, copy FROM transcripts WHERE db_id IS DISTINCT FROM cds_start")
def is_distinct_from(spark, d):
    return synth.transcripts(spark, d).where(~F.col("db_id").eqNullSafe(F.col("cds_start"))).select("row_id", "copy")


@query(", big AS (SELECT o_custkey, sum(o_totalprice) AS t FROM orders GROUP BY 1) SELECT c_mktsegment, count(*) AS n FROM big JOIN customer ON o_custkey = c_custkey WHERE t > 500000 GROUP BY 1")
def cte(spark, d):
    big = table(spark, d, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("t"))
    return big.where("t > 500000").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(F.count("*").alias("n"))


ORACLES["cte"] = ORACLES["cte"].replace(") , big", "), big")


@query("SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region")
def union_all(spark, d):
    return table(spark, d, "nation").select(F.col("n_name").alias("name")).union(table(spark, d, "region").select("r_name"))


@query("SELECT c_nationkey::BIGINT AS k FROM customer INTERSECT SELECT s_nationkey::BIGINT FROM supplier")
def intersect(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").cast("bigint").alias("k")).intersect(table(spark, d, "supplier").select(F.col("s_nationkey").cast("bigint")))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup(spark, d):
    return table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("SELECT o_custkey, o_orderkey, o_totalprice - lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS diff FROM orders")
def window_lag(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", (F.col("o_totalprice") - F.lag("o_totalprice").over(w)).alias("diff"))


# --- formats: render, write, read, query ---------------------------------------------------------------------------

_INFO = {"DP": {"number": "1", "type": "Integer", "description": "depth"}, "AF": {"number": "A", "type": "Float", "description": "frequency"}, "DB": {"number": "0", "type": "Flag", "description": "known"}}
_FORMAT = {"GT": {"number": "1", "type": "String", "description": "genotype"}, "DP": {"number": "1", "type": "Integer", "description": "depth"}}


def _variants(spark, d, samples: int):
    v = synth.cohort(spark, d)
    return v.select(
        "chrom", "start", (F.col("start") + 1).alias("end"), F.concat(F.lit("rs"), F.col("id").cast("string")).alias("id"), F.lit("A").alias("ref"), F.lit("C|T").alias("alt"),
        (F.col("id") % 100).cast("double").alias("qual"), F.lit("PASS").alias("filter"),
        F.aggregate("DP", F.lit(0), lambda a, x: a + x).alias("DP"), F.array(F.lit(0.25).cast("float"), F.when(F.col("id") % 2 == 0, F.lit(0.5).cast("float"))).alias("AF"), (F.col("id") % 3 == 0).alias("DB"),
        F.struct(F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), lambda k: F.get("GT", k)).alias("GT"), F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), lambda k: F.get(v["DP"], k)).alias("DP")).alias("genotypes"),
    )


def _vcf(spark, d, suffix=".vcf", samples=3, **options):
    path = _scratch(spark, suffix)
    sink.write_vcf(_variants(spark, d, samples), path, _INFO, _FORMAT, [f"S{k}" for k in range(samples)])
    return src.read_vcf(spark, path, **options)


_VCF_SQL = "SELECT 'rs' || id AS id, chrom, start, start + 1 AS \"end\", list_sum(DP)::INT AS DP, (id % 3 = 0) AS DB, (id % 100)::DOUBLE AS qual, 'C|T' AS alt, coalesce(GT[2], './.') AS gt2, DP[3] AS dp3, CASE WHEN id % 2 = 0 THEN 0.5::DOUBLE END AS af2 FROM cohort"


def _vcf_columns(v):
    return v.select("id", "chrom", "start", "end", "DP", "DB", "qual", "alt", F.get("genotypes.GT", 1).alias("gt2"), F.get("genotypes.DP", 2).alias("dp3"), F.get("AF", 1).cast("double").alias("af2"))


@query(_VCF_SQL)
def vcf_read(spark, d):
    return _vcf_columns(_vcf(spark, d))


@query(_VCF_SQL)
def vcf_bgzf(spark, d):
    return _vcf_columns(_vcf(spark, d, ".vcf.gz"))


@query(_VCF_SQL)
def vcf_roundtrip(spark, d):
    first = _vcf(spark, d)
    path = _scratch(spark, ".vcf")
    sink.write_vcf(first, path, formats=_FORMAT)
    return _vcf_columns(src.read_vcf(spark, path))


@query("SELECT chrom, count(*) AS n, count(*) FILTER (WHERE GT[1] = '0/1') AS het FROM cohort GROUP BY chrom")
def vcf_single_sample(spark, d):
    v = _vcf(spark, d, samples=1, info_fields=["DP"])
    return v.groupBy("chrom").agg(F.count("*").alias("n"), F.count(F.when(F.col("GT") == "0/1", 1)).alias("het"))


@query("SELECT 'rs' || id AS id, coalesce(GT[3], './.') || ',' || GT[1] AS gts FROM cohort")
def sample_selection(spark, d):
    v = _vcf_selected(spark, d)
    return v.select("id", F.array_join("genotypes.GT", ",").alias("gts"))


def _vcf_selected(spark, d):
    path = _scratch(spark, ".vcf")
    sink.write_vcf(_variants(spark, d, 3), path, _INFO, _FORMAT, ["S0", "S1", "S2"])
    return src.read_vcf(spark, path, samples=["S2", "S0", "S2", "nobody"], missing_samples="ignore")


def _rendered(spark, lines: DataFrame, suffix: str, header: str = ""):
    path = _scratch(spark, suffix)
    sink.write_parts(lines, path, header)
    return path


def _gff_lines(spark, d):
    i = synth.intervals(spark, d)
    a = F.concat(F.lit("ID=g"), F.col("id").cast("string"), F.lit(";Note=a%3Bb;name=\""), F.col("name"), F.lit("\""))
    return i.select(F.concat_ws("\t", "chrom", F.lit("synth"), F.when(F.col("id") % 2 == 0, "gene").otherwise("exon"), (F.col("start") + 1).cast("string"), F.col("end").cast("string"), F.lit("."), F.lit("+"), F.lit("."), a).alias("value"))


@query("SELECT chrom, start, \"end\", 'g' || id AS gid, 'a;b' AS note FROM intervals")
def gff_flat(spark, d):
    g = src.read_gff(spark, _rendered(spark, _gff_lines(spark, d), ".gff3", "##gff-version 3\n"), ["ID", "Note"])
    return g.select("chrom", "start", "end", F.col("ID").alias("gid"), F.col("Note").alias("note"))


@query("SELECT chrom, start + 1 AS start, 3 AS n, name FROM intervals WHERE id % 2 = 0")
def gff_nested(spark, d):
    g = src.read_gff(spark, _rendered(spark, _gff_lines(spark, d), ".gff3.gz"), zero_based=False)
    return g.where("type = 'gene'").select("chrom", "start", F.size("attributes").alias("n"), F.get("attributes", 2)["value"].alias("name"))


@query("SELECT chrom, count(*) AS n FROM intervals GROUP BY chrom")
def gff_sentinel(spark, d):
    g = src.read_gff(spark, _rendered(spark, _gff_lines(spark, d), ".gff3"), ["ID", "attributes"])
    return g.where(F.size("attributes") == 3).groupBy("chrom").agg(F.count("ID").alias("n"))


@query("SELECT start, 'a' || (id % 5) || ',b' AS tag, 'G' || id AS gene_id FROM intervals")
def gtf_flat_dup(spark, d):
    i = synth.intervals(spark, d)
    a = F.concat(F.lit('gene_id "G'), F.col("id").cast("string"), F.lit('"; tag "a'), (F.col("id") % 5).cast("string"), F.lit('"; tag "b";'))
    rows = i.select(F.concat_ws("\t", "chrom", F.lit("s"), F.lit("gene"), (F.col("start") + 1).cast("string"), F.col("end").cast("string"), F.lit("."), F.lit("-"), F.lit("0"), a).alias("value"))
    return src.read_gtf(spark, _rendered(spark, rows, ".gtf"), ["gene_id", "tag"]).select("start", "tag", "gene_id")


def _bed(spark, d, columns, suffix=".bed", **k):
    i = synth.intervals(spark, d)
    parts = ["chrom", F.col("start").cast("string"), F.col("end").cast("string"), F.col("name"), (F.col("id") % 1000).cast("string"), F.when(F.col("id") % 2 == 0, "+").otherwise("-")]
    rows = i.select(F.concat_ws("\t", *parts[:columns]).alias("value"))
    return src.read_bed(spark, _rendered(spark, rows, suffix), columns, **k)


@query('SELECT chrom, start, "end" FROM intervals')
def bed3(spark, d):
    return _bed(spark, d, 3)


@query('SELECT chrom, start + 1 AS start, "end", name FROM intervals')
def bed4(spark, d):
    return _bed(spark, d, 4, zero_based=False)


@query("SELECT chrom, start, \"end\", name, (id % 1000)::DOUBLE AS score, CASE WHEN id % 2 = 0 THEN '+' ELSE '-' END AS strand FROM intervals")
def bed6(spark, d):
    return _bed(spark, d, 6)


@query('SELECT chrom, start, "end" FROM intervals')
def multimember_gzip(spark, d):
    return _bed(spark, d, 3, ".bed.gz")


@query('SELECT chrom, start, "end" FROM intervals')
def bgzf_read(spark, d):
    path = _scratch(spark, ".bed.gz")
    i = synth.intervals(spark, d)
    sink.write_parts(i.select(F.concat_ws("\t", "chrom", F.col("start").cast("string"), F.col("end").cast("string")).alias("value")), path, compression="bgzf")
    return src.read_bed(spark, path, 3)


@query("SELECT 'r' || l_orderkey AS readID, 'chr' || (l_partkey % 22) AS chr1, l_partkey AS pos1, count(*) AS n FROM lineitem GROUP BY ALL")
def pairs_read(spark, d):
    i = table(spark, d, "lineitem")
    rows = i.select(F.concat_ws("\t", F.concat(F.lit("r"), F.col("l_orderkey").cast("string")), F.concat(F.lit("chr"), (F.col("l_partkey") % 22).cast("string")), F.col("l_partkey").cast("string"), F.lit("chr1"), F.col("l_suppkey").cast("string"), F.lit("+"), F.lit("-")).alias("value"))
    p = src.read_pairs(spark, _rendered(spark, rows, ".pairs", "## pairs format v1.0\n#columns: readID chr1 pos1 chr2 pos2 strand1 strand2\n"))
    return p.groupBy("readID", "chr1", "pos1").agg(F.count("*").alias("n"))


#: One pass over both cases; what is left over becomes N, so every text is a sequence from end to end.
_LETTERS, _BASES = "abcdefghijklmnopqrstuvwxyz .,\n", "ACGTACGTACGTACGTACGTACGTACGTAC"
_READS_SQL = f"reads AS (SELECT 's' || doc_id AS name, 'some read' AS description, regexp_replace(translate(coalesce(text, ''), '{_LETTERS[:26].upper()}{_LETTERS[:-1]}' || chr(10), '{_BASES[:26]}{_BASES}'), '[^ACGT]', 'N', 'g') AS sequence FROM documents)"


def _reads(spark, d):
    """Every document in full length; one without text is an empty sequence."""
    sequence = F.translate(F.coalesce("text", F.lit("")), _LETTERS[:26].upper() + _LETTERS, _BASES[:26] + _BASES)
    t = table(spark, d, "documents").select("doc_id", F.regexp_replace(sequence, "[^ACGT]", "N").alias("sequence"))
    return t.select(F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("name"), F.lit("some read").alias("description"), "sequence", F.repeat(F.lit("I"), F.length("sequence")).alias("quality_scores"))


def fasta_read(spark, d):
    path = _scratch(spark, ".fa")
    sink.write_fasta(_reads(spark, d), path, width=60)
    return src.read_fasta(spark, path)


def fastq_read(spark, d):
    path = _scratch(spark, ".fastq")
    sink.write_fastq(_reads(spark, d), path)
    return src.read_fastq(spark, path).select("name", "description", "sequence")


def fastq_partition_invariance(spark, d):
    """The same records over byte ranges of two sizes, which the longest cross, over BGZF blocks and over one gzip stream."""
    out, paths = None, {}
    for k, (suffix, size) in enumerate(((".fastq", 1 << 18), (".fastq", 1 << 20), (".fastq.bgz", 1 << 18), (".fastq.gz", 1 << 18))):
        if suffix not in paths:
            paths[suffix] = _scratch(spark, suffix)
            sink.write_fastq(_reads(spark, d), paths[suffix])
        one = src.read_fastq(spark, paths[suffix], size, ["sequence"]).agg(F.count("*").alias("n"), F.sum(F.length("sequence")).alias("bases")).select(F.lit(k).alias("k"), "n", "bases")
        out = one if out is None else out.union(one)
    return out


for _f, _sql in (
    (fasta_read, "SELECT * FROM reads"),
    (fastq_read, "SELECT * FROM reads"),
    (fastq_partition_invariance, "SELECT k::INT AS k, count(*) AS n, sum(length(sequence))::BIGINT AS bases FROM reads, generate_series(0, 3) AS s(k) GROUP BY k"),
):
    QUERIES[_f.__name__] = _f
    ORACLES[_f.__name__] = _WITH.rstrip() + ", " + _READS_SQL + " " + _sql


def _alignments(spark, d):
    i = table(spark, d, "lineitem")
    n = F.col("l_quantity").cast("int")
    return i.select(
        F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("name"),
        F.concat(F.lit("chr"), (1 + F.col("l_orderkey") % 3).cast("string")).alias("chrom"), F.col("l_partkey").alias("start"), (F.col("l_partkey") + n).alias("end"),
        (F.col("l_linenumber") * 4).cast("bigint").alias("flags"), F.concat(n.cast("string"), F.lit("M2I")).alias("cigar"), (F.col("l_suppkey") % 60).alias("mapping_quality"),
        F.lit(None).cast("string").alias("mate_chrom"), F.lit(None).cast("bigint").alias("mate_start"), F.concat(F.repeat(F.lit("A"), n), F.lit("CG")).alias("sequence"),
        F.repeat(F.lit("I"), n + 2).alias("quality_scores"), F.lit(0).alias("template_length"), F.col("l_linenumber").alias("NM"), F.col("l_returnflag").alias("RG"),
    )


_ALIGN_SQL = "SELECT 'chr' || (1 + l_orderkey % 3) AS chrom, l_partkey AS start, l_partkey + l_quantity::BIGINT AS \"end\", (l_linenumber * 4)::BIGINT AS flags, l_quantity::INT || 'M2I' AS cigar, l_suppkey % 60 AS mapping_quality, l_linenumber AS NM, l_returnflag AS RG, l_quantity::INT + 2 AS n FROM lineitem"
_REFS = {"chr1": 1 << 28, "chr2": 1 << 28, "chr3": 1 << 28}


def _align_columns(a):
    return a.select("chrom", "start", "end", "flags", "cigar", "mapping_quality", "NM", "RG", F.length("sequence").alias("n"))


@query(_ALIGN_SQL)
def sam_read(spark, d):
    path = _scratch(spark, ".sam")
    sink.write_sam(_alignments(spark, d), path, _REFS, {"NM": "i", "RG": "Z"})
    return _align_columns(src.read_sam(spark, path, {"NM": "i", "RG": "Z"}))


@query("SELECT l_quantity::INT || 'M2I' AS cigar, count(*) AS n FROM lineitem GROUP BY 1")
def cigar_roundtrip(spark, d):
    a = _alignments(spark, d).groupBy("cigar").agg(F.count("*").alias("n"))
    a = a.select(alignment.binary_to_cigar(alignment.cigar_to_binary("cigar")).alias("cigar"), "n")
    return a.groupBy("cigar").agg(F.sum("n").alias("n"))


@query("SELECT l_quantity::INT AS q, (2 + (l_quantity::INT + 3) // 4)::INT AS nm, count(*) AS n FROM lineitem GROUP BY ALL")
def nm_tag(spark, d):
    a = _alignments(spark, d).select("cigar", "sequence", F.repeat(F.lit("CAAA"), 15).alias("reference"), F.col("end") - F.col("start")).toDF("cigar", "sequence", "reference", "q")
    a = a.groupBy("cigar", "sequence", "reference", "q").agg(F.count("*").alias("n"))
    return a.select(F.col("q").cast("int").alias("q"), alignment.nm_and_md("cigar", "sequence", "reference")["nm"].alias("nm"), "n")


@query("SELECT l_quantity::INT AS q, '0C' || repeat('3C', (l_quantity::INT - 1) // 4) || ((l_quantity::INT - 1) % 4) AS md, count(*) AS n FROM lineitem GROUP BY ALL")
def md_tag(spark, d):
    a = _alignments(spark, d).select("cigar", "sequence", F.repeat(F.lit("CAAA"), 15).alias("reference"), (F.col("end") - F.col("start")).cast("int").alias("q"))
    a = a.groupBy("cigar", "sequence", "reference", "q").agg(F.count("*").alias("n"))
    return a.select("q", alignment.nm_and_md("cigar", "sequence", "reference")["md"].alias("md"), "n")


def describe_vcf(spark, d):
    path = _scratch(spark, ".vcf")
    sink.write_vcf(_variants(spark, d, 3), path, _INFO, _FORMAT, ["S0", "S1", "S2"])
    return src.describe_vcf(spark, path)


def describe_sam(spark, d):
    path = _scratch(spark, ".sam")
    sink.write_sam(_alignments(spark, d), path, _REFS, {"NM": "i", "RG": "Z"})
    return src.describe_sam(spark, path)


QUERIES["describe_vcf"] = describe_vcf
QUERIES["describe_sam"] = describe_sam
