"""Relational queries: patterns, joins, grouping, windows, set operations, functions, statements, descriptions, exports."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from . import render, synth
from .binary_queries import _SAMPLES, _cache, _rows
from .operators import dedup, views
from .operators.matrix import matrix_rows
from .queries import _FORMAT, _INFO, _REFS, _alignments, _scratch, _variants, query
from .sinks import lines as sink
from .sources import genotypes, vep
from .sources import text as src
from .sources.binary import register
from .synth import table


def _sql(spark, d, text: str, *names: str):
    """``text`` over temporary views of the named tables."""
    own = {n: f"helixframe_{n}_{uuid.uuid4().hex[:8]}" for n in names}
    for n, view in own.items():
        table(spark, d, n).createOrReplaceTempView(view)
    return spark.sql(text.format(**own))


# --- predicates ----------------------------------------------------------------------------------------------------


@query("SELECT p_partkey FROM part WHERE (p_name LIKE '%ring' OR p_name LIKE 'r_d%') AND p_brand NOT LIKE 'Brand#1_'")
def like(spark, d):
    named = F.col("p_name").like("%ring") | F.col("p_name").like("r_d%")
    return table(spark, d, "part").where(named & ~F.col("p_brand").like("Brand#1_")).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_type ILIKE 'econ%' AND p_name NOT ILIKE '%RING%'")
def ilike(spark, d):
    return table(spark, d, "part").where(F.col("p_type").ilike("econ%") & ~F.col("p_name").ilike("%RING%")).select("p_partkey")


# --- joins ---------------------------------------------------------------------------------------------------------


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def left_semi(spark, d):
    o = table(spark, d, "orders").where("o_totalprice > 400000")
    return table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT n_name, s_suppkey FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey AND s_acctbal > 0")
def right_join(spark, d):
    s = table(spark, d, "supplier").where("s_acctbal > 0")
    return s.join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "right").select("n_name", "s_suppkey")


@query("SELECT coalesce(a.k, b.k)::BIGINT AS k, a.n AS customers, b.n AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal < 1000 GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) b ON a.k = b.k")
def full_join(spark, d):
    a = table(spark, d, "customer").where("c_acctbal < 1000").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("customers"))
    b = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers"))
    return a.join(b, "k", "full").select(F.col("k").cast("bigint").alias("k"), "customers", "suppliers")


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey > r_regionkey")
def theta_join(spark, d):
    """Two tables of fixed size, compared by order."""
    return table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") > F.col("r_regionkey")).select("n_name", "r_name")


_BANDS = "VALUES (0, 10, 'low'), (10, 40, 'mid'), (40, 1000, 'high')"


@query(f"SELECT band, count(*) AS n FROM lineitem JOIN ({_BANDS}) AS b(low, high, band) ON l_quantity >= low AND l_quantity < high GROUP BY band")
def range_join(spark, d):
    return _sql(spark, d, f"SELECT band, count(*) AS n FROM {{lineitem}} JOIN ({_BANDS}) AS b(low, high, band) ON l_quantity >= low AND l_quantity < high GROUP BY band", "lineitem")


# --- grouping ------------------------------------------------------------------------------------------------------


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, (grouping(l_returnflag) * 2 + grouping(l_linestatus))::BIGINT AS g FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube(spark, d):
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))


_SETS = "SELECT l_returnflag, l_linestatus, sum(l_linenumber) AS s FROM {lineitem} GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())"


@query(_SETS.format(lineitem="lineitem").replace("sum(l_linenumber)", "sum(l_linenumber)::BIGINT"))
def grouping_sets(spark, d):
    return _sql(spark, d, _SETS, "lineitem")


@query("SELECT true AS distinct_close, true AS median_close FROM region WHERE r_regionkey = 0")
def approx_aggregates(spark, d):
    """Approximate aggregates lie within their stated errors of the exact ones. Keys and quantities are counted apart: in one
    aggregate with a distinct count every key would carry the buffers of the others.
    """
    t = table(spark, d, "lineitem")
    keys = t.select("l_orderkey").distinct().agg(F.count("l_orderkey").alias("e"))
    exact = t.groupBy("l_quantity").agg(F.count("*").alias("n")).agg(F.percentile("l_quantity", 0.5, F.col("n")).alias("q"))
    near = t.agg(F.approx_count_distinct("l_orderkey", 0.02).alias("a"), F.percentile_approx("l_quantity", 0.5, 10000).alias("p"))
    t = near.crossJoin(keys).crossJoin(exact)
    return t.select((F.abs(F.col("a") - F.col("e")) <= 0.1 * F.col("e")).alias("distinct_close"), (F.abs(F.col("p") - F.col("q")) <= 1).alias("median_close"))


# --- windows -------------------------------------------------------------------------------------------------------

_W = "OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"


@query(f"""SELECT o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus)::INT AS r, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus)::INT AS dr,
  ntile(3) {_W}::INT AS third, lead(o_orderkey) {_W} AS after, first_value(o_orderkey) {_W} AS first, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders""")
def window_ranks(spark, d):
    by = Window.partitionBy("o_custkey")
    w, s = by.orderBy("o_orderdate", "o_orderkey"), by.orderBy("o_orderstatus")
    return table(spark, d, "orders").select("o_orderkey", F.rank().over(s).alias("r"), F.dense_rank().over(s).alias("dr"), F.ntile(3).over(w).alias("third"), F.lead("o_orderkey").over(w).alias("after"), F.first("o_orderkey").over(w).alias("first"), F.count("*").over(by).alias("n"))


@query("""SELECT o_orderkey, sum(o_custkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)::BIGINT AS rows3,
  count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 FOLLOWING) AS so_far,
  count(*) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey RANGE BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS near FROM orders""")
def window_frames(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    r = Window.partitionBy("o_orderstatus").orderBy("o_orderkey").rangeBetween(-10, 10)
    return table(spark, d, "orders").select("o_orderkey", F.sum("o_custkey").over(w.rowsBetween(-2, 0)).alias("rows3"), F.count("*").over(w.rowsBetween(Window.unboundedPreceding, 1)).alias("so_far"), F.count("*").over(r).alias("near"))


# --- sets, limits, order -------------------------------------------------------------------------------------------


@query("SELECT DISTINCT c_nationkey::BIGINT AS k FROM customer EXCEPT SELECT s_nationkey::BIGINT FROM supplier WHERE s_suppkey < 20")
def except_(spark, d):
    s = table(spark, d, "supplier").where("s_suppkey < 20")
    return table(spark, d, "customer").select(F.col("c_nationkey").cast("bigint").alias("k")).subtract(s.select(F.col("s_nationkey").cast("bigint")))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 0")
def limit_zero(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy("o_orderkey").limit(0)


@query("SELECT chrom, start, id, row_number() OVER (ORDER BY chrom, start, id)::BIGINT AS place FROM intervals WHERE chrom IN ('chr1', 'chr2')")
def sort_merge_order(spark, d):
    """Sorted files of two chromosomes, read back in range order: each row's place is that of a total sort."""
    path = _scratch(spark, "-sorted")
    dedup.export(synth.intervals(spark, d).where(F.col("chrom").isin("chr1", "chr2")), path, ("chrom", "start", "id"))
    rows = spark.read.parquet(path).repartitionByRange("chrom", "start", "id").sortWithinPartitions("chrom", "start", "id").withColumn("at", F.monotonically_increasing_id())
    part = F.shiftright("at", 33)
    starts = rows.groupBy(part.alias("p")).agg(F.count("*").alias("c")).select("p", (F.sum("c").over(Window.orderBy("p")) - F.col("c")).alias("before"))  # one row per partition
    placed = rows.withColumn("p", part).join(F.broadcast(starts), "p")
    return placed.select("chrom", "start", "id", (F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("place"))


# --- functions -----------------------------------------------------------------------------------------------------


@query("SELECT c_custkey, md5(c_name) AS m, sha256(c_name) AS s, base64(c_name::BLOB) AS b, lower(hex(c_name::BLOB)) AS h, reverse(upper(c_name)) AS r, lpad(c_custkey::VARCHAR, 8, '0') AS p FROM customer")
def crypto_encoding(spark, d):
    n = F.col("c_name")
    return table(spark, d, "customer").select("c_custkey", F.md5(n).alias("m"), F.sha2(n, 256).alias("s"), F.base64(n.cast("binary")).alias("b"), F.lower(F.hex(n)).alias("h"), F.reverse(F.upper(n)).alias("r"), F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("p"))


@query("SELECT c_custkey, regexp_extract(c_name, '#0*([0-9]+)$', 1) AS num, regexp_replace(c_name, '[aeiou]', '_', 'g') AS v, regexp_matches(c_mktsegment, '^(A|B).*E') AS ab, len(string_split(c_name, '#'))::INT AS parts FROM customer")
def regex(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.regexp_extract("c_name", "#0*([0-9]+)$", 1).alias("num"), F.regexp_replace("c_name", "[aeiou]", "_").alias("v"), F.col("c_mktsegment").rlike("^(A|B).*E").alias("ab"), F.size(F.split("c_name", "#")).alias("parts"))


@query("SELECT o_orderkey, year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m, date_trunc('month', o_orderdate)::DATE::VARCHAR AS t, (o_orderdate::DATE + INTERVAL 30 DAY)::DATE::VARCHAR AS later, date_diff('day', DATE '1995-01-01', o_orderdate::DATE)::INT AS days, strftime(o_orderdate, '%Y/%m/%d') AS f FROM orders")
def dates(spark, d):
    t = F.col("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", F.year(t).alias("y"), F.month(t).alias("m"), F.date_trunc("month", t).cast("date").cast("string").alias("t"), F.date_add(t.cast("date"), 30).cast("string").alias("later"), F.datediff(t.cast("date"), F.lit("1995-01-01").cast("date")).alias("days"), F.date_format(t, "yyyy/MM/dd").alias("f"))


@query("SELECT doc_id, length(text)::INT AS chars, strlen(text)::INT AS bytes, substr(text, 2, 5) AS some, ascii(text)::INT AS code, upper(lang) AS lang FROM documents WHERE text IS NOT NULL AND text <> ''")
def unicode(spark, d):
    t = table(spark, d, "documents").where("text is not null and text <> ''")
    return t.select("doc_id", F.length("text").alias("chars"), F.octet_length("text").alias("bytes"), F.substring("text", 2, 5).alias("some"), F.ascii("text").alias("code"), F.upper("lang").alias("lang"))


@query("SELECT event_id, (props::JSON ->> '$.k')::INT AS k, json_valid(props) AS ok FROM events")
def json_fields(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.from_json("props", "k int").isNotNull().alias("ok"))


@query("SELECT o_custkey, count(DISTINCT o_orderstatus) AS kinds, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o FROM orders GROUP BY 1")
def maps(spark, d):
    per = table(spark, d, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.count("*").alias("n"))
    m = per.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("o_orderstatus", "n"))).alias("m"))
    at = lambda k: F.coalesce(F.try_element_at("m", F.lit(k)), F.lit(0).cast("bigint"))
    return m.select("o_custkey", F.size(F.map_keys("m")).cast("bigint").alias("kinds"), at("F").alias("f"), at("O").alias("o"))


@query("SELECT n_nationkey, n_name AS name, n_regionkey + 1 AS region FROM nation WHERE n_regionkey > 1")
def named_struct(spark, d):
    return _sql(spark, d, "SELECT n_nationkey, s.name, s.region FROM (SELECT n_nationkey, named_struct('name', n_name, 'region', n_regionkey + 1) AS s FROM {nation}) WHERE s.region > 2", "nation")


# --- statements ----------------------------------------------------------------------------------------------------


@query("SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS t FROM orders WHERE o_totalprice > 100000 GROUP BY 1")
def insert_overwrite(spark, d):
    """INSERT OVERWRITE in SQL: what was in the folder is replaced."""
    path = _scratch(spark, "-out")
    orders = f"helixframe_orders_{uuid.uuid4().hex[:8]}"
    table(spark, d, "orders").createOrReplaceTempView(orders)
    for least in (0, 100000):
        spark.sql(f"INSERT OVERWRITE DIRECTORY '{path}' USING parquet SELECT o_orderstatus, o_totalprice FROM {orders} WHERE o_totalprice > {least}")
    return spark.read.parquet(path).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("t"))


# --- descriptions --------------------------------------------------------------------------------------------------


def _values(rows: list[tuple], names: str) -> str:
    def one(x):
        return "NULL" if x is None else str(x).lower() if isinstance(x, bool) else "'" + x + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) AS v({names})"


@query(_values([("DP", "INFO", "int", "depth"), ("AF", "INFO", "array<float>", "frequency"), ("DB", "INFO", "boolean", "known"), ("GT", "FORMAT", "string", "genotype"), ("DP", "FORMAT", "int", "depth")], "name, field_type, data_type, description"))
def describe_vcf_fields(spark, d):
    path = _scratch(spark, ".vcf")
    sink.write_vcf(_variants(spark, d, 3), path, _INFO, _FORMAT, _SAMPLES)
    return src.describe_vcf(spark, path)


@query(_values([("NM", "int", "tag", "i"), ("RG", "string", "tag", "Z"), ("start", "bigint", "core", None), ("sequence", "string", "core", None)], "column_name, data_type, category, sam_type"))
def describe_sam_tags(spark, d):
    path = _scratch(spark, ".sam")
    sink.write_sam(_alignments(spark, d), path, _REFS, {"NM": "i", "RG": "Z"})
    return src.describe_sam(spark, path).where("category = 'tag' or column_name in ('start', 'sequence')").select("column_name", "data_type", "category", "sam_type")


@query(_values([("DP", "INFO", "int"), ("GT", "FORMAT", "string")], "name, field_type, data_type"))
def describe_zarr_fields(spark, d):
    codes = [[0, 0], [0, 1], [1, 1], [-1, -1]]
    rows = [(c, p, i, r, a, dp, [codes[g] for g in gs]) for c, p, i, r, a, dp, gs in _rows(spark, d)]
    path = render.zarr(_scratch(spark, ".zarr"), rows, _SAMPLES, [f"chr{k}" for k in range(5)], chunk=7)
    return genotypes.describe_zarr(spark, path).select("name", "field_type", "data_type")


@query("SELECT DISTINCT (n_regionkey + 1)::VARCHAR AS chrom FROM nation")
def cache_chromosomes(spark, d):
    return spark.createDataFrame([(c,) for c in vep.chromosomes(_cache(spark, d))], "chrom string")


# --- views, matrices, entities, exports ----------------------------------------------------------------------------


@query("SELECT 'S' || k AS sample_id, count(*) AS n, count(*) FILTER (WHERE GT[k] = '0/1') AS hets FROM (SELECT *, unnest(generate_series(1, 7)) AS k FROM cohort) GROUP BY 1")
def long_view_registered(spark, d):
    """The view that registration adds beside a cohort, queried in SQL."""
    name = f"helixframe_{uuid.uuid4().hex[:8]}"
    v = synth.cohort(spark, d).select("chrom", "start", "id", F.struct("GT", "DP").alias("genotypes", metadata={"bio.samples": [f"S{k}" for k in range(1, 8)]}))
    if not views.register_long_view(v, name):
        raise RuntimeError("no long view was made")
    return spark.sql(f"SELECT sample_id, count(*) AS n, count_if(GT = '0/1') AS hets FROM {name}_long GROUP BY sample_id")


_CALLS = "SELECT 'chr' || n_regionkey AS chrom, (1000 * (n_nationkey + 1) - 1)::BIGINT AS start, 'v' || n_nationkey AS id, n_nationkey % 4 AS g FROM nation"


@query(f"SELECT chrom, start, id, CASE WHEN g < 3 THEN g::DOUBLE END AS ds FROM ({_CALLS})")
def bgen_matrix(spark, d):
    rows = [(c, p, i, i, [r, a], [None if g == 3 else g for g in gs]) for c, p, i, r, a, _, gs in _rows(spark, d)]
    path = render.bgen(_scratch(spark, ".bgen"), rows, _SAMPLES, compression=1, bits=8)
    return matrix_rows(spark, path, "DS").select("chrom", "start", "id", F.round(F.get("values", 0).cast("double"), 2).alias("ds"))


def _features(spark, d) -> str:
    """A cache with regulatory features and motifs: one of each per nation."""
    import gzip

    root = _scratch(spark, "")
    render._write(f"{root}/info.txt", b"species\thomo_sapiens\nassembly\tGRCh38\ncache_version\t115\ncache_region_size\t1000000\n")
    found: dict = {}
    for r, k, x in table(spark, d, "nation").select("n_regionkey", "n_nationkey", "n_name").orderBy("n_nationkey").collect():
        kinds = found.setdefault(str(r + 1), {"RegulatoryFeature": [], "MotifFeature": []})
        kinds["RegulatoryFeature"].append({"stable_id": f"R{k}", "start": 100 * k + 1, "end": 100 * k + 50, "strand": 0, "feature_type": "promoter" if k % 2 else {"name": "enhancer"}, "dbID": k})
        kinds["MotifFeature"].append({"stable_id": f"M{k}", "start": 100 * k + 5, "end": 100 * k + 15, "strand": 1 - 2 * (k % 2), "binding_matrix": {"stable_id": x}, "score": str(k / 4), "dbID": k})
    for chrom, kinds in found.items():
        render._write(f"{root}/{chrom}/1-1000000_reg.gz", gzip.compress(render.storable({chrom: kinds}), mtime=0))
    return root


@query("SELECT (n_regionkey + 1)::VARCHAR AS chrom, (100 * n_nationkey + 1)::BIGINT AS start, 'R' || n_nationkey AS id, CASE WHEN n_nationkey % 2 = 1 THEN 'promoter' ELSE 'enhancer' END AS kind, n_nationkey::BIGINT AS db FROM nation")
def vep_regulatory(spark, d):
    register(spark)
    v = spark.read.format("vep_cache").option("entity", "regulatory").load(_features(spark, d))
    return v.select("chrom", "start", F.col("stable_id").alias("id"), F.col("feature_type").alias("kind"), F.col("db_id").alias("db"))


@query("SELECT (n_regionkey + 1)::VARCHAR AS chrom, (100 * n_nationkey + 15)::BIGINT AS \"end\", 'M' || n_nationkey AS id, n_name AS matrix, n_nationkey::DOUBLE / 4 AS score FROM nation")
def vep_motif(spark, d):
    """Entities without duplicates pass through the export as they are."""
    register(spark)
    path = _scratch(spark, "-motif")
    dedup.export(spark.read.format("vep_cache").option("entity", "motif").load(_features(spark, d)), path)
    return spark.read.parquet(path).select("chrom", "end", F.col("motif_id").alias("id"), F.col("binding_matrix").alias("matrix"), "score")


@query('SELECT chrom, count(*) AS n, min(start) AS low, max("end") AS high, sum(id)::BIGINT AS ids FROM intervals GROUP BY chrom')
def parquet_export(spark, d):
    path = _scratch(spark, "-export")
    dedup.export(synth.intervals(spark, d), path, rows_per_file=5000)
    return spark.read.parquet(path).groupBy("chrom").agg(F.count("*").alias("n"), F.min("start").alias("low"), F.max("end").alias("high"), F.sum("id").alias("ids"))
