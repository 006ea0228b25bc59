"""Queries over binary formats: derived rows are rendered to a file, read back through the source, and compared in SQL."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Window
from pyspark.sql import functions as F

from . import render
from .operators.matrix import matrix_rows, matrix_shape
from .queries import _ALIGN_SQL, _REFS, _align_columns, _alignments, _scratch, query
from .sources import alignments, vep
from .sources.binary import register
from .sources.indexes import build_bai
from .synth import table

_SAMPLES = ["S0", "S1", "S2"]


def _rows(spark, d) -> list[tuple]:
    """Nations and their suppliers' region as variants: a table of fixed size, so it may come to the driver."""
    n = table(spark, d, "nation").select("n_nationkey", "n_regionkey", "n_name").orderBy("n_nationkey").collect()
    return [(f"chr{r[1]}", 1000 * (r[0] + 1), f"v{r[0]}", "A", "C", r[0], [(r[0] + k) % 4 for k in range(3)]) for r in n]


_CALLS = "SELECT 'chr' || n_regionkey AS chrom, (1000 * (n_nationkey + 1) - 1)::BIGINT AS start, 'v' || n_nationkey AS id, (n_nationkey + 1) % 4 AS g FROM nation"
_TEXT = "['0/0', '0/1', '1/1', './.']"
_CODES = ["0/0", "0/1", "1/1", "./."]


@query(_ALIGN_SQL)
def bam_read(spark, d):
    path = _scratch(spark, ".bam")
    alignments.write_bam(_alignments(spark, d), path, _REFS, {"NM": "i", "RG": "Z"})
    register(spark)
    return _align_columns(spark.read.format("bam").option("tags", "NM=i,RG=Z").option("splitBytes", 1 << 20).load(path))


def _sorted_bam(spark, d) -> str:
    path = _scratch(spark, ".bam")
    alignments.write_bam(_alignments(spark, d), path, _REFS, {"NM": "i"}, sort=True)
    return path


@query("SELECT 'chr' || (1 + l_orderkey % 3) AS name, count(*) AS n, 0::BIGINT AS out_of_order FROM lineitem GROUP BY 1")
def bam_sorted(spark, d):
    """Sorted on write: in the file's own order no record stands before one of a smaller start. Tasks compare within their part of
    the file, and what meets at the parts' edges is compared behind them.
    """
    register(spark)
    rows = spark.read.format("bam").option("columns", "chrom,start").option("splitBytes", 1 << 20).load(_sorted_bam(spark, d))
    parts = rows.select("chrom", "start").mapInArrow(_compared, "name string, part int, n bigint, wrong bigint, first bigint, last bigint")
    edge = F.lag("last").over(Window.partitionBy("name").orderBy("part")) > F.col("first")
    parts = parts.withColumn("edge", F.coalesce(edge.cast("bigint"), F.lit(0)))
    return parts.groupBy("name").agg(F.sum("n").alias("n"), F.sum(F.col("wrong") + F.col("edge")).alias("out_of_order"))


def _compared(batches):
    """For a task's chromosomes: records, starts below that of the record before, the first start and the last."""
    from pyspark import TaskContext

    found: dict = {}
    for b in batches:
        for c in pc.unique(b["chrom"]).to_pylist():
            starts = b["start"].filter(pc.is_null(b["chrom"]) if c is None else pc.fill_null(pc.equal(b["chrom"], c), False))
            one = found.setdefault(c, [0, 0, starts[0].as_py(), starts[0].as_py()])
            before = pa.concat_arrays([pa.array([one[3]], pa.int64()), starts[:-1]])
            one[0] += len(starts)
            one[1] += pc.sum(pc.greater(before, starts)).as_py() or 0
            one[3] = starts[-1].as_py()
    rows = [(c, TaskContext.get().partitionId(), *x) for c, x in found.items()]
    types = [pa.string(), pa.int32(), *[pa.int64()] * 4]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=["name", "part", "n", "wrong", "first", "last"])


@query("SELECT l_partkey AS start, l_linenumber AS NM, count(*) AS n FROM lineitem WHERE 1 + l_orderkey % 3 = 2 AND l_partkey BETWEEN 300 AND 900 GROUP BY ALL")
def bam_region(spark, d):
    """A region of a sorted file, read by the chunks of its BAI."""
    path = _sorted_bam(spark, d)
    build_bai(path, spark)
    register(spark)
    v = spark.read.format("bam").option("tags", "NM=i").option("columns", "chrom,start,NM").load(path)
    return v.where("chrom = 'chr2' and start >= 300 and start <= 900").groupBy("start", "NM").agg(F.count("*").alias("n"))


@query("SELECT 'chr' || n_regionkey AS chrom, (n_nationkey * 10)::BIGINT AS start, (n_nationkey * 10 + 10)::BIGINT AS \"end\", n_nationkey::DOUBLE / 2 AS value FROM nation")
def bigwig_read(spark, d):
    n = table(spark, d, "nation").select("n_regionkey", "n_nationkey").collect()
    path = render.bigwig(_scratch(spark, ".bw"), [(f"chr{r}", k * 10, k * 10 + 10, k / 2) for r, k in n], {f"chr{k}": 10_000 for k in range(5)})
    register(spark)
    return spark.read.format("bigwig").load(path).select("chrom", "start", "end", F.col("value").cast("double").alias("value"))


@query("SELECT 'chr' || n_regionkey AS chrom, (n_nationkey * 10 + 1)::BIGINT AS start, n_name AS name, n_nationkey AS score FROM nation WHERE n_regionkey = 2")
def bigbed_read(spark, d):
    n = table(spark, d, "nation").select("n_regionkey", "n_nationkey", "n_name").collect()
    sql = 'table t "t"\n(\nstring chrom; "c"\nuint chromStart; "s"\nuint chromEnd; "e"\nstring name; "n"\nint score; "s"\n)\n'
    path = render.bigbed(_scratch(spark, ".bb"), [(f"chr{r}", k * 10, k * 10 + 10, f"{x}\t{k}") for r, k, x in n], {f"chr{k}": 10_000 for k in range(5)}, sql, 5)
    register(spark)
    return spark.read.format("bigbed").option("zeroBased", "false").load(path).where("chrom = 'chr2'").select("chrom", "start", "name", "score")


@query(f"SELECT chrom, start, id, CASE WHEN g < 3 THEN g::DOUBLE END AS ds FROM ({_CALLS})")
def bgen_read(spark, d):
    rows = [(c, p, i, i, [r, a], [None if g == 3 else g for g in gs]) for c, p, i, r, a, _, gs in _rows(spark, d)]
    path = render.bgen(_scratch(spark, ".bgen"), rows, _SAMPLES, compression=2, bits=11)
    register(spark)
    return spark.read.format("bgen").option("genotypeFields", "DS").load(path).select("chrom", "start", "id", F.round(F.get("genotypes.DS", 1).cast("double"), 6).alias("ds"))


def _pgen(spark, d) -> str:
    rows = [(c, p, i, r, a, [None if g == 3 else g for g in gs]) for c, p, i, r, a, _, gs in _rows(spark, d)]
    return render.pgen(_scratch(spark, ".pgen"), rows, _SAMPLES)


@query(f"SELECT chrom, start, id, {_TEXT}[g + 1] AS gt FROM ({_CALLS}) WHERE chrom IN ('chr1', 'chr3') AND start >= 3000")
def pgen_read(spark, d):
    register(spark)
    v = spark.read.format("pgen").load(_pgen(spark, d)).where("chrom IN ('chr1', 'chr3') AND start >= 3000")
    g = F.get("genotypes.GT", 1)
    return v.select("chrom", "start", "id", F.coalesce(F.array_join(g.cast("array<string>"), "/"), F.lit("./.")).alias("gt"))


@query(f"SELECT chrom, start, id, coalesce((CASE WHEN g < 3 THEN g END)::INT, -1) AS a FROM ({_CALLS})")
def genotype_matrix(spark, d):
    path = _pgen(spark, d)
    assert matrix_shape(path)[1] == len(_SAMPLES)
    return matrix_rows(spark, path).select("chrom", "start", "id", F.coalesce(F.get("values", 1).cast("int"), F.lit(-1)).alias("a"))


@query(f"SELECT chrom, start, id, {_TEXT}[g + 1] AS gt, substr(id, 2)::INT AS dp FROM ({_CALLS})")
def bcf_read(spark, d):
    rows = [(c, p, i, r, a, dp, [_CODES[g] for g in gs]) for c, p, i, r, a, dp, gs in _rows(spark, d)]
    path = render.bcf(_scratch(spark, ".bcf"), rows, _SAMPLES, [f"chr{k}" for k in range(5)])
    register(spark)
    return spark.read.format("bcf").load(path).select("chrom", "start", "id", F.get("genotypes.GT", 1).alias("gt"), F.col("DP").alias("dp"))


@query(f"SELECT chrom, start, id, coalesce((CASE WHEN g < 3 THEN g END)::INT, -1) AS ds FROM ({_CALLS})")
def bcf_dosage(spark, d):
    rows = [(c, p, i, r, a, dp, [_CODES[g] for g in gs]) for c, p, i, r, a, dp, gs in _rows(spark, d)]
    path = render.bcf(_scratch(spark, ".bcf"), rows, _SAMPLES, [f"chr{k}" for k in range(5)])
    register(spark)
    v = spark.read.format("bcf").option("dosage", "true").load(path)
    return v.select("chrom", "start", "id", F.coalesce(F.get("genotypes.GT", 1).cast("int"), F.lit(-1)).alias("ds"))


@query(f"SELECT chrom, start, id, {_TEXT}[g + 1] AS gt, substr(id, 2)::INT AS dp FROM ({_CALLS})")
def zarr_read(spark, d):
    codes = [[0, 0], [0, 1], [1, 1], [-1, -1]]
    rows = [(c, p, i, r, a, dp, [codes[g] for g in gs]) for c, p, i, r, a, dp, gs in _rows(spark, d)]
    path = render.zarr(_scratch(spark, ".zarr"), rows, _SAMPLES, [f"chr{k}" for k in range(5)], chunk=7)
    register(spark)
    return spark.read.format("vcf_zarr").load(path).select("chrom", "start", "id", F.get("genotypes.GT", 1).alias("gt"), F.col("DP").alias("dp"))


def _cache(spark, d) -> str:
    n = table(spark, d, "nation").select("n_regionkey", "n_nationkey", "n_name").orderBy("n_nationkey").collect()
    transcripts: dict = {}
    variation: dict = {}
    for r, k, x in n:
        exons = [{"start": 1000 * k + 10 * e, "end": 1000 * k + 10 * e + 5, "stable_id": f"E{k}_{e}", "phase": e % 3} for e in range(1, 4)]
        transcripts.setdefault(str(r + 1), []).append({"stable_id": f"T{k}", "start": 1000 * k + 1, "end": 1000 * k + 900, "strand": 1 - 2 * (k % 2), "biotype": "protein_coding" if k % 5 else "pseudogene", "dbID": k, "_trans_exon_array": exons, "cdna_coding_start": 3, "cdna_coding_end": 302, "translation": {"stable_id": f"P{k}"}, "_gene_symbol": x})
        variation.setdefault(str(r + 1), []).append("\t".join([str(r + 1), f"rs{k}", str(1000 * k + 5), "." if k % 2 else str(1000 * k + 6), "A/C", "." if k % 3 else "0.25"]))
    return render.vep_cache(_scratch(spark, ""), transcripts, variation, "chr,variation_name,start,end,allele_string,minor_allele_freq")


def _entity(spark, d, entity: str):
    register(spark)
    return spark.read.format("vep_cache").option("entity", entity).load(_cache(spark, d))


@query("SELECT (n_regionkey + 1)::VARCHAR AS chrom, (1000 * n_nationkey + 5)::BIGINT AS start, (1000 * n_nationkey + 5 + (1 - n_nationkey % 2))::BIGINT AS \"end\", 'rs' || n_nationkey AS name, CASE WHEN n_nationkey % 3 = 0 THEN 0.25::DOUBLE END AS maf, 0 AS bin FROM nation WHERE n_regionkey < 3")
def vep_variation(spark, d):
    v = vep.read_variation(spark, _cache(spark, d), chroms=["1", "2", "3"])
    return v.select("chrom", "start", "end", F.col("variation_name").alias("name"), F.col("minor_allele_freq").alias("maf"), F.col("region_bin").cast("int").alias("bin"))


@query("SELECT (n_regionkey + 1)::VARCHAR AS chrom, (1000 * n_nationkey + 1)::BIGINT AS start, 'T' || n_nationkey AS id, (1 - 2 * (n_nationkey % 2))::INT AS strand, n_name AS symbol, 3 AS exons FROM nation WHERE n_nationkey % 5 <> 0")
def vep_transcript(spark, d):
    return _entity(spark, d, "transcript").select("chrom", "start", F.col("stable_id").alias("id"), F.col("strand").cast("int").alias("strand"), F.col("gene_symbol").alias("symbol"), F.size("exons").alias("exons"))


@query("SELECT 'T' || n_nationkey AS id, e::INT AS number, (1000 * n_nationkey + 10 * e)::BIGINT AS start, 'E' || n_nationkey || '_' || e AS exon FROM nation, generate_series(1, 3) AS s(e) WHERE n_nationkey % 5 <> 0")
def vep_exon(spark, d):
    return _entity(spark, d, "exon").select(F.col("transcript_id").alias("id"), F.col("exon_number").cast("int").alias("number"), "start", F.col("stable_id").alias("exon"))


@query("SELECT 'T' || n_nationkey AS id, 'P' || n_nationkey AS protein, 300 AS cds FROM nation WHERE n_nationkey % 5 <> 0")
def vep_translation(spark, d):
    return _entity(spark, d, "translation").select(F.col("transcript_id").alias("id"), F.col("stable_id").alias("protein"), F.col("cds_len").cast("int").alias("cds"))


