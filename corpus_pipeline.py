"""From documents to a training mixture: toxicity, line dedup, near-dedup, decontamination, mixing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir), works on all rows that its predecessor kept and
returns a DataFrame that is written as Parquet before the next one reads it. All but the last return the columns of documents.

What the stages decide: documents predicted toxic go; later copies of repeated line runs are cut from the texts; of each
near-duplicate group (five-word shingles, similarity 0.8) the document with the smallest doc_id stays; benchmark
passages are cut from the texts; the mix says how often each document is taken and into which shards. A document whose text
is cut away entirely stays as an empty row, which the mix never takes. ``n_chars`` follows the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import discard, materialise, table
from helixframe.llm.op02_decontamination import decontaminate
from helixframe.llm.op03_near_dedup import near_dedup
from helixframe.llm.op04_toxicity import learn, toxicity
from helixframe.llm.op08_line_dedup import line_dedup
from helixframe.llm.op10_mixing import mix

#: These stages have no SQL form.
ORACLE_SQL = None


def _like(docs: DataFrame, out: DataFrame, text: Column) -> DataFrame:
    """The columns of ``docs`` from struct ``row`` of ``out``, with a new text."""
    new = {"text": text, "n_chars": F.length(text).cast("bigint")}
    return out.select(*[new[c].alias(c) if c in new else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = learn(docs, table(spark, sf_dir, "labels"))
    scored = toxicity(docs, model, with_spans=False)
    return _like(docs, scored.where("toxicity.score < 0.5"), F.col("text"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _like(docs, line_dedup(docs), F.col("dedup.text"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = near_dedup(docs)
    gone = materialise(found.where(~F.col("kept")).select(F.col("doc_id").alias("id_"), "t1", "t2").distinct(), "pipeline-copies")
    discard(found)
    here = F.col("doc_id").eqNullSafe(F.col("id_")) & (F.xxhash64("text") == F.col("t1")) & (F.xxhash64(F.lit(7), "text") == F.col("t2"))
    return docs.join(gone, here, "left_anti")


def cut_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _like(docs, decontaminate(docs, table(spark, sf_dir, "benchmark")), F.col("leaks.text"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = mix(docs, keep_row=True)
    return out.select("doc_id", "row.lang", "source", "row.text", "size", "source_size", "target", "copies", "taken", "places")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", cut_benchmarks),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(before)
    return docs


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir)
