"""Session settings, shared storage and code shipping."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings the engine wants; all can be set on a running session.
SQL_CONF = {
    "spark.sql.caseSensitive": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.python.filterPushdown.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


#: Rows of a batch that goes to Python, unless the session says otherwise.
BATCH_ROWS = 1024
#: Bytes of such a batch, unless the session says otherwise; a longer row is a batch of its own.
BATCH_BYTES = 1 << 20


def builder(app: str = "helixframe") -> SparkSession.Builder:
    """A session builder with the engine's settings; master and sizes stay with the caller."""
    return SparkSession.builder.appName(app).config(map=SQL_CONF)


def shared_dir(spark: SparkSession) -> str:
    """A folder that driver and executors all reach.

    It is ``spark.checkpoint.dir`` of the session. Where that is unset, a session on one machine gets a temporary folder, once
    for a SparkContext; on a cluster, where executors would write to disks that others cannot see, it is an error.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="helixframe-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def materialise(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: a cut of lineage that survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/helixframe/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._helixframe_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what materialise() wrote, once nothing reads it any more."""
    for df in tables:
        path = getattr(df, "_helixframe_path", None)
        if path:
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for a SparkContext, for Python stages there."""
    sizes = {"maxRecordsPerBatch": BATCH_ROWS, "maxBytesPerBatch": BATCH_BYTES}
    if not getattr(spark, "_helixframe_batches", False):
        spark._helixframe_batches = True
        # long texts want less than the default; whoever set a value, the default's included, keeps it
        for name, size in sizes.items():
            key = f"spark.sql.execution.arrow.{name}"
            if key not in spark.conf.getAll:
                spark.conf.set(key, str(size))
    sc = spark.sparkContext
    if getattr(sc, "_helixframe_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="helixframe-code-"), "helixframe_code.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"helixframe/{p.relative_to(root)}")
    sc.addPyFile(target)
    sc._helixframe_shipped = True
