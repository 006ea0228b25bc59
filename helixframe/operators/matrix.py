"""Dense genotype matrices, variants by samples, from PGEN and BGEN."""

from __future__ import annotations

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def matrix_shape(path: str) -> tuple[int, int]:
    """(variants, samples), from headers alone."""
    from helixframe.sources.genotypes import Bgen, Pgen

    f = Pgen(path) if path.endswith(".pgen") else Bgen(path)
    return (len(f.variants), f.n) if path.endswith(".pgen") else (f.variants, f.n)


def matrix_rows(spark: SparkSession, path: str, field: str = "ALT_COUNT"):
    """(row, values) as a DataFrame: the distributed form, for use at any size. Missing: null."""
    from helixframe.sources.binary import register

    register(spark)
    kind = "pgen" if path.endswith(".pgen") else "bgen"
    df = spark.read.format(kind).option("genotypeFields", field).load(path)
    return df.select("chrom", "start", "id", F.col("genotypes").getField(field).alias("values"))


def read_matrix(spark: SparkSession, path: str, field: str = "ALT_COUNT") -> np.ndarray:
    """The matrix in the caller's memory: int8 with -1, or float32 with nan, for missing.

    Rows are packed by the tasks, a batch to a block of bytes; the caller copies blocks, a partition at a time.
    """
    shape = matrix_shape(path)
    kind, missing = (np.int8, -1) if field == "ALT_COUNT" else (np.float32, np.nan)

    def pack(batches):
        import pyarrow as pa

        for b in batches:
            lists = b.column(0)
            flat = lists.flatten().fill_null(missing).to_numpy(zero_copy_only=False).astype(kind)
            yield pa.RecordBatch.from_arrays([pa.array([len(lists)], pa.int64()), pa.array([flat.tobytes()], pa.binary())], names=["n", "block"])

    out, at = np.full(shape, missing, kind), 0
    for n, block in matrix_rows(spark, path, field).select("values").mapInArrow(pack, "n long, block binary").toLocalIterator(prefetchPartitions=True):
        out[at : at + n] = np.frombuffer(block, kind).reshape(n, shape[1])
        at += n
    return out
