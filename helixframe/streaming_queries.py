"""Streaming queries: run to the end of what is there, then compared as tables."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from .queries import _scratch, query
from .streaming.windows import windowed_counts
from .synth import table


@query("SELECT date_trunc('hour', ts)::VARCHAR AS start, event_type AS key, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_windows(spark, d):
    source = f"{d}/events.parquet"
    folder = source if not source.startswith("/") or os.path.isdir(source) else None
    reader = spark.readStream.schema(table(spark, d, "events").schema)
    stream = reader.parquet(folder) if folder else reader.option("pathGlobFilter", "events.parquet").parquet(d)
    out = _scratch(spark, "-stream")

    def put(batch, _):
        """Each run replaces the table of all windows; executors write it, nothing gathers on the driver."""
        batch.write.mode("overwrite").parquet(f"{out}/table")

    q = windowed_counts(stream).writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{out}/table").select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "key", "n", F.round("total", 4).alias("total"))
