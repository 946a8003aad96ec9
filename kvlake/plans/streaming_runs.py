"""Streams over stored tables, run to their end, so that a query can return what they made.

Sinks and checkpoints are below ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.resolve import newest
from ..sources.files import scratch
from ..streaming import state as streams


def responses(spark: SparkSession, log: DataFrame) -> DataFrame:
    work = scratch(spark, "responses")
    log.write.parquet(f"{work}/log")
    stream = spark.readStream.schema(log.schema).parquet(f"{work}/log")
    seen = lambda batch, epoch: batch.write.mode("append").parquet(f"{work}/out")
    q = streams.keyed_responses(stream).writeStream.foreachBatch(seen).outputMode("update").option("checkpointLocation", f"{work}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return newest(spark.read.schema(streams.OUT).parquet(f"{work}/out"), ["seq"])


def hourly(spark: SparkSession, events: DataFrame) -> DataFrame:
    """Hourly counts in complete mode, which holds every window whatever the watermark."""
    work = scratch(spark, "hourly")
    events.write.parquet(f"{work}/events")
    stream = spark.readStream.schema(events.schema).parquet(f"{work}/events")
    out = streams.windowed_counts(stream, "1 hour", late="2 hours").drop("total")
    seen = lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{work}/out")
    q = out.writeStream.foreachBatch(seen).outputMode("complete").option("checkpointLocation", f"{work}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{work}/out")


def hourly_append(spark: SparkSession, events: DataFrame, late_events: DataFrame) -> DataFrame:
    """Hourly counts in append mode: ``events`` come first, ``late_events`` after them. A window is put out once the watermark has passed its end, and what comes for it later is dropped."""
    work = scratch(spark, "late")

    def run() -> None:
        stream = spark.readStream.schema(events.schema).parquet(f"{work}/events")
        out = streams.windowed_counts(stream, "1 hour", late="2 hours").drop("total")
        seen = lambda batch, epoch: batch.write.mode("append").parquet(f"{work}/out")
        q = out.writeStream.foreachBatch(seen).outputMode("append").option("checkpointLocation", f"{work}/state").trigger(availableNow=True).start()
        q.awaitTermination()

    for part in (events, late_events):
        part.write.mode("append").parquet(f"{work}/events")
        run()
    return spark.read.schema("start timestamp_ntz, stop timestamp_ntz, n long").parquet(f"{work}/out")
