"""The change log (append, rotate and replay) and snapshots (write and restore)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import LOG_SCHEMA
from ..operators.resolve import newest
from . import files


def _segments(spark: SparkSession, path: str) -> list[int]:
    fs, p = files._fs(spark, path)
    if not fs.exists(p):
        return []
    return sorted(int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(p) if s.getPath().getName().startswith("segment="))


def append_log(changes: DataFrame, path: str) -> None:
    """Adds to the log's open segment; durable once the write's commit is there."""
    open_ = (_segments(changes.sparkSession, path) or [0])[-1]
    changes.write.mode("append").parquet(f"{path}/segment={open_}")


def log_stream(changes: DataFrame, path: str, checkpoint: str, every: str = "5 seconds"):
    """The log's asynchronous form: a stream of changes, appended each ``every``. Not started yet."""

    def put(batch: DataFrame, epoch: int) -> None:
        append_log(batch, path)

    return changes.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(processingTime=every)


def rotate_log(spark: SparkSession, path: str) -> int:
    """Opens a new segment; returns its number. Earlier ones stay until ``drop_log``."""
    new = (_segments(spark, path) or [-1])[-1] + 1
    fs, p = files._fs(spark, f"{path}/segment={new}")
    fs.mkdirs(p)
    return new


def drop_log(spark: SparkSession, path: str, before: int) -> None:
    """Removes the segments below ``before``, once what they hold is in a snapshot or a run."""
    for s in _segments(spark, path):
        if s < before:
            files.delete(spark, f"{path}/segment={s}")


def read_log(spark: SparkSession, path: str, schema: str = LOG_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)


def replay(entries: DataFrame, now: int, order: list[str] | None = None) -> DataFrame:
    """State from logged records (key, value, expiry, state, seq): past ones are skipped, the last of each key counts."""
    return newest(entries.filter(F.col("expiry") >= F.lit(now)), order or ["seq"])


def snapshot(state: DataFrame, path: str, now: int, *, codec: str = "lz4_raw") -> DataFrame:
    """Writes all that has not expired as the next version below ``path``. One row: count, bytes, code.

    A version counts once its write is committed, and earlier ones go only then; so there is a whole
    snapshot at every moment after the first.
    """
    spark, path = state.sparkSession, path.rstrip("/")
    known = files.versions(spark, path, "snapshot")
    new = f"{path}/snapshot-{(known or [0])[-1] + 1}"
    state.filter(F.col("expiry") >= F.lit(now)).write.mode("overwrite").option("compression", codec).parquet(new)
    for v in known:
        files.delete(spark, f"{path}/snapshot-{v}")
    n, size = spark.read.schema(state.schema).parquet(new).count(), files.size(spark, new)
    return spark.range(1).select(F.lit(n).cast("long").alias("count"), F.lit(size).cast("long").alias("bytes"), F.lit(201).alias("code"))


def snapshot_rows(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the newest whole snapshot."""
    known = files.versions(spark, path.rstrip("/"), "snapshot")
    if not known:
        raise ValueError(f"no snapshot below {path}")
    return files.reader(spark).parquet(f"{path.rstrip('/')}/snapshot-{known[-1]}")


def restore(spark: SparkSession, path: str, now: int) -> DataFrame:
    """What the newest snapshot holds that expires after this second."""
    return snapshot_rows(spark, path).filter(F.col("expiry") > F.lit(now))


def restore_and_replay(spark: SparkSession, path: str, entries: DataFrame, now: int) -> DataFrame:
    """A snapshot with the log after it: any logged version of a key is newer than the snapshot's."""
    old = restore(spark, path, now).select("key", "value", "expiry", "state").withColumn("seq", F.lit(-1).cast("long"))
    return newest(old.unionByName(entries.filter(F.col("expiry") >= F.lit(now)).select("key", "value", "expiry", "state", "seq")), ["seq"]).drop("seq")
