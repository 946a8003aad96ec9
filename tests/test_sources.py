"""Sinks that are written and read back: the segmented log, snapshots, and streams into runs."""

import pytest
from pyspark.sql import functions as F

from kvlake.model import NEVER
from kvlake.sources import changelog, files
from kvlake.sources.runs import RunStore
from kvlake.streaming import state as streams

RECORDS = "key string, value string, expiry long, state tinyint, seq long"


def records(spark, *rows):
    return spark.createDataFrame([(k, v, NEVER, 0, s) for k, v, s in rows], RECORDS)


def test_log_segments(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    changelog.append_log(records(spark, ("a", "1", 1)), path)
    changelog.append_log(records(spark, ("a", "2", 2)), path)
    assert changelog.rotate_log(spark, path) == 1
    changelog.append_log(records(spark, ("b", "3", 3)), path)
    read = lambda: {(r.key, r.value) for r in changelog.replay(changelog.read_log(spark, path, RECORDS), 0).collect()}
    assert read() == {("a", "2"), ("b", "3")}
    changelog.drop_log(spark, path, 1)
    assert read() == {("b", "3")}


def test_log_stream(spark, tmp_path):
    path = f"file://{tmp_path}"
    records(spark, ("a", "1", 1), ("b", "2", 2)).write.parquet(f"{path}/in")
    q = changelog.log_stream(spark.readStream.schema(RECORDS).parquet(f"{path}/in"), f"{path}/log", f"{path}/state", "1 second").start()
    q.processAllAvailable()
    q.stop()
    assert changelog.read_log(spark, f"{path}/log", RECORDS).count() == 2


def test_snapshot_versions(spark, tmp_path):
    path = f"file://{tmp_path}/snap"
    with pytest.raises(ValueError):
        changelog.snapshot_rows(spark, path)
    changelog.snapshot(records(spark, ("a", "1", 1)), path, 5)
    # a write that was cut off does not count
    records(spark, ("z", "9", 9)).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{path}/snapshot-2")
    assert [r.key for r in changelog.snapshot_rows(spark, path).collect()] == ["a"]
    changelog.snapshot(changelog.snapshot_rows(spark, path).unionByName(records(spark, ("b", "2", 2))), path, 5)
    assert files.versions(spark, path, "snapshot") == [2] and changelog.restore(spark, path, 5).count() == 2


def test_filters_on_dictionaries_of_many_kilobytes(spark, tmp_path):
    """A dictionary of over 8 KiB, which LZ4_RAW pages can't be filtered by."""
    path, n = f"file://{tmp_path}", 40_000
    rows = spark.range(0, n, 1, 1).select(F.format_string("k%06d", "id").alias("key"), F.col("id").cast("string").alias("value"), (F.col("id") % 4000 + 1).alias("expiry"), F.lit(0).cast("tinyint").alias("state"))
    changelog.snapshot(rows, f"{path}/snap", 1)
    assert changelog.restore(spark, f"{path}/snap", 1000).count() == n * 3 // 4
    store = RunStore(spark, f"{path}/runs")
    store.flush(rows, 1)
    assert store.versions().filter("expiry > 1000").count() == store.read(1).filter("expiry > 1000").count() == n * 3 // 4


def test_stream_to_runs_with_a_supervisor(spark, tmp_path):
    path = f"file://{tmp_path}"
    records(spark, ("a", "1", 1), ("b", "1", 2)).write.mode("append").parquet(f"{path}/in")
    store, failures = RunStore(spark, f"{path}/runs"), [0]
    flush = store.flush

    def failing(*args):
        failures[0] += 1
        if failures[0] <= streams.ATTEMPTS + 1:
            records(spark, ("x", "left", 0)).write.mode("overwrite").parquet(f"{path}/runs/run=1")
            raise OSError("disk")
        return flush(*args)

    store.flush = failing
    stream = spark.readStream.schema(RECORDS).parquet(f"{path}/in")
    streams.supervised(lambda: streams.flush_to_runs(stream, store, lambda: 100, f"{path}/state").trigger(availableNow=True).start())
    assert failures[0] == streams.ATTEMPTS + 2
    records(spark, ("a", "2", 3)).write.mode("append").parquet(f"{path}/in")
    streams.supervised(lambda: streams.flush_to_runs(stream, store, lambda: 200, f"{path}/state").trigger(availableNow=True).start())
    assert {(r.key, r.value) for r in store.state(300).collect()} == {("a", "2"), ("b", "1")} and store.manifest().count() == 2
    store.flush = lambda *a: 1 / 0
    records(spark, ("c", "1", 4)).write.mode("append").parquet(f"{path}/in")
    with pytest.raises(Exception):
        streams.supervised(lambda: streams.flush_to_runs(stream, store, lambda: 300, f"{path}/state").trigger(availableNow=True).start(), restarts=1)


def test_runs_stay_small(spark, tmp_path):
    df = spark.range(60_000).select(F.format_string("k%09d", "id").alias("key"), F.sha2(F.col("id").cast("string"), 256).alias("value"), F.lit(NEVER).cast("long").alias("expiry"), F.lit(0).cast("tinyint").alias("state"))
    store = RunStore(spark, f"file://{tmp_path}/runs")
    store.flush(df, 1)
    df.write.option("compression", "lz4_raw").parquet(f"file://{tmp_path}/plain")
    assert files.size(spark, f"file://{tmp_path}/runs/run=1") < 1.3 * files.size(spark, f"file://{tmp_path}/plain")
    assert store.get("k000031234", 2).count() == 1


def test_load(spark, tmp_path):
    """Many runs in one pass are what flushing each gives; ids that are null or not above the store's fail."""
    rows = [("a", "1", 900, 0, 1), ("b", "1", 900, 0, 1), ("a", "2", 900, 0, 5), ("c", "3", 900, 1, 5), ("b", "9", 50, 0, 7)]
    schema = "key string, value string, expiry long, state tinyint, run_id long"
    store = RunStore(spark, f"file://{tmp_path}/runs")
    assert store.load(spark.createDataFrame([], schema), 1) == [] and store.manifest().count() == 0
    spark.createDataFrame([("x", "0", 900, 0)], "key string, value string, expiry long, state tinyint").write.parquet(f"file://{tmp_path}/runs/run=6")  # what a failed write left
    assert store.load(spark.createDataFrame(rows, schema), 1) == [1, 5, 7]
    got = {(r.run_id, r.level, r.first_key, r.last_key, r.num_records) for r in store.manifest().collect()}
    assert got == {(1, 0, "a", "b", 2), (5, 0, "a", "c", 2), (7, 0, "b", "b", 1)}
    assert {(r.key, r.value) for r in store.state(100).collect()} == {("a", "2")} and store.get("a", 100).first().value == "2"
    for bad in (7, None):
        with pytest.raises(Exception, match="above 7"):
            store.load(spark.createDataFrame([("d", "1", 900, 0, bad)], schema), 2)
    assert store.flush(spark.createDataFrame([("d", "1", 900, 0)], "key string, value string, expiry long, state tinyint"), 3) == 8
    assert store.versions().count() == 6
