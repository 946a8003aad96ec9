"""Background work on keyspaces: compaction, overlap, freezing, blocks, expiry samples, eviction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import live, overflown, shard_of
from ..model import BLOCK_BYTES, EXPIRE_BATCH, RUNS_PER_LEVEL
from .ranges import bytes_ahead, last_at_or_before, meeting, packed
from .resolve import newest


def compact(versions: DataFrame, now, order: list[str]) -> DataFrame:
    """N-way merge of runs: the newest version of each key by ``order``, then without the dead."""
    return newest(versions, order).filter(live(F.col("expiry"), F.col("state"), now))


def run_metadata(rows: DataFrame, run: str = "run_id", size: Column | None = None) -> DataFrame:
    """A manifest row for each run."""
    size = size if size is not None else F.octet_length("key") + F.coalesce(F.octet_length(F.col("value").cast("string")), F.lit(0)) + 16
    return rows.groupBy(run).agg(F.min("key").alias("first_key"), F.max("key").alias("last_key"), F.count(F.lit(1)).alias("num_records"), F.sum(size).cast("long").alias("bytes"))


def overlapping(a: DataFrame, b: DataFrame, run: str = "run_id") -> DataFrame:
    """Pairs of runs of two manifests whose key ranges meet; manifests have a row for each run, not for each record."""
    side = lambda m: m.select(F.col(run).alias("id"), F.col("first_key").alias("lo"), F.col("last_key").alias("hi"))
    first = side(a)
    return meeting(first, first if b is a else side(b)).select(F.col("a").alias("run_a"), F.col("b").alias("run_b"))


def levels_to_compact(manifest: DataFrame, threshold: int = RUNS_PER_LEVEL) -> DataFrame:
    return manifest.groupBy("level").agg(F.count(F.lit(1)).alias("n_runs"), F.min("run_id").alias("merged_id")).filter(F.col("n_runs") >= threshold)


def runs_newest_first(names: DataFrame, name: str = "name") -> DataFrame:
    number = F.regexp_extract(name, r"(\d+)", 1).cast("long")
    return names.withColumn("run_id", number).orderBy(F.desc("run_id"))


def assign_batches(rows: DataFrame, size: Column, limit: int, by: list[str], partition: list[str], name: str) -> DataFrame:
    """Numbers the batches that a byte limit makes of each partition's rows, in order: the whole limits in the bytes ahead."""
    sized = bytes_ahead(rows.withColumn("_size", size.cast("long")), "_size", by, partition)
    return sized.withColumn(name, F.floor(F.col("_ahead") / F.lit(limit)).cast("long")).drop("_ahead")


def freeze_batches(rows: DataFrame, size: Column, limit: int, by: list[str], shard: Column | None = None) -> DataFrame:
    """Which memory table each record goes to, and the bytes ahead of it; by shard, so that no task holds the keyspace."""
    rows = rows.withColumn("_shard", shard if shard is not None else shard_of(F.col("key")))
    return assign_batches(rows, size, limit, by, ["_shard"], "batch").withColumnRenamed("_shard", "shard").withColumnRenamed("_size", "entry_bytes")


def block_stats(rows: DataFrame, size: Column, run: str, by: list[str], limit: int = BLOCK_BYTES) -> DataFrame:
    """First and last key, records and bytes of each block of each sorted run."""
    placed = assign_batches(rows, size, limit, by, [run], "block")
    return placed.groupBy(run, "block").agg(F.min("key").alias("first_key"), F.max("key").alias("last_key"), F.count(F.lit(1)).alias("num_records"), F.sum("_size").cast("long").alias("bytes"))


def greedy_blocks(rows: DataFrame, size: Column, run: str, by: list[str], limit: int) -> DataFrame:
    """Blocks as a writer packs them: a record that does not fit opens the next block."""
    return packed(rows, size, run, by, limit)


def find_blocks(index: DataFrame, keys: DataFrame) -> DataFrame:
    """The block of a sorted run whose range holds each key: of the last block that begins at or before the key, if the key is not beyond its end. Keys in no block have no row."""
    found = last_at_or_before(index, "first_key", keys, "key").filter(F.col("key") <= F.col("entry.last_key"))
    return found.select(*keys.columns, *[F.col("entry")[c].alias(c) for c in index.columns])


def expire_sample(state: DataFrame, shard: int, now, limit: int = EXPIRE_BATCH) -> DataFrame:
    """Up to ``limit`` expired keys of one shard, by key."""
    return state.filter((shard_of(F.col("key")) == shard) & (F.col("expiry") < F.lit(now))).orderBy("key").limit(limit).select("key")


def expire_shard(state: DataFrame, shard: int, now, limit: int = EXPIRE_BATCH) -> tuple[DataFrame, DataFrame]:
    """One visit of the expiry worker: the state without the sample's keys, and the keys that went."""
    gone = expire_sample(state, shard, now, limit)
    return state.join(gone, "key", "left_anti"), gone


def expire_rounds(state: DataFrame, now, limit: int = EXPIRE_BATCH) -> DataFrame:
    """The visits that the worker makes when it goes on for as long as it deletes: shard, key and round (from 0) of each expired key.

    Rounds of a shard take its expired keys in order, ``limit`` each; what is left after the last one is
    ``state`` without these keys.
    """
    dead = state.filter(F.col("expiry") < F.lit(now)).select(shard_of(F.col("key")).alias("shard"), "key", F.lit(1).alias("_one"))
    placed = bytes_ahead(dead, "_one", ["key"], ["shard"])
    return placed.select("shard", "key", F.floor(F.col("_ahead") / F.lit(limit)).cast("long").alias("round"))


def lru_plan(state: DataFrame, size: Column, allowed: int, shards: int = 64) -> DataFrame:
    """Which records stay when the most recently used are kept up to a byte limit: adds bytes, bytes_ahead and keep.

    Records are ordered over the whole keyspace. A window without a partition would put it all in one
    task, so bytes are summed by access time first and only the few times' sums are ordered as one;
    within a time each record counts those ahead of it by key.
    """
    rows = state.withColumn("bytes", size.cast("long"))
    times = rows.groupBy("lat").agg(F.sum("bytes").alias("_sum"))
    newer = Window.orderBy(F.desc("lat")).rowsBetween(Window.unboundedPreceding, -1)
    times = times.withColumn("_newer", F.coalesce(F.sum("_sum").over(newer), F.lit(0))).drop("_sum")
    inside = Window.partitionBy("lat").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_inside", F.coalesce(F.sum("bytes").over(inside), F.lit(0))).join(times, "lat")
    ahead = (F.col("_newer") + F.col("_inside")).cast("long")
    return rows.select(*state.columns, "bytes", ahead.alias("bytes_ahead"), (ahead + F.col("bytes") <= allowed).alias("keep"))


def memory_use(state: DataFrame, size: Column, allowed: int) -> DataFrame:
    used = F.coalesce(F.sum(size), F.lit(0)).cast("long")
    return state.agg(used.alias("used")).withColumn("overflown", overflown(F.col("used"), F.lit(allowed)))
