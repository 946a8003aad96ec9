"""Reads over a resolved or unresolved keyspace: GET, EXISTS, MGET, TTL, ordered and range scans, as-of.

``state`` has a row for each key: key, value, expiry, state. Keys that are asked for are a DataFrame,
distinct first; the planner broadcasts them where their size allows it and shuffles otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import live, read_code, shard_of, ttl_left
from .resolve import newest


def get(state: DataFrame, key: str, now) -> DataFrame:
    """The record, or no row; the key test reaches the scan's filters."""
    return state.filter((F.col("key") == key) & live(F.col("expiry"), F.col("state"), now))


def _asked(state: DataFrame, keys: DataFrame) -> DataFrame:
    return keys.select("key").distinct().join(state.withColumn("_found", F.lit(True)), "key", "left").withColumn("_found", F.coalesce("_found", F.lit(False)))


def exists(state: DataFrame, keys: DataFrame, now, *, merged: bool = False) -> DataFrame:
    code = read_code(F.col("_found"), F.col("expiry"), F.col("state"), now, merged=merged)
    return _asked(state, keys).select("key", (code == 1000).alias("found"), code.alias("code"))


def existing(state: DataFrame, keys: DataFrame, now) -> DataFrame:
    """The asked keys that are live, as a semi join."""
    alive = state.filter(live(F.col("expiry"), F.col("state"), now))
    return keys.select("key").distinct().join(alive, "key", "left_semi")


def mget(state: DataFrame, keys: DataFrame, now, *, merged: bool = False) -> DataFrame:
    """A row for each distinct key asked for: value (null unless live) and code."""
    code = read_code(F.col("_found"), F.col("expiry"), F.col("state"), now, merged=merged)
    return _asked(state, keys).withColumn("code", code).select("key", F.when(F.col("code") == 1000, F.col("value")).alias("value"), "code")


def mget_map(state: DataFrame, keys: DataFrame, now) -> DataFrame:
    """One row: a map from key to (value, code), and the code of the batch. For requests, whose size is that of their key list."""
    pairs = F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", F.struct("value", "code")))))
    return mget(state, keys, now).agg(pairs.alias("data")).select("data", F.lit(1100).alias("code"))


def ttl(state: DataFrame, keys: DataFrame, now) -> DataFrame:
    left = F.coalesce(ttl_left(F.col("expiry"), F.col("state"), now), F.lit(0).cast("long"))
    code = read_code(F.col("_found"), F.col("expiry"), F.col("state"), now)
    return _asked(state, keys).select("key", left.alias("ttl"), code.alias("code"))


def scan_ordered(state: DataFrame, now, *, strict: bool = False) -> DataFrame:
    """All records by key; ``strict`` also leaves out what expires at this second."""
    keep = F.col("expiry") > F.lit(now) if strict else F.col("expiry") >= F.lit(now)
    return state.filter(keep).orderBy("key")


def range_scan(state: DataFrame, first: str, last: str, now) -> DataFrame:
    return state.filter(F.col("key").between(first, last) & live(F.col("expiry"), F.col("state"), now)).orderBy("key")


def as_view(state: DataFrame, name: str, now) -> DataFrame:
    """Registers the live records as a view for SQL."""
    alive = state.filter(live(F.col("expiry"), F.col("state"), now))
    alive.createOrReplaceTempView(name)
    return alive


def as_of(versions: DataFrame, at, order: list[str] | None = None) -> DataFrame:
    """The newest version of each key at a time."""
    return newest(versions.filter(F.col("ts") <= F.lit(at)), order or ["seq"])


def as_of_join(left: DataFrame, right: DataFrame, key: str = "key", time: str = "ts", columns: list[str] = ()) -> DataFrame:
    """For each left row, ``columns`` of the last right row of its key at or before its time.

    Both sides are stacked and one window carries the last right row forward: a shuffle by key, and no
    pairs are made. At equal times right rows go first.
    """
    names = left.columns
    payload = F.struct(*[F.col(c) for c in columns])
    l = left.select(F.col(key).alias("_k"), F.col(time).alias("_t"), F.lit(1).alias("_side"), F.struct(*names).alias("_row"), F.lit(None).cast(right.select(payload.alias("p")).schema["p"].dataType).alias("_pay"))  # noqa: E741
    r = right.select(F.col(key).alias("_k"), F.col(time).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(l.schema["_row"].dataType).alias("_row"), payload.alias("_pay"))
    from pyspark.sql import Window

    w = Window.partitionBy("_k").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = l.unionByName(r).withColumn("_last", F.last("_pay", ignorenulls=True).over(w)).filter("_side = 1")
    return both.select(*[F.col("_row")[c].alias(c) for c in names], *[F.col("_last")[c].alias(f"asof_{c}") for c in columns])


def shard_counts(state: DataFrame, shards: int = 64) -> DataFrame:
    return state.groupBy(shard_of(F.col("key"), shards).alias("shard")).agg(F.count(F.lit(1)).alias("n_keys"))
