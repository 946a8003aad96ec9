"""Writes as functions from state to state: SET, DELETE, MSET, MDELETE, EXPIRE, INCR/DECR and APPEND."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import expiry_of, live, too_big, writeable
from ..model import ACTIVE, MAX_RECORD_BYTES, NEVER, TOMBSTONED


def set_rows(rows: DataFrame, now, *, limit: int = MAX_RECORD_BYTES) -> DataFrame:
    """Checks a batch of SETs (key, value, ttl, seq): type first, then size. Adds code, expiry, state and lat; rejected rows have 5005 or 5006."""
    kind = rows.schema["value"].dataType
    code = F.lit(1001)
    if not writeable(kind):
        code = F.lit(5006)
    elif kind.simpleString() == "string":
        code = F.when(F.coalesce(too_big(F.col("value"), limit), F.lit(False)), F.lit(5005)).otherwise(F.lit(1001))
    return rows.withColumn("code", code).withColumn("expiry", expiry_of(F.coalesce("ttl", F.lit(0)), now)).withColumn("state", F.lit(ACTIVE).cast("byte")).withColumn("lat", F.lit(now).cast("long"))


def upsert(base: DataFrame, new: DataFrame) -> DataFrame:
    """Blind overwrite by key: value, expiry and state are all the new row's. Both have key, value, expiry, state."""
    b = base.select("key", F.struct("value", "expiry", "state").alias("_b"))
    n = new.select("key", F.struct("value", "expiry", "state").alias("_n"))
    return b.join(n, "key", "full").select("key", F.coalesce("_n", "_b").alias("r")).select("key", "r.value", "r.expiry", "r.state")


def mset(base: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` has key and value, one row for each key; never with a ttl."""
    new = pairs.select("key", "value", F.lit(NEVER).cast("long").alias("expiry"), F.lit(ACTIVE).cast("byte").alias("state"))
    return upsert(base, new)


def delete(keys: DataFrame, seq: int, now) -> DataFrame:
    """Tombstones for a log; deleting always succeeds, for absent keys too."""
    return keys.select("key").distinct().select("key", F.lit(NEVER).cast("long").alias("expiry"), F.lit(TOMBSTONED).cast("byte").alias("state"), F.lit(seq).cast("long").alias("seq"), F.lit(now).cast("long").alias("ts"), F.lit(1002).alias("code"))


def mdelete(base: DataFrame, keys: DataFrame) -> DataFrame:
    return base.join(keys.select("key").distinct(), "key", "left_anti")


def expire(base: DataFrame, keys: DataFrame, now) -> DataFrame:
    """``keys`` has key and ttl, one row each. Live records get now + ttl, or no expiry for a ttl of 0 or less."""
    asked = keys.select("key", F.col("ttl").alias("_ttl"))
    change = F.col("_ttl").isNotNull() & live(F.col("expiry"), F.col("state"), now)
    return base.join(asked, "key", "left").withColumn("expiry", F.when(change, expiry_of(F.col("_ttl"), now)).otherwise(F.col("expiry"))).drop("_ttl")


def running_counter(changes: DataFrame, start: int = 0) -> DataFrame:
    """INCR and DECR alone, without expiry: the value after each change (key, seq, delta), as a running sum."""
    w = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return changes.withColumn("value", F.lit(start) + F.sum("delta").over(w))


def appended(parts: DataFrame) -> DataFrame:
    """APPEND alone: a key's parts (key, seq, part) joined by seq, and the text's bytes."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "part"))), lambda x: x["part"]), "")
    return parts.groupBy("key").agg(text.alias("value")).withColumn("bytes", F.octet_length("value").cast("long"))
