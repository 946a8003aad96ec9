"""From versions to state: newest version per key, and the fold of a command log.

The newest version is picked first and judged afterwards, so that a dead newest version never
uncovers an older one. ``max_by`` combines before the shuffle: at most one row for each key and task
crosses the network, whatever the history's length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import live
from ..model import NEVER, SENTINEL


def newest(versions: DataFrame, order: list[str], key: str = "key") -> DataFrame:
    """The row that is last by ``order`` for each key; equal rows count once."""
    rest = [c for c in versions.columns if c != key]
    top = F.max_by(F.struct(*rest), F.struct(*order)).alias("_top")
    return versions.groupBy(key).agg(top).select(key, *[F.col("_top")[c].alias(c) for c in rest])


def resolve(versions: DataFrame, now, order: list[str] | None = None, key: str = "key") -> DataFrame:
    """The live records at ``now``."""
    return newest(versions, order or ["seq"], key).filter(live(F.col("expiry"), F.col("state"), now))


def merge(older: DataFrame, newer: DataFrame, key: str = "key") -> DataFrame:
    """Two sorted runs into one: a key of both takes the second run's row."""
    both = older.withColumn("_rank", F.lit(0)).unionByName(newer.withColumn("_rank", F.lit(1)))
    return newest(both, ["_rank"], key).drop("_rank")


_STATE = "struct<live:boolean,num:bigint,txt:string,expiry:bigint,code:int,data:bigint>"


def _start() -> Column:
    return F.struct(F.lit(False).alias("live"), F.lit(None).cast("long").alias("num"), F.lit(None).cast("string").alias("txt"), F.lit(NEVER).cast("long").alias("expiry"), F.lit(5001).alias("code"), F.lit(SENTINEL).cast("long").alias("data")).cast(_STATE)


def _step(s: Column, x: Column) -> Column:
    """One command on one key's state. SET and DELETE do not look at it; the others need a live record."""

    def state(is_live, num, txt, expiry, code, data) -> Column:
        return F.struct(is_live.alias("live"), num.alias("num"), txt.alias("txt"), expiry.alias("expiry"), F.lit(code).alias("code"), data.alias("data")).cast(_STATE)

    op, none, no = x["op"], F.lit(None), F.lit(SENTINEL).cast("long")
    ends = F.when(x["ttl"] > 0, x["ts"] + x["ttl"]).otherwise(F.lit(NEVER))
    dead = ~s["live"] | (x["ts"] > s["expiry"])
    # the rewrite derives a ttl from what is left; nothing left means no ttl, and the record stays for good
    kept = F.when(s["expiry"] - x["ts"] > 0, s["expiry"]).otherwise(F.lit(NEVER))
    number, text = op.isin("INCR", "DECR"), op == "APPEND"
    moved = s["num"] + F.when(op == "DECR", -x["num"]).otherwise(x["num"])
    longer = F.concat(s["txt"], x["txt"])
    return (
        F.when(op == "SET", state(F.lit(True), x["num"], x["txt"], ends, 1001, F.lit(1).cast("long")))
        .when(op == "DELETE", state(F.lit(False), none, none, F.lit(NEVER), 1002, F.lit(1).cast("long")))
        .when(dead, state(F.lit(False), none, none, F.lit(NEVER), 5001, F.when(number | text, no).otherwise(F.lit(0))))
        .when(number & s["num"].isNotNull(), state(F.lit(True), moved, none, kept, 1001, moved))
        .when(text & s["txt"].isNotNull(), state(F.lit(True), none, longer, kept, 1001, F.octet_length(longer).cast("long")))
        .when(number | text, state(s["live"], s["num"], s["txt"], s["expiry"], 5004, no))
        .when(op == "EXPIRE", state(F.lit(True), s["num"], s["txt"], ends, 1001, F.lit(1).cast("long")))
        .otherwise(state(s["live"], s["num"], s["txt"], s["expiry"], 1000, F.when(op == "TTL", s["expiry"] - x["ts"]).otherwise(F.lit(1)).cast("long")))
    )


def fold(log: DataFrame) -> DataFrame:
    """State of each key after all its commands: live, num, txt, expiry, and the last command's code and data.

    A later command's result hangs on all earlier ones, so a key's commands are folded in order. All
    that lies before the last SET or DELETE of a key can't matter and is dropped before the commands
    are gathered, so an array holds what followed the last blind write. A key that is still hot after
    that belongs into ``streaming.state``, whose memory is one record a key.
    """
    blind = F.max(F.when(F.col("op").isin("SET", "DELETE"), F.col("seq"))).alias("_from")
    starts = log.groupBy("key").agg(blind)
    needed = log.join(starts, "key").filter(F.col("_from").isNull() | (F.col("seq") >= F.col("_from")))
    steps = F.array_sort(F.collect_list(F.struct("seq", "ts", "op", F.col("num").cast("long").alias("num"), "txt", F.col("ttl").cast("long").alias("ttl"))))
    done = needed.groupBy("key").agg(F.aggregate(steps, _start(), _step).alias("s"))
    return done.select("key", "s.live", "s.num", "s.txt", "s.expiry", "s.code", "s.data")


def responses(log: DataFrame) -> DataFrame:
    """The response to every command of a log: key, seq, op, live, num, txt, expiry (of the record after it), code and data.

    A SET or DELETE doesn't look at what came before, so a key's commands are cut there and each piece
    is folded on its own.
    """
    blind = F.when(F.col("op").isin("SET", "DELETE"), 1).otherwise(0)
    w = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    pieces = log.withColumn("_piece", F.sum(blind).over(w))
    steps = F.array_sort(F.collect_list(F.struct("seq", "ts", "op", F.col("num").cast("long").alias("num"), "txt", F.col("ttl").cast("long").alias("ttl"))))
    start = F.struct(_start().alias("s"), F.expr(f"cast(array() as array<{_STATE}>)").alias("all"))

    def step(a: Column, x: Column) -> Column:
        return F.transform(F.array(_step(a["s"], x)), lambda s: F.struct(s.alias("s"), F.concat(a["all"], F.array(s)).alias("all")))[0]

    done = pieces.groupBy("key", "_piece").agg(steps.alias("steps")).select("key", "steps", F.aggregate("steps", start, step)["all"].alias("all"))
    each = done.select("key", F.explode(F.arrays_zip("steps", "all")).alias("x"))
    return each.select("key", "x.steps.seq", "x.steps.op", *[F.col("x.all")[c].alias(c) for c in ("live", "num", "txt", "expiry", "code", "data")])


def live_after(log: DataFrame, now) -> DataFrame:
    return fold(log).filter(F.col("live") & ~((F.col("expiry") != 0) & (F.lit(now) > F.col("expiry")))).select("key", "num", "txt", "expiry")
