"""The command surface: validation, help, ping, statistics and batches of commands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import CODES, NEVER
from . import reads, writes
from .resolve import fold, responses

# Commands with their arguments' names and kinds.
COMMANDS = {
    "PING": (),
    "EXISTS": (("key", "string"),),
    "GET": (("key", "string"),),
    "SET": (("key", "string"), ("value", "any"), ("ttl", "int64")),
    "DELETE": (("key", "string"),),
    "INCR": (("key", "string"), ("offset", "int64")),
    "DECR": (("key", "string"), ("offset", "int64")),
    "APPEND": (("key", "string"), ("value", "string")),
    "MGET": (("keys", "slice"),),
    "MSET": (("kvMap", "map"),),
    "MDELETE": (("keys", "slice"),),
    "TTL": (("key", "string"),),
    "EXPIRE": (("key", "string"), ("ttl", "int64")),
    "SNAPSHOT": (),
    "INFO": (),
    "HELP": (("command", "string"),),
}
_KINDS = {"string": str, "int64": int, "slice": (list, tuple), "map": dict}


def validate(rules: Sequence[tuple[str, str]], args: Sequence) -> tuple | None:
    """None, or the response (data, code, message) of a command with wrong arguments."""
    if len(args) != len(rules):
        # Fixed value: both messages are what clients of the commands expect.
        return None, 5000, f"ERR: Incorrect number of arguments provided. Want={len(rules)}, Have={len(args)}"
    for (name, kind), value in zip(rules, args, strict=True):
        if kind != "any" and (not isinstance(value, _KINDS.get(kind, int)) or isinstance(value, bool)):
            return None, 5000, f"ERR: {name} has invalid type. {kind} expected"
    return None


def help_table(spark: SparkSession) -> DataFrame:
    rows = [(name, " ".join([name, *[f"<{a}:{k}>" for a, k in args]]), 1010) for name, args in COMMANDS.items()]
    return spark.createDataFrame(rows, "command string, usage string, code int")


def codes_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CODES.items()), "code int, meaning string")


def ping(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.lit("OK").alias("data"), F.lit(200).alias("code"), F.lit("").alias("message"))


def info(state: DataFrame, size: Column) -> DataFrame:
    """One row of statistics over resolved state, and the same as JSON."""
    stats = state.agg(F.count(F.lit(1)).alias("total_keys"), F.count_if(F.col("expiry") != NEVER).alias("keys_with_ttl"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("bytes"))
    return stats.withColumn("json", F.to_json(F.struct("total_keys", "keys_with_ttl", "bytes")))


def batch(state: DataFrame, commands: DataFrame, now: int) -> DataFrame:
    """The responses of a batch of commands (seq, ts, op, key, num, txt, ttl; none before ``now``) on a state: as of ``resolve.responses``.

    A record is a SET ahead of all commands, at its own expiry.
    """
    log = _as_log(state.join(commands.select("key").distinct(), "key", "left_semi"), now)
    return responses(log.unionByName(commands.select(*log.columns))).filter(F.col("seq") > FIRST)


def counters(answered: DataFrame) -> DataFrame:
    """How often each command had each code."""
    return answered.groupBy("op", "code").agg(F.count(F.lit(1)).alias("n"))


def encoded(answered: DataFrame) -> DataFrame:
    """Responses as clients get them, a JSON object each: seq and response."""
    message = F.element_at(F.create_map(*[F.lit(x) for kv in CODES.items() for x in kv]), F.col("code"))
    return answered.select("seq", F.to_json(F.struct("data", "code", message.alias("message"))).alias("response"))


#: The number of what a state becomes in a log, before every command.
FIRST = -(2**63)


def _as_log(state: DataFrame, now: int) -> DataFrame:
    is_text = state.schema["value"].dataType.simpleString() == "string"
    value, none = F.col("value").cast("string" if is_text else "long"), F.lit(None)
    left = F.when(F.col("expiry") == NEVER, F.lit(0)).otherwise(F.col("expiry") - F.lit(now) + 1)
    alive = state.filter((F.col("state") == 0) & (F.col("expiry") >= now))
    return alive.select(F.lit(FIRST).cast("long").alias("seq"), F.lit(now - 1).cast("long").alias("ts"), F.lit("SET").alias("op"), "key", (none if is_text else value).cast("long").alias("num"), (value if is_text else none).cast("string").alias("txt"), left.cast("long").alias("ttl"))


class Keyspace:
    """The commands over one keyspace. A read returns its response as a DataFrame; a write returns the keyspace that follows, whose ``response`` has data, code and message.

    ``state`` has key, value, expiry and state. Nothing is held between calls but the DataFrame;
    ``path`` is where SNAPSHOT writes.
    """

    def __init__(self, state: DataFrame, path: str | None = None, response: DataFrame | None = None):
        self.state, self.spark, self.path, self.response = state, state.sparkSession, path, response

    def _keys(self, keys: Sequence[str]) -> DataFrame:
        return self.spark.createDataFrame([(k,) for k in keys], "key string")

    def run(self, command: str, args: Sequence, now: int):
        name = command.upper()
        if name not in COMMANDS:
            raise ValueError(f"invalid command {command}")
        if name == "HELP" and not args:
            return help_table(self.spark)
        if wrong := validate(COMMANDS[name], args):
            return wrong
        return getattr(self, name.lower())(*args, now=now)

    def ping(self, now: int = 0):
        return ping(self.spark)

    def get(self, key, now):
        return reads.mget(self.state, self._keys([key]), now)

    def exists(self, key, now):
        return reads.exists(self.state, self._keys([key]), now)

    def mget(self, keys, now):
        return reads.mget_map(self.state, self._keys(keys), now)

    def ttl(self, key, now):
        return reads.ttl(self.state, self._keys([key]), now)

    def help(self, command, now: int = 0):
        return help_table(self.spark).filter(F.col("command") == command.upper())

    def info(self, now):
        from ..functions.scalar import entry_size, live

        alive = self.state.filter(live(F.col("expiry"), F.col("state"), now))
        return info(alive, entry_size(F.col("key"), F.col("value"), self.state.schema["value"].dataType))

    def snapshot(self, now):
        """count, bytes and code: 201, or 503 where there is no path or it can't be written."""
        from pyspark.errors import PySparkException

        from ..sources import changelog

        if self.path:
            try:
                return changelog.snapshot(self.state, self.path, now)
            except (PySparkException, OSError):
                pass
        return self.spark.range(1).select(F.lit(0).cast("long").alias("count"), F.lit(0).cast("long").alias("bytes"), F.lit(503).alias("code"))

    def _said(self, code: Column | int, data: Column | None = None, of: DataFrame | None = None) -> DataFrame:
        code = F.lit(code) if isinstance(code, int) else code
        data = (code < 5000) if data is None else data
        message = F.element_at(F.create_map(*[F.lit(x) for kv in CODES.items() for x in kv]), code)
        return (self.spark.range(1) if of is None else of).select(data.cast("string").alias("data"), code.cast("int").alias("code"), message.alias("message"))

    def _after(self, state: DataFrame, response: DataFrame) -> Keyspace:
        return Keyspace(state, self.path, response)

    def set(self, key, value, ttl, now):
        """5005 and 5006 leave the state as it was."""
        rows = writes.set_rows(self._pairs([(key, value)]).withColumn("ttl", F.lit(ttl)), now)
        return self._after(writes.upsert(self.state, rows.filter(F.col("code") == 1001)), self._said(F.col("code"), of=rows))

    def _pairs(self, pairs) -> DataFrame:
        return self.spark.createDataFrame(list(pairs), f"key string, value {self.state.schema['value'].dataType.simpleString()}")

    def mset(self, pairs, now: int = 0):
        """The batch's code is always that of success; a pair that SET would refuse is not stored."""
        rows = writes.set_rows(self._pairs(pairs.items()).withColumn("ttl", F.lit(0)), now).filter(F.col("code") == 1001)
        return self._after(writes.mset(self.state, rows), self._said(1101))

    def delete(self, key, now: int = 0):
        return self._after(writes.mdelete(self.state, self._keys([key])), self._said(1002))

    def mdelete(self, keys, now: int = 0):
        return self._after(writes.mdelete(self.state, self._keys(keys)), self._said(1102))

    def expire(self, key, ttl, now):
        found = reads.exists(self.state, self._keys([key]), now)
        changed = writes.expire(self.state, self.spark.createDataFrame([(key, ttl)], "key string, ttl long"), now)
        return self._after(changed, self._said(F.when(F.col("found"), F.lit(1001)).otherwise(F.col("code")), of=found))

    def _changed(self, op: str, key: str, num, txt, now: int) -> Keyspace:
        """INCR, DECR and APPEND through the fold."""
        kind = self.state.schema["value"].dataType
        log = _as_log(self.state.filter(F.col("key") == key), now)
        done = fold(log.unionByName(self.spark.createDataFrame([(0, now, op, key, num, txt, 0)], log.schema)))
        value = F.col("txt") if kind.simpleString() == "string" else F.col("num").cast(kind)
        new = done.filter("live").select("key", value.alias("value"), "expiry", F.lit(0).cast("byte").alias("state"))
        return self._after(writes.upsert(self.state, new), self._said(F.col("code"), F.col("data"), of=done))

    def incr(self, key, offset, now):
        return self._changed("INCR", key, offset, None, now)

    def decr(self, key, offset, now):
        return self._changed("DECR", key, offset, None, now)

    def append(self, key, value, now):
        return self._changed("APPEND", key, None, value, now)


def opened(spark: SparkSession, settings, path: str, now: int, schema: str = "key string, value string, expiry long, state tinyint") -> Keyspace:
    """The keyspace that the settings' engine has kept below ``path``: MEMORY its newest snapshot, LSM its runs; empty where there is none."""
    from ..sources import changelog, files
    from ..sources.runs import RunStore

    if settings.engine == "LSM":
        state = RunStore(spark, path).state(now).drop("run_id")
    elif files.versions(spark, path, "snapshot"):
        state = changelog.restore(spark, path, now)
    else:
        state = spark.createDataFrame([], schema)
    return Keyspace(state, path)
