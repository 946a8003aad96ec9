"""Schemas, response codes and limits of the keyed data model.

A keyspace is a change log of rows; every capability is a DataFrame-to-DataFrame function with an
explicit ``now`` in whole epoch seconds.
"""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values of the data model.
NEVER = 4102444800  # the expiry of what never expires
SENTINEL = -99999999  # the result of an arithmetic command that failed
ACTIVE, TOMBSTONED, OBSOLETE = 0, 1, 2
MAX_RECORD_BYTES = 1_048_576
SHARDS = 64
PARTITIONS = 4096
BLOCK_BYTES = 65_536
RUNS_PER_LEVEL = 3
LEVELS = 8
EXPIRE_BATCH = 1000
OVERFLOW = 1.01

CODES = {
    200: "ping ok",
    201: "snapshot started",
    501: "shutting down",
    502: "busy",
    503: "snapshot failed",
    1000: "record found",
    1001: "record updated",
    1002: "record deleted",
    1010: "help ok",
    1011: "info ok",
    1100: "mget completed",
    1101: "mset completed",
    1102: "mdelete completed",
    5000: "invalid command input",
    5001: "record not found",
    5002: "record expired",
    5003: "record not deleted",
    5004: "incompatible data type",
    5005: "record too big",
    5006: "invalid data type",
    5007: "record tombstoned",
    5010: "run read error",
    5011: "log write failed",
}

TYPE_TAGS = {"raw": 0, "bool": 1, "int": 2, "float": 3, "string": 4, "array": 5, "slice": 6, "map": 7, "interface": 8, "nil": 9}

#: A record, with its value in the keyspace's own type.
def record_schema(value: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("key", T.StringType()), T.StructField("value", value), T.StructField("lat", T.LongType()), T.StructField("expiry", T.LongType()), T.StructField("state", T.ByteType()), T.StructField("seq", T.LongType())])


#: A change: SET, DELETE, INCR, DECR, APPEND or EXPIRE. ``num`` and ``txt`` are the value by kind.
LOG_SCHEMA = "seq long, ts long, op string, key string, num long, txt string, ttl long"
RUN_SCHEMA = "run_id long, level int, key string, value string, expiry long, state tinyint"
MANIFEST_SCHEMA = "run_id long, level int, first_key string, last_key string, num_records long, bytes long, created_at long"
