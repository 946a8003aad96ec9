"""Keyspaces over the relational tables, as DataFrames and as the same in SQL.

* KO: an order is a record under ``o:<orderkey>``; two in three expire a year after their date, one in seven is a tombstone
* KL: an event is a command on ``user:<id>``
* KT: the same events as commands on text values
* RUNS: a line item is a version of its order's record, in the run of its year
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import NEVER

NOW = 899251200  # 1998-07-01
LOG_NOW = 1706659200  # 2024-01-31, after the last event
LOG_MID = 1705276800  # 2024-01-15


def table(spark, sf_dir, name) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch(c: str):
    return F.unix_seconds(F.col(c).cast("timestamp"))


def ko(spark, d) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        F.concat(F.lit("o:"), k.cast("string")).alias("key"),
        F.col("o_totalprice").alias("value"),
        k.alias("seq"),
        F.when(k % 3 == 0, F.lit(NEVER)).otherwise(epoch("o_orderdate") + 31536000).cast("long").alias("expiry"),
        F.when(k % 7 == 0, 1).otherwise(0).cast("int").alias("state"),
        epoch("o_orderdate").alias("lat"),
    )


KO = """ko AS (SELECT 'o:' || o_orderkey AS key, o_totalprice AS value, o_orderkey AS seq,
  CAST(CASE WHEN o_orderkey % 3 = 0 THEN 4102444800 ELSE CAST(epoch(o_orderdate) AS BIGINT) + 31536000 END AS BIGINT) AS expiry,
  CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS state, CAST(epoch(o_orderdate) AS BIGINT) AS lat FROM orders)"""

LIVE = f"state = 0 AND NOT (expiry <> 0 AND {NOW} > expiry)"


def kl(spark, d) -> DataFrame:
    kind = F.col("event_type")
    op = F.when(kind == "signup", "SET").when(kind == "click", "INCR").when(kind == "view", "DECR").when(kind == "purchase", "EXPIRE").otherwise("DELETE")
    ttl = F.when(kind == "purchase", 7200).when((kind == "signup") & (F.col("event_id") % 3 != 0), 86400).otherwise(0)
    return table(spark, d, "events").select(
        F.col("event_id").alias("seq"),
        epoch("ts").alias("ts"),
        op.alias("op"),
        F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("key"),
        F.when(kind == "signup", F.floor("value")).otherwise(1).cast("long").alias("num"),
        F.lit(None).cast("string").alias("txt"),
        ttl.cast("long").alias("ttl"),
    )


KL = """kl AS (SELECT event_id AS seq, CAST(floor(epoch(ts)) AS BIGINT) AS ts,
  CASE event_type WHEN 'signup' THEN 'SET' WHEN 'click' THEN 'INCR' WHEN 'view' THEN 'DECR' WHEN 'purchase' THEN 'EXPIRE' ELSE 'DELETE' END AS op,
  'user:' || user_id AS key, CAST(CASE WHEN event_type = 'signup' THEN floor(value) ELSE 1 END AS BIGINT) AS num, CAST(NULL AS VARCHAR) AS txt,
  CAST(CASE WHEN event_type = 'purchase' THEN 7200 WHEN event_type = 'signup' AND event_id % 3 <> 0 THEN 86400 ELSE 0 END AS BIGINT) AS ttl FROM events)"""


def kt(spark, d) -> DataFrame:
    """signup sets a text, or a number for every fifth; click and view append; error increments, which fails on text."""
    kind, number = F.col("event_type"), F.col("event_id") % 5 == 0
    op = F.when(kind == "signup", "SET").when(kind == "purchase", "EXPIRE").when(kind == "error", "INCR").otherwise("APPEND")
    return table(spark, d, "events").select(
        F.col("event_id").alias("seq"),
        epoch("ts").alias("ts"),
        op.alias("op"),
        F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("key"),
        F.when(kind == "error", 1).when((kind == "signup") & number, F.col("event_id")).cast("long").alias("num"),
        F.when((kind == "signup") & ~number, F.lit("é")).when(kind.isin("click", "view"), F.concat(F.lit("_"), F.substring("event_type", 1, 1))).alias("txt"),
        F.when(kind == "purchase", 172800).when(kind == "signup", 604800).otherwise(0).cast("long").alias("ttl"),
    )


KT = """kt AS (SELECT event_id AS seq, CAST(floor(epoch(ts)) AS BIGINT) AS ts,
  CASE event_type WHEN 'signup' THEN 'SET' WHEN 'purchase' THEN 'EXPIRE' WHEN 'error' THEN 'INCR' ELSE 'APPEND' END AS op, 'user:' || user_id AS key,
  CAST(CASE WHEN event_type = 'error' THEN 1 WHEN event_type = 'signup' AND event_id % 5 = 0 THEN event_id END AS BIGINT) AS num,
  CASE WHEN event_type = 'signup' AND event_id % 5 <> 0 THEN 'é' WHEN event_type IN ('click', 'view') THEN '_' || substr(event_type, 1, 1) END AS txt,
  CAST(CASE WHEN event_type = 'purchase' THEN 172800 WHEN event_type = 'signup' THEN 604800 ELSE 0 END AS BIGINT) AS ttl FROM events)"""


def fold_sql(log: str, tag: str = "") -> str:
    """The fold, one command after another for each key, by recursion on the command's number; ``tag`` ends the names of its tables."""
    return f"""steps{tag} AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) AS i FROM {log}),
f{tag} AS (
  SELECT key, CAST(0 AS BIGINT) AS i, false AS live, CAST(NULL AS BIGINT) AS num, CAST(NULL AS VARCHAR) AS txt, CAST(4102444800 AS BIGINT) AS expiry, 5001 AS code, CAST(-99999999 AS BIGINT) AS data FROM (SELECT DISTINCT key FROM {log})
  UNION ALL
  SELECT key, i,
    CASE WHEN op = 'SET' THEN true WHEN op = 'DELETE' OR dead THEN false ELSE true END,
    CASE WHEN op = 'SET' THEN num WHEN op = 'DELETE' OR dead THEN NULL WHEN op = 'INCR' AND had IS NOT NULL THEN had + num WHEN op = 'DECR' AND had IS NOT NULL THEN had - num ELSE had END,
    CASE WHEN op = 'SET' THEN txt WHEN op = 'DELETE' OR dead THEN NULL WHEN op = 'APPEND' AND htxt IS NOT NULL THEN htxt || txt ELSE htxt END,
    CASE WHEN op = 'SET' OR (op = 'EXPIRE' AND NOT dead) THEN CASE WHEN ttl > 0 THEN ts + ttl ELSE 4102444800 END
         WHEN op = 'DELETE' OR dead THEN 4102444800
         WHEN (op IN ('INCR', 'DECR') AND had IS NOT NULL) OR (op = 'APPEND' AND htxt IS NOT NULL) THEN CASE WHEN hexp > ts THEN hexp ELSE 4102444800 END ELSE hexp END,
    CASE WHEN op = 'SET' THEN 1001 WHEN op = 'DELETE' THEN 1002 WHEN dead THEN 5001
         WHEN (op IN ('INCR', 'DECR') AND had IS NULL) OR (op = 'APPEND' AND htxt IS NULL) THEN 5004 ELSE 1001 END,
    CASE WHEN op IN ('SET', 'DELETE') THEN 1 WHEN dead THEN CASE WHEN op = 'EXPIRE' THEN 0 ELSE -99999999 END
         WHEN op = 'INCR' AND had IS NOT NULL THEN had + num WHEN op = 'DECR' AND had IS NOT NULL THEN had - num
         WHEN op = 'APPEND' AND htxt IS NOT NULL THEN octet_length(encode(htxt || txt)) WHEN op = 'EXPIRE' THEN 1 ELSE -99999999 END
  FROM (SELECT s.*, f.num AS had, f.txt AS htxt, f.expiry AS hexp, (NOT f.live OR s.ts > f.expiry) AS dead FROM f{tag} f JOIN steps{tag} s ON s.key = f.key AND s.i = f.i + 1))
, folded{tag} AS (SELECT key, live, num, txt, expiry, code, data FROM f{tag} f WHERE i = (SELECT max(s.i) FROM steps{tag} s WHERE s.key = f.key))"""


def runs(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select(
        F.concat(F.lit("l:"), F.col("l_orderkey").cast("string")).alias("key"),
        F.col("l_extendedprice").alias("value"),
        F.year("l_shipdate").cast("long").alias("run_id"),
        epoch("l_shipdate").alias("ts"),
        F.when(F.col("l_returnflag") == "R", epoch("l_shipdate") + 31536000).otherwise(F.lit(NEVER)).cast("long").alias("expiry"),
        F.when(F.col("l_quantity") < 5, 1).otherwise(0).cast("int").alias("state"),
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
    )


RUN_ORDER = ["run_id", "ts", "l_linenumber", "l_partkey", "l_suppkey", "value"]
RUNS = """runs AS (SELECT 'l:' || l_orderkey AS key, l_extendedprice AS value, CAST(year(l_shipdate) AS BIGINT) AS run_id, CAST(epoch(l_shipdate) AS BIGINT) AS ts,
  CAST(CASE WHEN l_returnflag = 'R' THEN CAST(epoch(l_shipdate) AS BIGINT) + 31536000 ELSE 4102444800 END AS BIGINT) AS expiry,
  CASE WHEN l_quantity < 5 THEN 1 ELSE 0 END AS state, l_linenumber, l_partkey, l_suppkey FROM lineitem)"""
RUN_NEWEST = "QUALIFY row_number() OVER (PARTITION BY key ORDER BY run_id DESC, ts DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, value DESC) = 1"
