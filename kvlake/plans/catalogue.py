"""The registry of queries, each with the SQL that checks it where SQL can say it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions import vectors as V
from ..functions.murmur import C1, C2, F1, F2, PARTITION_SEED, partition_of
from ..operators import bits, hnsw, maintenance, reads, resolve, service, vector, writes
from ..sources import changelog
from ..sources.files import scratch
from ..sources.runs import RunStore
from ..streaming import state as streams
from .keyspaces import KL, KO, KT, LIVE, LOG_MID, LOG_NOW, NOW, RUN_NEWEST, RUN_ORDER, RUNS, epoch, fold_sql, kl, ko, kt, runs, table

_QUERIES, _SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries():
    return dict(_QUERIES)


def oracle_sql():
    return dict(_SQL)


r6 = lambda c: F.round(c, 6)
money = lambda c: F.sum(F.col(c).cast("decimal(18,2)")).cast("double")


def asked(spark, d):
    """Every order's key, and as many that are absent."""
    k = table(spark, d, "orders").select(F.col("o_orderkey"))
    here = k.select(F.concat(F.lit("o:"), F.col("o_orderkey").cast("string")).alias("key"))
    return here.unionByName(k.select(F.concat(F.lit("x:"), F.col("o_orderkey").cast("string")).alias("key")))


ASKED = "asked AS (SELECT 'o:' || o_orderkey AS key FROM orders UNION ALL SELECT 'x:' || o_orderkey FROM orders)"
CODE = f"CASE WHEN k.key IS NULL OR k.state = 1 THEN 5001 WHEN k.expiry <> 0 AND {NOW} > k.expiry THEN 5002 ELSE 1000 END"


# Reads


@query(f"WITH {KO} SELECT key, value, expiry FROM ko WHERE key = 'o:6' AND {LIVE}")
def kv_get_point(spark, d):
    return reads.get(ko(spark, d), "o:6", NOW).select("key", "value", "expiry")


@query(f"WITH {KO}, {ASKED} SELECT DISTINCT key FROM asked a WHERE EXISTS (SELECT 1 FROM ko WHERE ko.key = a.key AND {LIVE})")
def kv_exists_semi(spark, d):
    return reads.existing(ko(spark, d), asked(spark, d), NOW)


@query(f"WITH {KO}, {ASKED} SELECT a.key, {CODE} = 1000 AS found, {CODE} AS code FROM (SELECT DISTINCT key FROM asked) a LEFT JOIN ko k USING (key)")
def kv_exists_codes(spark, d):
    return reads.exists(ko(spark, d), asked(spark, d), NOW)


@query(f"WITH {KO}, {ASKED} SELECT a.key, CASE WHEN {CODE} = 1000 THEN k.value END AS value, {CODE} AS code FROM (SELECT DISTINCT key FROM asked) a LEFT JOIN ko k USING (key)")
def kv_mget_codes(spark, d):
    return reads.mget(ko(spark, d), asked(spark, d), NOW)


@query(f"WITH {KO}, {ASKED} SELECT a.key, CAST(CASE WHEN {CODE} = 1000 THEN k.expiry - {NOW} ELSE 0 END AS BIGINT) AS ttl, {CODE} AS code FROM (SELECT DISTINCT key FROM asked) a LEFT JOIN ko k USING (key)")
def kv_ttl_remaining(spark, d):
    return reads.ttl(ko(spark, d), asked(spark, d), NOW)


@query(f"WITH {KO} SELECT key, value, expiry FROM ko WHERE expiry >= {NOW} ORDER BY key")
def kv_scan_ordered(spark, d):
    return reads.scan_ordered(ko(spark, d), NOW).select("key", "value", "expiry")


@query(f"WITH {KO} SELECT key, value FROM ko WHERE key BETWEEN 'o:1' AND 'o:25' AND {LIVE} ORDER BY key")
def kv_range_scan(spark, d):
    return reads.range_scan(ko(spark, d), "o:1", "o:25", NOW).select("key", "value")


FNV = "list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(range(1, CAST(length({k}) AS BIGINT) + 1), lambda i: CAST(ascii(substr({k}, i, 1)) AS BIGINT))), lambda h, b: (xor(h, b) * 16777619) % 4294967296)"


@query(f"WITH {KO} SELECT CAST({FNV.format(k='key')} % 64 AS INTEGER) AS shard, count(*) AS n_keys FROM ko GROUP BY 1")
def kv_shard_counts(spark, d):
    return reads.shard_counts(ko(spark, d))


# Writes


@query(f"WITH {RUNS} SELECT key, value, run_id, state, expiry FROM runs {RUN_NEWEST}")
def kv_set_last_writer(spark, d):
    return resolve.newest(runs(spark, d), RUN_ORDER).select("key", "value", "run_id", "state", "expiry")


@query(f"""WITH {KL}, s AS (SELECT key, num, CASE WHEN ttl > 0 THEN ts + ttl ELSE 4102444800 END AS expiry FROM kl WHERE op = 'SET' QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1)
SELECT key, num AS value, CAST(expiry AS BIGINT) AS expiry, {LOG_MID} > expiry AS expired FROM s""")
def kv_set_ttl_expired(spark, d):
    log = kl(spark, d).filter("op = 'SET'").select("key", F.col("num").alias("value"), S.expiry_of(F.col("ttl"), F.col("ts")).alias("expiry"), "seq")
    return resolve.newest(log, ["seq"]).select("key", "value", "expiry", S.expired(F.col("expiry"), LOG_MID).alias("expired"))


@query(f"WITH {KL}, n AS (SELECT * FROM kl QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) SELECT key, seq, op FROM n WHERE op <> 'DELETE'")
def kv_delete_tombstone(spark, d):
    log = kl(spark, d).withColumn("state", (F.col("op") == "DELETE").cast("int"))
    return resolve.newest(log, ["seq"]).filter(~S.tombstoned(F.col("state"))).select("key", "seq", "op")


@query(f"""WITH {KO}, n AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'o:' ELSE 'new:' END || o_orderkey AS key, o_totalprice + 1 AS value FROM orders)
SELECT coalesce(n.key, ko.key) AS key, CASE WHEN n.key IS NOT NULL THEN n.value ELSE ko.value END AS value, CASE WHEN n.key IS NOT NULL THEN 4102444800 ELSE ko.expiry END AS expiry, CASE WHEN n.key IS NOT NULL THEN 0 ELSE ko.state END AS state
FROM ko FULL JOIN n ON n.key = ko.key""")
def kv_mset_upsert(spark, d):
    k = F.col("o_orderkey")
    new = table(spark, d, "orders").select(F.concat(F.when(k % 2 == 0, "o:").otherwise("new:"), k.cast("string")).alias("key"), (F.col("o_totalprice") + 1).alias("value"))
    return writes.mset(ko(spark, d).withColumn("state", F.col("state").cast("byte")), new).withColumn("state", F.col("state").cast("int"))


@query(f"WITH {KO}, {ASKED} SELECT key, value FROM ko WHERE NOT EXISTS (SELECT 1 FROM asked a WHERE a.key = ko.key)")
def kv_mdelete_anti(spark, d):
    return writes.mdelete(ko(spark, d), asked(spark, d)).select("key", "value")


@query(f"""WITH {KO} SELECT key, CAST(CASE WHEN {LIVE} THEN CASE WHEN seq % 100 - 50 > 0 THEN {NOW} + seq % 100 - 50 ELSE 4102444800 END ELSE expiry END AS BIGINT) AS expiry FROM ko""")
def kv_expire_rewrite(spark, d):
    state = ko(spark, d)
    keys = state.select("key", (F.col("seq") % 100 - 50).alias("ttl"))
    return writes.expire(state, keys, NOW).select("key", "expiry")


@query(f"WITH {KL} SELECT key, seq, CAST(sum(CASE op WHEN 'INCR' THEN 1 ELSE -1 END) OVER (PARTITION BY key ORDER BY seq) AS BIGINT) AS value FROM kl WHERE op IN ('INCR', 'DECR')")
def kv_incr_running(spark, d):
    changes = kl(spark, d).filter(F.col("op").isin("INCR", "DECR")).select("key", "seq", F.when(F.col("op") == "INCR", 1).otherwise(-1).cast("long").alias("delta"))
    return writes.running_counter(changes).select("key", "seq", F.col("value").cast("long").alias("value"))


@query(f"WITH RECURSIVE {KL}, {fold_sql('kl')} SELECT key, live, num, expiry, code, data FROM folded")
def kv_fold_ops(spark, d):
    return resolve.fold(kl(spark, d)).select("key", "live", "num", "expiry", "code", "data")


@query(f"WITH RECURSIVE {KL}, {fold_sql('kl')} SELECT key, num, expiry FROM folded WHERE live AND {LOG_NOW} <= expiry")
def kv_fold_live(spark, d):
    return resolve.live_after(kl(spark, d), LOG_NOW).select("key", "num", "expiry")


@query(f"WITH RECURSIVE {KT}, {fold_sql('kt')} SELECT key, live, num, txt, expiry, code, data FROM folded")
def kv_fold_text(spark, d):
    return resolve.fold(kt(spark, d))


@query("""SELECT 'user:' || user_id AS key, string_agg(substr(event_type, 1, 2), '' ORDER BY event_id) AS value, CAST(sum(2) AS BIGINT) AS bytes FROM events GROUP BY user_id""")
def kv_append_ordered(spark, d):
    parts = table(spark, d, "events").select(F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("key"), F.col("event_id").alias("seq"), F.substring("event_type", 1, 2).alias("part"))
    return writes.appended(parts)


@query("SELECT doc_id, CASE WHEN octet_length(encode(text)) > 2000 THEN 5005 ELSE 1001 END AS code FROM documents")
def kv_set_size_check(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.col("text").alias("value"), F.lit(0).alias("ttl"))
    return writes.set_rows(rows, NOW, limit=2000).select("doc_id", "code")


# Runs, log and snapshots


@query(f"""WITH {RUNS}, n AS (SELECT * FROM runs WHERE run_id IN (1996, 1997) {RUN_NEWEST}) SELECT key, run_id, value FROM n""")
def lsm_merge_two(spark, d):
    one = lambda y: resolve.newest(runs(spark, d).filter(F.col("run_id") == y), RUN_ORDER)
    return resolve.merge(one(1996), one(1997)).select("key", "run_id", "value")


@query(f"""WITH {RUNS}, n AS (SELECT * FROM runs {RUN_NEWEST}) SELECT key, value, run_id FROM n WHERE {LIVE}""")
def lsm_compact_purge(spark, d):
    return maintenance.compact(runs(spark, d), NOW, RUN_ORDER).select("key", "value", "run_id")


META = "meta AS (SELECT run_id, min(key) AS first_key, max(key) AS last_key, count(*) AS num_records, CAST(sum(octet_length(encode(key)) + 24) AS BIGINT) AS bytes FROM runs GROUP BY run_id)"


@query(f"WITH {RUNS}, {META} SELECT * FROM meta")
def lsm_run_metadata(spark, d):
    return maintenance.run_metadata(runs(spark, d), size=F.octet_length("key") + 24)


PART_RUNS = "runs AS (SELECT 'p:' || lpad(CAST(l_partkey AS VARCHAR), 8, '0') AS key, CAST(l_suppkey AS BIGINT) AS run_id FROM lineitem)"


@query(f"WITH {PART_RUNS}, {META} SELECT a.run_id AS run_a, b.run_id AS run_b FROM meta a JOIN meta b ON a.last_key >= b.first_key AND b.last_key >= a.first_key")
def lsm_overlap_pairs(spark, d):
    rows = table(spark, d, "lineitem").select(F.concat(F.lit("p:"), F.lpad(F.col("l_partkey").cast("string"), 8, "0")).alias("key"), F.col("l_suppkey").cast("long").alias("run_id"))
    meta = maintenance.run_metadata(rows, size=F.lit(1))
    return maintenance.overlapping(meta, meta)


@query(f"WITH {RUNS} SELECT CAST(run_id % 3 AS INTEGER) AS level, count(DISTINCT run_id) AS n_runs, min(run_id) AS merged_id FROM runs GROUP BY 1 HAVING count(DISTINCT run_id) >= 3")
def lsm_level_policy(spark, d):
    manifest = maintenance.run_metadata(runs(spark, d), size=F.lit(1)).withColumn("level", (F.col("run_id") % 3).cast("int"))
    return maintenance.levels_to_compact(manifest)


@query(f"WITH {KL}, e AS (SELECT *, CASE WHEN ttl > 0 THEN ts + ttl ELSE 4102444800 END AS expiry FROM kl) SELECT key, seq, op, CAST(expiry AS BIGINT) AS expiry FROM e WHERE expiry >= {LOG_MID} QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1")
def lsm_wal_replay(spark, d):
    entries = kl(spark, d).withColumn("expiry", S.expiry_of(F.col("ttl"), F.col("ts")))
    return changelog.replay(entries, LOG_MID).select("key", "seq", "op", "expiry")


@query(f"""WITH {KO}, k AS (SELECT key, {FNV.format(k='key')} % 64 AS shard, octet_length(encode(key)) + 24 AS b FROM ko)
SELECT CAST(shard AS INTEGER) AS shard, CAST(floor(coalesce(sum(b) OVER (PARTITION BY shard ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 1000) AS BIGINT) AS batch, key FROM k""")
def lsm_memtable_freeze(spark, d):
    state = ko(spark, d)
    size = S.entry_size(F.col("key"), F.col("value"), state.schema["value"].dataType)
    return maintenance.freeze_batches(state, size, 1000, ["key"]).select("shard", "batch", "key")


@query(f"""WITH {RUNS}, b AS (SELECT run_id, key, octet_length(encode(key)) + 24 AS s, CAST(floor(coalesce(sum(octet_length(encode(key)) + 24) OVER (PARTITION BY run_id ORDER BY key, ts, l_linenumber, l_partkey, l_suppkey, value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 65536) AS BIGINT) AS block FROM runs)
SELECT run_id, block, min(key) AS first_key, max(key) AS last_key, count(*) AS num_records, CAST(sum(s) AS BIGINT) AS bytes FROM b GROUP BY run_id, block""")
def lsm_block_stats(spark, d):
    return maintenance.block_stats(runs(spark, d), F.octet_length("key") + 24, "run_id", ["key", "ts", "l_linenumber", "l_partkey", "l_suppkey", "value"])


@query("""WITH RECURSIVE i AS (SELECT o_custkey % 16 AS run, o_orderkey AS k, octet_length(encode(o_orderstatus || o_orderpriority)) + 16 AS s, row_number() OVER (PARTITION BY o_custkey % 16 ORDER BY o_orderkey) AS n FROM orders),
g AS (SELECT run, k, n, s, CAST(0 AS BIGINT) AS block, CAST(s AS BIGINT) AS used FROM i WHERE n = 1 UNION ALL
 SELECT i.run, i.k, i.n, i.s, CASE WHEN g.used + i.s > 1000 THEN g.block + 1 ELSE g.block END, CASE WHEN g.used + i.s > 1000 THEN i.s ELSE g.used + i.s END FROM g JOIN i ON i.run = g.run AND i.n = g.n + 1)
SELECT CAST(run AS BIGINT) AS run, k, block, CAST(s AS BIGINT) AS bytes FROM g""")
def lsm_greedy_blocks(spark, d):
    rows = table(spark, d, "orders").select((F.col("o_custkey") % 16).cast("long").alias("run"), F.col("o_orderkey").alias("k"), (F.octet_length(F.concat("o_orderstatus", "o_orderpriority")) + 16).alias("s"))
    return maintenance.greedy_blocks(rows, F.col("s"), "run", ["k"], 1000)


@query("""WITH b AS (SELECT o_orderkey // 500 AS block, min(o_orderkey) AS f, max(o_orderkey) AS l FROM orders GROUP BY 1)
SELECT key, block FROM (SELECT DISTINCT l_orderkey AS key FROM lineitem) ASOF JOIN b ON key >= f WHERE key <= l""")
def lsm_find_block(spark, d):
    index = table(spark, d, "orders").groupBy(F.floor(F.col("o_orderkey") / 500).cast("long").alias("block")).agg(F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"))
    keys = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key")).distinct()
    return maintenance.find_blocks(index, keys).select("key", "block")


@query("SELECT CAST(regexp_extract(p_name || '', '([0-9]+)', 1) AS VARCHAR) AS digits, p_partkey AS run_id FROM (SELECT p_partkey, 'run-' || p_partkey || '.sst' AS p_name FROM part) ORDER BY run_id DESC")
def lsm_runs_newest_first(spark, d):
    names = table(spark, d, "part").select(F.concat(F.lit("run-"), F.col("p_partkey").cast("string"), F.lit(".sst")).alias("name"))
    return maintenance.runs_newest_first(names).select(F.regexp_extract("name", r"(\d+)", 1).alias("digits"), "run_id")


@query(f"WITH {KO} SELECT key, value, expiry FROM ko WHERE expiry >= {NOW}")
def snapshot_live(spark, d):
    """A snapshot, written and read."""
    path = scratch(spark, "snapshot")
    changelog.snapshot(ko(spark, d), path, NOW)
    return changelog.snapshot_rows(spark, path).select("key", "value", "expiry")


@query(f"WITH {KO} SELECT key, value, expiry FROM ko WHERE expiry > {NOW}")
def restore_live(spark, d):
    path = scratch(spark, "snapshot")
    changelog.snapshot(ko(spark, d), path, NOW)
    return changelog.restore(spark, path, NOW).select("key", "value", "expiry")


@query(f"WITH {KO} SELECT count(*) AS count, 201 AS code FROM ko WHERE expiry >= {NOW}")
def snapshot_command(spark, d):
    return service.Keyspace(ko(spark, d), scratch(spark, "snapshot")).run("SNAPSHOT", [], NOW).select("count", "code")


def _log_records(spark, d):
    """The last SET or DELETE of each key as logged records come: a version of the record for each."""
    log = kl(spark, d).filter(F.col("op").isin("SET", "DELETE"))
    return log.select("key", F.col("num").cast("string").alias("value"), S.expiry_of(F.col("ttl"), F.col("ts")).alias("expiry"), (F.col("op") == "DELETE").cast("tinyint").alias("state"), "seq", "ts")


LOGGED = "w AS (SELECT key, CAST(num AS VARCHAR) AS value, CAST(CASE WHEN ttl > 0 THEN ts + ttl ELSE 4102444800 END AS BIGINT) AS expiry, CASE WHEN op = 'DELETE' THEN 1 ELSE 0 END AS state, seq, ts FROM kl WHERE op IN ('SET', 'DELETE'))"


@query(f"""WITH {KL}, {LOGGED}, o AS (SELECT * FROM w WHERE ts <= {LOG_MID} QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1),
u AS (SELECT key, value, expiry, state, -1 AS seq FROM o WHERE expiry > {LOG_MID} UNION ALL SELECT key, value, expiry, state, seq FROM w WHERE ts > {LOG_MID} AND expiry >= {LOG_MID})
SELECT key, value, expiry, state FROM u QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1""")
def lsm_log_restore(spark, d):
    """A snapshot at half time and a log in two segments after it, all written, then read back and replayed."""
    versions, path = _log_records(spark, d), scratch(spark, "restore")
    old = resolve.newest(versions.filter(F.col("ts") <= LOG_MID), ["seq"])
    changelog.snapshot(old.select("key", "value", "expiry", "state"), f"{path}/snapshots", LOG_MID)
    later = versions.filter(F.col("ts") > LOG_MID).select("key", "value", "expiry", "state", "seq")
    changelog.append_log(later.filter("state = 0"), f"{path}/log")
    changelog.rotate_log(spark, f"{path}/log")
    changelog.append_log(later.filter("state = 1"), f"{path}/log")
    entries = changelog.read_log(spark, f"{path}/log", "key string, value string, expiry long, state tinyint, seq long")
    return changelog.restore_and_replay(spark, f"{path}/snapshots", entries, LOG_MID).withColumn("state", F.col("state").cast("int"))


def _record(rows):
    return rows.select("key", "value", "expiry", F.col("state").cast("tinyint").alias("state"), "run_id")


def _store(spark, d):
    """A store with a run for each year of RUNS, loaded in one pass."""
    store = RunStore(spark, scratch(spark, "runs"))
    newest = resolve.newest(runs(spark, d).withColumn("key", F.struct("run_id", "key")), RUN_ORDER)
    store.load(_record(newest.withColumn("key", F.col("key.key"))), NOW)
    return store


def _flushed_store(spark, d):
    """The same, flushed year by year, the oldest first."""
    store = RunStore(spark, scratch(spark, "runs"))
    years = [r.run_id for r in runs(spark, d).select("run_id").distinct().orderBy("run_id").collect()]
    for y in years:
        one = resolve.newest(runs(spark, d).filter(F.col("run_id") == y), RUN_ORDER)
        store.flush(_record(one).drop("run_id"), NOW)
    return store


@query(f"WITH {RUNS}, n AS (SELECT * FROM runs {RUN_NEWEST}) SELECT key, value FROM n WHERE {LIVE}")
def lsm_store_state(spark, d):
    """Runs flushed and read back: the newest version over all of them."""
    return _flushed_store(spark, d).state(NOW).select("key", "value")


@query(f"WITH {RUNS}, n AS (SELECT * FROM runs {RUN_NEWEST}) SELECT key, value FROM n WHERE {LIVE} AND key = (SELECT min(key) FROM n WHERE {LIVE})")
def lsm_store_get(spark, d):
    store = _store(spark, d)
    first = resolve.newest(runs(spark, d), RUN_ORDER).filter(S.live(F.col("expiry"), F.col("state"), NOW)).agg(F.min("key").alias("key")).first().key
    return store.get(first, NOW).select("key", "value")


@query(f"""WITH {RUNS}, n AS (SELECT * FROM runs {RUN_NEWEST}), l AS (SELECT * FROM n WHERE {LIVE})
SELECT 1 AS level, count(*) AS num_records, min(key) AS first_key, max(key) AS last_key, CAST(sum(value) AS DECIMAL(38, 2))::VARCHAR AS total FROM (SELECT key, CAST(value AS DECIMAL(18, 2)) AS value FROM l)""")
def lsm_store_compact(spark, d):
    """All runs of the top level into one of the next, by the store; its manifest row and the sum of what it holds."""
    store = _store(spark, d)
    new = store.compact(0, NOW)
    total = store.read(new).agg(F.sum(F.col("value").cast("decimal(18,2)")).cast("string").alias("total"))
    return store.manifest().select("level", "num_records", "first_key", "last_key").join(F.broadcast(total), F.lit(True))


# Expiry and eviction


@query(f"WITH {KO} SELECT key FROM ko WHERE {FNV.format(k='key')} % 64 = 7 AND expiry < {NOW} ORDER BY key LIMIT 1000")
def expire_shard_sample(spark, d):
    return maintenance.expire_sample(ko(spark, d), 7, NOW)


@query(f"WITH {KO} SELECT key, value FROM ko WHERE key NOT IN (SELECT key FROM ko WHERE {FNV.format(k='key')} % 64 = 7 AND expiry < {NOW} ORDER BY key LIMIT 1000)")
def expire_shard_remaining(spark, d):
    return maintenance.expire_shard(ko(spark, d), 7, NOW)[0].select("key", "value")


@query(f"WITH {KO}, e AS (SELECT key, {FNV.format(k='key')} % 64 AS shard FROM ko WHERE expiry < {NOW}) SELECT CAST(shard AS INTEGER) AS shard, key, CAST((row_number() OVER (PARTITION BY shard ORDER BY key) - 1) // 100 AS BIGINT) AS round FROM e")
def expire_rounds(spark, d):
    return maintenance.expire_rounds(ko(spark, d), NOW, limit=100)


@query(f"""WITH {KO}, k AS (SELECT key, lat, octet_length(encode(key)) + 24 AS bytes, coalesce(sum(octet_length(encode(key)) + 24) OVER (ORDER BY lat DESC, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM ko)
SELECT key, CAST(bytes AS BIGINT) AS bytes, CAST(ahead AS BIGINT) AS bytes_ahead, ahead + bytes <= 100000 AS keep FROM k""")
def evict_lru_plan(spark, d):
    state = ko(spark, d)
    size = S.entry_size(F.col("key"), F.col("value"), state.schema["value"].dataType)
    return maintenance.lru_plan(state, size, 100_000).select("key", "bytes", "bytes_ahead", "keep")


@query(f"WITH {KO} SELECT CAST(sum(octet_length(encode(key)) + 24) AS BIGINT) AS used, sum(octet_length(encode(key)) + 24) > 400000 * 1.01 AS overflown FROM ko")
def memory_overflow(spark, d):
    state = ko(spark, d)
    return maintenance.memory_use(state, S.entry_size(F.col("key"), F.col("value"), state.schema["value"].dataType), 400_000)


# Hashes, filters and scalars


@query(f"SELECT doc_id, CAST({FNV.format(k='key')} AS BIGINT) AS fnv, CAST({FNV.format(k='key')} % 64 AS INTEGER) AS shard FROM (SELECT doc_id, 'doc:' || doc_id AS key FROM documents)")
def hash_fnv_shards(spark, d):
    k = F.concat(F.lit("doc:"), F.col("doc_id").cast("string"))
    return table(spark, d, "documents").select("doc_id", S.fnv1a32(k).alias("fnv"), S.shard_of(k).alias("shard"))


U64 = "CAST(18446744073709551616 AS UHUGEINT)"
U = lambda n: f"CAST({n} AS UHUGEINT)"
_times = lambda x, n: f"((({x}) * {U(n)}) % {U64})"
_turned = lambda x, r: f"(((({x}) * {U(1 << r)}) % {U64}) + (({x}) // {U(1 << (64 - r))}))"
_lane = lambda w, a, r, b: _times(_turned(_times(w, a), r), b)
_bytes = lambda lo, hi: f"list_reduce(list_prepend({U(0)}, list_transform(range({hi}, {lo}, -1), lambda i: CAST(ascii(substr(key, i, 1)) AS UHUGEINT))), lambda a, b: a * {U(256)} + b)"
#: The hash in SQL, one step a column, for the ASCII keys of fewer than 16 bytes that orders have.
MURMUR = f"""b AS (SELECT key, CAST(length(key) AS BIGINT) AS n FROM ko),
m0 AS (SELECT key, n, {_bytes("0", "least(n, 8)")} AS low, {_bytes("8", "n")} AS high FROM b),
m1 AS (SELECT key, n, low, CASE WHEN n > 8 THEN xor({U(PARTITION_SEED)}, {_lane("high", int(C2), 33, int(C1))}) ELSE {U(PARTITION_SEED)} END AS h FROM m0),
m2 AS (SELECT key, xor(xor(h, {_lane("low", int(C1), 31, int(C2))}), CAST(n AS UHUGEINT)) AS h FROM m1),
m3 AS (SELECT key, {_times(f"xor(h, h // {U(1 << 33)})", int(F1))} AS h FROM m2),
m4 AS (SELECT key, {_times(f"xor(h, h // {U(1 << 33)})", int(F2))} AS h FROM m3)"""


@query(f"WITH {KO}, {MURMUR} SELECT key, CAST(xor(h, h // {U(1 << 33)}) % {U(4096)} AS INTEGER) AS partition FROM m4")
def hash_partition_4096(spark, d):
    return ko(spark, d).select("key", partition_of(F.col("key")).alias("partition"))


FNV64 = f"list_reduce(list_prepend({U(14695981039346656037)}, list_transform(range(1, CAST(length(name) AS BIGINT) + 1), lambda i: CAST(ascii(substr(name, i, 1)) AS UHUGEINT))), lambda h, b: (xor(h, b) * {U(1099511628211)}) % {U64})"


@query(f"""WITH b AS (SELECT o_orderkey // 500 AS block, min(o_orderkey) AS f, max(o_orderkey) AS l FROM orders GROUP BY 1), h AS (SELECT block, {FNV64} AS h FROM (SELECT block, 'o:' || f || 'o:' || l AS name FROM b))
SELECT CAST(block AS BIGINT) AS block, CAST(CASE WHEN h >= {U(2**63)} THEN CAST(h AS HUGEINT) - CAST(18446744073709551616 AS HUGEINT) ELSE CAST(h AS HUGEINT) END AS BIGINT) AS id, CAST(h % {U(64)} AS INTEGER) AS cache_shard FROM h""")
def hash_block_ids(spark, d):
    b = table(spark, d, "orders").groupBy(F.floor(F.col("o_orderkey") / 500).cast("long").alias("block")).agg(F.min("o_orderkey").alias("f"), F.max("o_orderkey").alias("l"))
    name = lambda c: F.concat(F.lit("o:"), F.col(c).cast("string"))
    return b.select("block", S.block_id(name("f"), name("l")).alias("id")).withColumn("cache_shard", F.col("id").bitwiseAND(F.lit(63)).cast("int"))


@query(f"WITH {KO} SELECT key, value, lat, expiry, state FROM ko")
def record_roundtrip(spark, d):
    """Records to JSON objects and back."""
    state = ko(spark, d)
    text = state.select("key", S.record_json(F.col("value"), F.col("lat"), F.col("expiry"), F.col("state")).alias("text"))
    return text.select("key", S.record_of(F.col("text"), state.schema["value"].dataType).alias("r")).select("key", "r.value", "r.lat", "r.expiry", F.col("r.state").cast("int").alias("state"))


@query("SELECT (s_suppkey + 1) * 100 AS n, CAST(ceil(-((s_suppkey + 1) * 100) * ln(0.01) / pow(ln(2), 2)) AS BIGINT) AS bits, CAST(ceil(ln(2) * (-((s_suppkey + 1) * 100) * ln(0.01) / pow(ln(2), 2)) / ((s_suppkey + 1) * 100)) AS INTEGER) AS hashes FROM supplier")
def bloom_sizing(spark, d):
    n = ((F.col("s_suppkey") + 1) * 100).alias("n")
    m = -F.col("n") * F.ln(F.lit(0.01)) / F.pow(F.ln(F.lit(2.0)), F.lit(2.0))
    return table(spark, d, "supplier").select(n).withColumn("bits", F.ceil(m).cast("long")).withColumn("hashes", F.ceil(F.ln(F.lit(2.0)) * m / F.col("n")).cast("int"))


def fnv_seeded(key, seed):
    """A filter's hash that any SQL engine can find: FNV of the seed and the key."""
    return S.fnv1a32(F.concat(F.lit(f"{seed}|"), key))


@query(f"""WITH k AS (SELECT 'c:' || c_custkey AS key, c_custkey % 2 = 0 AS member FROM customer),
p AS (SELECT key, member, {FNV.format(k="(s || '|' || key)")} % 8192 AS pos FROM k, (VALUES ('2'), ('3'), ('5'), ('7')) t(s)),
b AS (SELECT DISTINCT pos FROM p WHERE member)
SELECT p.key, bool_and(b.pos IS NOT NULL) AS maybe FROM p LEFT JOIN b ON b.pos = p.pos GROUP BY p.key""")
def bloom_membership(spark, d):
    keys = table(spark, d, "customer").select(F.concat(F.lit("c:"), F.col("c_custkey").cast("string")).alias("key"), (F.col("c_custkey") % 2 == 0).alias("member"))
    built = bits.bloom_build(keys.filter("member"), 8192, 4, fnv_seeded)
    return bits.bloom_probe(built, keys, 8192, 4, fnv_seeded)


@query("SELECT CAST(0 AS BIGINT) AS false_negatives, count(*) AS n_keys FROM customer")
def bloom_no_false_negative(spark, d):
    keys = table(spark, d, "customer").select(F.concat(F.lit("c:"), F.col("c_custkey").cast("string")).alias("key"))
    size, k = S.bloom_size(100_000, 0.01)
    found = bits.bloom_probe(bits.bloom_build(keys, size, k), keys, size, k)
    return found.agg(F.count_if(~F.col("maybe")).alias("false_negatives"), F.count(F.lit(1)).alias("n_keys"))


@query("SELECT l_suppkey AS suppkey, count(DISTINCT l_partkey) AS n_set FROM lineitem GROUP BY l_suppkey")
def bitset_popcount(spark, d):
    words = bits.bitset(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("suppkey"), "l_partkey"), F.col("l_partkey"), ["suppkey"])
    return words.groupBy("suppkey").agg(F.sum(F.bit_count("bits")).cast("long").alias("n_set"))


@query("SELECT l_partkey // 64 AS word, CAST(count(DISTINCT l_partkey) AS BIGINT) AS n_set, count(DISTINCT CASE WHEN l_returnflag <> 'N' THEN l_partkey END) AS n_left, count(DISTINCT CASE WHEN l_returnflag = 'N' THEN l_partkey END) AS n_right FROM lineitem GROUP BY 1")
def bitset_union(spark, d):
    l = table(spark, d, "lineitem")  # noqa: E741
    one = lambda c: bits.bitset(l.filter(c).select("l_partkey"), F.col("l_partkey"))
    a, b = one("l_returnflag <> 'N'"), one("l_returnflag = 'N'")
    count = lambda df, name: df.select("word", F.bit_count("bits").cast("long").alias(name))
    u = count(bits.union(a, b), "n_set").join(count(a, "n_left"), "word", "left").join(count(b, "n_right"), "word", "left")
    return u.select("word", "n_set", F.coalesce("n_left", F.lit(0).cast("long")).alias("n_left"), F.coalesce("n_right", F.lit(0).cast("long")).alias("n_right"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_partkey << 32) | l_suppkey AS packed, CAST(l_partkey AS INTEGER) AS first, CAST(l_suppkey AS INTEGER) AS second, CAST(-l_linenumber AS INTEGER) AS negative FROM lineitem")
def pack_unpack(spark, d):
    p = S.pack(F.col("l_partkey"), F.col("l_suppkey"))
    n = S.pack(F.col("l_partkey"), -F.col("l_linenumber"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", p.alias("packed"), S.unpack_first(p).alias("first"), S.unpack_second(p).alias("second"), S.unpack_second(n).alias("negative"))


@query("""SELECT event_id, 2 AS tag_id, CASE WHEN value IS NULL THEN 9 ELSE 3 END AS tag_value, CASE WHEN props IS NULL THEN 9 ELSE 4 END AS tag_props, 6 AS tag_list, 1 AS tag_flag, CAST(octet_length(encode(props)) + 16 AS BIGINT) AS size_props, CAST(24 + 2 * 8 AS BIGINT) AS size_list FROM events""")
def type_tags_and_sizes(spark, d):
    e = table(spark, d, "events").withColumn("list", F.array("event_id", "user_id")).withColumn("flag", F.col("event_id") > 0)
    tag = lambda c: S.type_tag_of(F.col(c), e.schema[c].dataType)
    size = lambda c: S.size_of(F.col(c), e.schema[c].dataType)
    return e.select("event_id", tag("event_id").alias("tag_id"), tag("value").alias("tag_value"), tag("props").alias("tag_props"), tag("list").alias("tag_list"), tag("flag").alias("tag_flag"), size("props").alias("size_props"), size("list").alias("size_list"))


@query("SELECT o_orderkey, list_position(['F', 'O', 'P'], o_orderstatus) - 1 AS place, greatest(o_custkey, o_orderkey) AS larger, CAST(epoch(o_orderdate) AS BIGINT) AS epoch_s, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS readable FROM orders")
def scalar_helpers(spark, d):
    place = S.index_in(F.array(*[F.lit(x) for x in "FOP"]), F.col("o_orderstatus"))
    return table(spark, d, "orders").select("o_orderkey", place.alias("place"), F.greatest("o_custkey", "o_orderkey").alias("larger"), epoch("o_orderdate").alias("epoch_s"), S.readable(epoch("o_orderdate")).alias("readable"))


# Vectors

VEC = "v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x, label FROM embeddings), q AS (SELECT x AS y FROM v WHERE id = (SELECT min(id) FROM v))"


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def _query_vector(v):
    return v.orderBy("id").limit(1).collect()[0].vector


def _topk(spark, d, metric):
    v = _vectors(spark, d)
    return vector.knn(v, _query_vector(v), 10, metric).select("id", r6("score").alias("score"))


@query(f"WITH {VEC} SELECT id, round(list_cosine_similarity(x, y), 6) AS score FROM v, q ORDER BY list_cosine_similarity(x, y) DESC, id LIMIT 10")
def vec_cosine_topk(spark, d):
    return _topk(spark, d, "cosine")


@query(f"WITH {VEC} SELECT id, round(-list_distance(x, y), 6) AS score FROM v, q ORDER BY list_distance(x, y), id LIMIT 10")
def vec_l2_topk(spark, d):
    return _topk(spark, d, "l2")


@query(f"WITH {VEC} SELECT id, round(list_inner_product(x, y), 6) AS score FROM v, q ORDER BY list_inner_product(x, y) DESC, id LIMIT 10")
def vec_dot_topk(spark, d):
    return _topk(spark, d, "dot")


NEIGHBOURS = "w AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x, label FROM embeddings), nn AS (SELECT a.id AS query, b.id, list_cosine_similarity(a.x, b.x) AS s, row_number() OVER (PARTITION BY a.id ORDER BY list_cosine_similarity(a.x, b.x) DESC, b.id) AS rank FROM w a JOIN w b ON a.id <> b.id WHERE a.id % 50 = 0 QUALIFY rank <= 5)"


def _neighbours(spark, d):
    v = _vectors(spark, d)
    return v, vector.batch_knn(v, v.filter("id % 50 = 0"), 5, exclude_self=True)


@query(f"WITH {NEIGHBOURS} SELECT query, id, round(s, 6) AS score, CAST(rank AS INTEGER) AS rank FROM nn")
def vec_batch_knn(spark, d):
    return _neighbours(spark, d)[1].select("query", "id", r6("score").alias("score"), "rank")


@query(f"WITH {NEIGHBOURS}, c AS (SELECT query, label, count(*) AS votes FROM nn JOIN w USING (id) GROUP BY query, label) SELECT query, label, votes FROM c QUALIFY row_number() OVER (PARTITION BY query ORDER BY votes DESC, label) = 1")
def vec_label_vote(spark, d):
    v, n = _neighbours(spark, d)
    return vector.label_vote(n, v)


@query()
def vec_hnsw_knn(spark, d):
    """Approximate, so without SQL: a test holds its recall against ``vec_batch_knn``'s exact neighbours."""
    v = _vectors(spark, d)
    return hnsw.search(hnsw.build(v), v.filter("id % 50 = 0"), 5, exclude_self=True).select("query", "id", r6("score").alias("score"), "rank")


# Service


@query(f"WITH RECURSIVE {KT}, {fold_sql('kt')} SELECT s.key, s.seq, s.op, f.live, f.num, f.txt, f.expiry, f.code, f.data FROM f JOIN steps s ON s.key = f.key AND s.i = f.i")
def kv_command_codes(spark, d):
    """Every command's response."""
    return resolve.responses(kt(spark, d))


@query(f"WITH RECURSIVE {KT}, {fold_sql('kt')} SELECT s.op, f.code, count(*) AS n FROM f JOIN steps s ON s.key = f.key AND s.i = f.i GROUP BY ALL")
def command_counters(spark, d):
    return service.counters(resolve.responses(kt(spark, d)))


@query(f"""WITH RECURSIVE {KL}, old AS (SELECT * FROM kl WHERE ts <= {LOG_MID}), {fold_sql('old')},
base AS (SELECT key, num, CASE WHEN expiry = 4102444800 THEN 0 ELSE expiry - {LOG_MID} + 1 END AS ttl FROM folded WHERE live AND expiry >= {LOG_MID}),
new AS (SELECT seq, ts, op, key, num, txt, ttl FROM kl WHERE ts > {LOG_MID}),
joint AS (SELECT CAST(-1 AS BIGINT) AS seq, {LOG_MID} - 1 AS ts, 'SET' AS op, key, num, CAST(NULL AS VARCHAR) AS txt, ttl FROM base WHERE key IN (SELECT key FROM new) UNION ALL SELECT * FROM new),
{fold_sql('joint', '2')}
SELECT s.key, s.seq, s.op, g.code, g.data FROM f2 g JOIN steps2 s ON s.key = g.key AND s.i = g.i WHERE s.seq >= 0""")
def kv_batch_on_state(spark, d):
    """The second half's commands as one batch on the state that the first half left."""
    log = kl(spark, d)
    state = resolve.fold(log.filter(F.col("ts") <= LOG_MID)).filter("live").select("key", F.col("num").alias("value"), "expiry", F.lit(0).cast("byte").alias("state"))
    return service.batch(state, log.filter(F.col("ts") > LOG_MID), LOG_MID).select("key", "seq", "op", "code", "data")


@query(f"WITH {KO}, s AS (SELECT count(*) AS total_keys, count(*) FILTER (WHERE expiry <> 4102444800) AS keys_with_ttl, CAST(coalesce(sum(octet_length(encode(key)) + 24), 0) AS BIGINT) AS bytes FROM ko WHERE {LIVE}) SELECT *, '{{\"total_keys\":' || total_keys || ',\"keys_with_ttl\":' || keys_with_ttl || ',\"bytes\":' || bytes || '}}' AS json FROM s")
def info_stats(spark, d):
    state = ko(spark, d)
    alive = state.filter(S.live(F.col("expiry"), F.col("state"), NOW))
    return service.info(alive, S.entry_size(F.col("key"), F.col("value"), state.schema["value"].dataType))


@query("SELECT 'OK' AS data, 200 AS code, '' AS message")
def ping(spark, d):
    return service.ping(spark)


# Analytics over keyspaces and tables


@query(f"WITH {KL} SELECT key, seq, op FROM kl WHERE ts <= {LOG_MID} QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1")
def asof_latest(spark, d):
    return reads.as_of(kl(spark, d), LOG_MID).select("key", "seq", "op")


@query("""WITH p AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, ts, max(event_id) AS view_id FROM events WHERE event_type = 'view' GROUP BY user_id, ts)
SELECT p.event_id, v.view_id FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts""")
def asof_join(spark, d):
    e = table(spark, d, "events")
    left = e.filter("event_type = 'purchase'").select("user_id", "ts", "event_id")
    right = e.filter("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("event_id").alias("view_id"))
    return reads.as_of_join(left, right, "user_id", "ts", ["view_id"]).select("event_id", F.col("asof_view_id").alias("view_id"))


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "c_name")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P'")
def join_left(spark, d):
    o, c = table(spark, d, "orders").filter("o_orderstatus = 'P'"), table(spark, d, "customer")
    return c.join(o, o.o_custkey == c.c_custkey, "left").select("c_custkey", "o_orderkey")


@query("SELECT s_suppkey, c_custkey FROM (SELECT * FROM supplier WHERE s_acctbal > 0) FULL JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON s_suppkey = c_custkey")
def join_full(spark, d):
    s, c = table(spark, d, "supplier").filter("s_acctbal > 0"), table(spark, d, "customer").filter("c_acctbal > 0")
    return s.join(c, s.s_suppkey == c.c_custkey, "full").select("s_suppkey", "c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def join_semi(spark, d):
    o, c = table(spark, d, "orders").filter("o_totalprice > 200000"), table(spark, d, "customer")
    return c.join(o, o.o_custkey == c.c_custkey, "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_anti(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    return c.join(o, o.o_custkey == c.c_custkey, "left_anti").select("c_custkey")


@query("SELECT n_nationkey, r_regionkey FROM nation JOIN region ON n_regionkey < r_regionkey")
def join_theta(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    return n.join(r, n.n_regionkey < r.r_regionkey).select("n_nationkey", "r_regionkey")


@query("""SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_qty, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS sum_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus""")
def agg_pricing(spark, d):
    l = table(spark, d, "lineitem").filter("l_shipdate <= timestamp_ntz'1998-09-02 00:00:00'")  # noqa: E741
    return l.groupBy("l_returnflag", "l_linestatus").agg(money("l_quantity").alias("sum_qty"), money("l_extendedprice").alias("sum_price"), r6(F.avg("l_discount")).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def agg_cube(spark, d):
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderstatus, o_orderpriority, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def agg_rollup(spark, d):
    return table(spark, d, "orders").rollup("o_orderstatus", "o_orderpriority").agg(money("o_totalprice").alias("total"))


@query("SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())")
def agg_grouping_sets(spark, d):
    c = table(spark, d, "customer")
    return c.groupingSets([[c.c_mktsegment], [c.c_nationkey], []], "c_mktsegment", "c_nationkey").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, count(DISTINCT user_id) AS n_users, count(DISTINCT props) AS n_props FROM events GROUP BY event_type")
def distinct_agg(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("n_users"), F.count_distinct("props").alias("n_props"))


@query("SELECT c_nationkey, c_custkey, CAST(rank() OVER w AS INTEGER) AS rnk, CAST(dense_rank() OVER w AS INTEGER) AS dense FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal DESC)")
def win_rank(spark, d):
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"))
    return table(spark, d, "customer").select("c_nationkey", "c_custkey", F.rank().over(w).alias("rnk"), F.dense_rank().over(w).alias("dense"))


@query("SELECT user_id, event_id, lag(event_type) OVER w AS before, lead(event_id, 2) OVER w AS ahead FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def win_lag(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, d, "events").select("user_id", "event_id", F.lag("event_type").over(w).alias("before"), F.lead("event_id", 2).over(w).alias("ahead"))


@query("SELECT o_custkey, o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS DOUBLE) AS moving FROM orders")
def win_frame(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(-2, 0)
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.sum(F.col("o_totalprice").cast("decimal(18,2)")).over(w).cast("double").alias("moving"))


@query("SELECT s_nationkey AS k FROM supplier UNION SELECT c_nationkey FROM customer")
def set_union(spark, d):
    return table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")).union(table(spark, d, "customer").select("c_nationkey")).distinct()


@query("SELECT l_partkey AS k FROM lineitem INTERSECT SELECT p_partkey FROM part WHERE p_size > 25")
def set_intersect(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("k")).intersect(table(spark, d, "part").filter("p_size > 25").select("p_partkey"))


@query("SELECT o_custkey AS k FROM orders EXCEPT ALL SELECT c_custkey FROM customer")
def set_except(spark, d):
    return table(spark, d, "orders").select(F.col("o_custkey").alias("k")).exceptAll(table(spark, d, "customer").select("c_custkey"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def topk(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_field(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS stop, event_type, count(*) AS n FROM events GROUP BY ALL")
def win_tumbling(spark, d):
    return streams.windowed_counts(table(spark, d, "events"), "1 hour", by=("event_type",)).drop("total")


@query("""WITH s AS (SELECT time_bucket(INTERVAL 30 MINUTE, ts) - o * INTERVAL 30 MINUTE AS start FROM events, (VALUES (0), (1)) t(o))
SELECT start, start + INTERVAL 1 HOUR AS stop, count(*) AS n FROM s GROUP BY start""")
def win_sliding(spark, d):
    return streams.windowed_counts(table(spark, d, "events"), "1 hour", "30 minutes").drop("total")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
n AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS stop, count(*) AS n FROM n GROUP BY user_id, s""")
def win_session(spark, d):
    return streams.session_counts(table(spark, d, "events"), "2 hours", by=("user_id",))


@query(f"WITH RECURSIVE {KL}, s AS (SELECT max(seq) AS seq, key FROM kl GROUP BY key), {fold_sql('kl')} SELECT f.key, s.seq, f.live, f.num, f.expiry, f.code, f.data FROM folded f JOIN s USING (key)")
def stream_kv_state(spark, d):
    """The command log as a stream through keyed state, to its last response for each key: the fold's rows."""
    from .streaming_runs import responses

    return responses(spark, kl(spark, d)).select("key", "seq", "live", "num", "expiry", "code", "data")


@query("""WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS stop, count(*) AS n FROM events GROUP BY ALL)
SELECT start, stop, n FROM w WHERE stop <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 2 HOUR FROM events)""")
def stream_late_dropped(spark, d):
    """Append mode: every event comes once more a day late and after all others, and no window counts it."""
    from .streaming_runs import hourly_append

    e = table(spark, d, "events")
    return hourly_append(spark, e, e.withColumn("ts", F.col("ts") - F.expr("interval 1 day")))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS stop, count(*) AS n FROM events GROUP BY ALL")
def stream_watermark_late(spark, d):
    from .streaming_runs import hourly

    return hourly(spark, table(spark, d, "events"))


# Languages and function families over resolved state


@query(f"WITH {KO} SELECT state, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) AS total FROM ko WHERE {LIVE} GROUP BY state")
def sql_over_view(spark, d):
    reads.as_view(ko(spark, d), "live_orders", NOW)
    return spark.sql("SELECT state, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) AS total FROM live_orders GROUP BY state")


@query("SELECT event_type, count(DISTINCT user_id) AS exact, true AS near FROM events GROUP BY event_type")
def approx_distinct(spark, d):
    """The sketch's count is within three of its standard errors, 5 percent each."""
    g = table(spark, d, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("exact"), F.approx_count_distinct("user_id", 0.05).alias("about"))
    return g.select("event_type", "exact", (F.abs(F.col("about") - F.col("exact")) <= 0.15 * F.col("exact") + 1).alias("near"))


@query("SELECT l_returnflag, true AS near FROM lineitem GROUP BY l_returnflag")
def approx_quantiles(spark, d):
    """The share of rows up to each approximate quartile is that quartile, to a hundredth."""
    l = table(spark, d, "lineitem")  # noqa: E741
    q = l.groupBy("l_returnflag").agg(F.percentile_approx("l_extendedprice", [0.25, 0.5, 0.75], 10_000).alias("q"))
    share = lambda k: F.avg((F.col("l_extendedprice") <= F.col("q")[k]).cast("double"))
    near = [F.abs(share(k) - p) <= 0.01 for k, p in enumerate((0.25, 0.5, 0.75))]
    return l.join(F.broadcast(q), "l_returnflag").groupBy("l_returnflag").agg((near[0] & near[1] & near[2]).alias("near"))


@query("SELECT c_custkey, upper(c_name) AS up, reverse(c_mktsegment) AS back, lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS padded, replace(c_name, '#', '-') AS swapped, split_part(c_name, '#', 2) AS tail, strpos(c_name, '#') AS at, regexp_replace(c_name, '[0-9]', '', 'g') AS letters, trim('  ' || c_mktsegment || ' ') AS trimmed FROM customer")
def fn_strings(spark, d):
    n = F.col("c_name")
    return table(spark, d, "customer").select("c_custkey", F.upper(n).alias("up"), F.reverse("c_mktsegment").alias("back"), F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("padded"), F.replace(n, F.lit("#"), F.lit("-")).alias("swapped"), F.split_part(n, F.lit("#"), F.lit(2)).alias("tail"), F.instr(n, "#").cast("long").alias("at"), F.regexp_replace(n, "[0-9]", "").alias("letters"), F.trim(F.concat(F.lit("  "), "c_mktsegment", F.lit(" "))).alias("trimmed"))


@query("SELECT o_orderkey, year(o_orderdate) AS y, quarter(o_orderdate) AS q, date_trunc('month', o_orderdate) AS month, CAST(CAST(o_orderdate AS DATE) + 30 AS VARCHAR) AS later, date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS days, CAST(last_day(CAST(o_orderdate AS DATE)) AS VARCHAR) AS ends FROM orders")
def fn_dates(spark, d):
    c = F.col("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", F.year(c).cast("long").alias("y"), F.quarter(c).cast("long").alias("q"), F.date_trunc("month", c).cast("timestamp_ntz").alias("month"), F.date_add(c.cast("date"), 30).cast("string").alias("later"), F.datediff(c.cast("date"), F.lit("1990-01-01").cast("date")).cast("long").alias("days"), F.last_day(c.cast("date")).cast("string").alias("ends"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(sqrt(l_extendedprice), 6) AS root, round(ln(l_quantity), 6) AS log, abs(l_partkey - l_suppkey) AS apart, l_partkey % 7 AS rest, CAST(sign(l_partkey - l_suppkey) AS INTEGER) AS side, round(power(l_discount, 2), 6) AS square FROM lineitem")
def fn_math(spark, d):
    gap = F.col("l_partkey") - F.col("l_suppkey")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", r6(F.sqrt("l_extendedprice")).alias("root"), r6(F.ln("l_quantity")).alias("log"), F.abs(gap).alias("apart"), (F.col("l_partkey") % 7).alias("rest"), F.signum(gap).cast("int").alias("side"), r6(F.pow("l_discount", F.lit(2.0))).alias("square"))


@query("""WITH m AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)
SELECT user_id, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS counts, CAST(count(*) AS INTEGER) AS kinds, CAST(sum(n) AS BIGINT) AS total, CAST(coalesce(max(CASE WHEN event_type = 'click' THEN n END), 0) AS BIGINT) AS clicks FROM m GROUP BY user_id""")
def fn_maps(spark, d):
    """A map for each user, sorted by key and read as a whole and by key."""
    n = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    m = n.groupBy("user_id").agg(S.sorted_map(F.map_from_entries(F.collect_list(F.struct("event_type", "n")))).alias("m"))
    text = F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    total = F.aggregate(F.map_values("m"), F.lit(0).cast("long"), lambda a, x: a + x)
    return m.select("user_id", text.alias("counts"), F.size("m").alias("kinds"), total.alias("total"), F.coalesce(F.element_at("m", F.lit("click")), F.lit(0)).cast("long").alias("clicks"))


@query("SELECT event_id, CAST(json_extract(json_object('k', event_type, 'v', list_value(user_id, event_id)), '$.v[1]') AS BIGINT) AS second, event_type AS k FROM events")
def fn_json(spark, d):
    """Rows to JSON and back by schema."""
    text = table(spark, d, "events").select("event_id", F.to_json(F.struct(F.col("event_type").alias("k"), F.array("user_id", "event_id").alias("v"))).alias("j"))
    return text.select("event_id", F.from_json("j", "k string, v array<long>").alias("x")).select("event_id", F.col("x.v")[1].alias("second"), "x.k")


@query("SELECT l_suppkey, round(quantile_cont(l_extendedprice, 0.5), 6) AS median FROM lineitem GROUP BY l_suppkey")
def udf_aggregate(spark, d):
    """A user-defined aggregate over Arrow batches."""

    @F.pandas_udf("double")
    def median(v: pd.Series) -> float:
        return float(v.median())

    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(r6(median("l_extendedprice")).alias("median"))


@query("SELECT c_custkey, CAST(i AS INTEGER) AS place, substr(c_mktsegment, CAST(i AS INTEGER) + 1, 1) AS letter FROM customer, range(0, 20) r(i) WHERE i < length(c_mktsegment)")
def udtf_letters(spark, d):
    """A user-defined table function, joined laterally."""

    @F.udtf(returnType="place int, letter string")
    class Letters:
        def eval(self, text: str):
            yield from enumerate(text)

    spark.udtf.register("letters_of", Letters)
    table(spark, d, "customer").createOrReplaceTempView("customer_segments")
    return spark.sql("SELECT c_custkey, place, letter FROM customer_segments, LATERAL letters_of(c_mktsegment)")
