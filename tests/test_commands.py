"""The commands' fixed cases: codes, expiry, folds, sizes, hashes, runs and vectors."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kvlake.functions import murmur, scalar
from kvlake.functions import vectors as V
from kvlake.model import NEVER, SENTINEL
from kvlake.operators import bits, maintenance, reads, resolve, service, vector, writes
from kvlake.sources import changelog, config
from kvlake.sources.runs import RunStore
from kvlake.streaming.state import command

NOW = 1_000_000
STATE = "key string, value string, expiry long, state tinyint"


def rows(df):
    return {tuple(r) for r in df.collect()}


@pytest.fixture(scope="module")
def state(spark):
    return spark.createDataFrame([("a", "1", NEVER, 0), ("b", "2", NOW - 1, 0), ("c", "3", NOW, 0), ("d", "4", NEVER, 1)], STATE)


def keys(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "key string")


def test_reads(spark, state):
    asked = keys(spark, "a", "a", "b", "c", "d", "x")
    assert rows(reads.mget(state, asked, NOW)) == {("a", "1", 1000), ("b", None, 5002), ("c", "3", 1000), ("d", None, 5001), ("x", None, 5001)}
    assert {(r.key, r.code) for r in reads.mget(state, asked, NOW, merged=True).collect()} >= {("b", 5001)}
    assert rows(reads.ttl(state, asked, NOW)) == {("a", NEVER - NOW, 1000), ("b", 0, 5002), ("c", 0, 1000), ("d", 0, 5001), ("x", 0, 5001)}
    assert rows(reads.exists(state, keys(spark, "a", "b"), NOW)) == {("a", True, 1000), ("b", False, 5002)}
    assert [r.key for r in reads.scan_ordered(state, NOW).collect()] == ["a", "c", "d"]
    assert [r.key for r in reads.scan_ordered(state, NOW, strict=True).collect()] == ["a", "d"]
    assert reads.get(state, "b", NOW).count() == 0 and reads.get(state, "a", NOW).count() == 1
    one = reads.mget_map(state, keys(spark, "a", "x"), NOW).first()
    assert one.code == 1100 and one.data["x"].code == 5001 and one.data["a"].value == "1"


FOLDS = [
    ([("SET", 10, None, 0), ("INCR", 5, None, 0)], 1001, 15),
    ([("SET", 10, None, 0), ("INCR", 5, None, 0), ("DECR", 3, None, 0)], 1001, 12),
    ([("SET", 100, None, 0), ("APPEND", None, "x", 0)], 5004, SENTINEL),
    ([("SET", None, "abcd", 0), ("APPEND", None, "_pqr", 0)], 1001, 8),
    ([("SET", None, "", 0), ("APPEND", None, "é", 0)], 1001, 2),
    ([("SET", None, "t", 0), ("INCR", 1, None, 0)], 5004, SENTINEL),
    ([("INCR", 1, None, 0)], 5001, SENTINEL),
    ([("DELETE", None, None, 0)], 1002, 1),
    ([("EXPIRE", None, None, 10)], 5001, 0),
    ([("SET", 1, None, 1), ("GET", None, None, 0), ("TTL", None, None, 0), ("GET", None, None, 0)], 5001, 0),
    ([("SET", 1, None, 10), ("EXPIRE", None, None, -5), ("TTL", None, None, 0)], 1000, NEVER - 3),
    ([("SET", 1, None, 60), ("EXPIRE", None, None, 30), ("TTL", None, None, 0)], 1000, 29),
]


@pytest.mark.parametrize("commands, code, data", FOLDS)
def test_fold_step(commands, code, data):
    record = (False, None, None, NEVER)
    for ts, (op, num, txt, ttl) in enumerate(commands, 1):
        record, got, value = command(record, op, ts, num, txt, ttl)
    assert (got, value) == (code, data)


def test_fold(spark):
    log = [(ts, ts, op, str(k), num, txt, ttl) for k, (c, *_) in enumerate(FOLDS) for ts, (op, num, txt, ttl) in enumerate(c, 1)]
    got = {r.key: (r.code, r.data) for r in resolve.fold(spark.createDataFrame(log, "seq long, ts long, op string, key string, num long, txt string, ttl long")).collect()}
    assert got == {str(k): (code, data) for k, (_, code, data) in enumerate(FOLDS)}


def test_increment_at_the_expiry_second_stays_for_good():
    record, *_ = command((True, 1, None, 5), "INCR", 5, 1, None, 0)
    assert record == (True, 2, None, NEVER)


def test_keyspace_commands(spark, state):
    ks = service.Keyspace(state)
    assert ks.run("GET", ["a"], NOW).first().code == 1000
    assert ks.run("set", ["n", "v", 5], NOW).run("TTL", ["n"], NOW).first().ttl == 5
    assert ks.run("APPEND", ["a", "éx"], NOW).run("GET", ["a"], NOW).first().value == "1éx"
    assert ks.run("DELETE", ["a"], NOW).run("GET", ["a"], NOW).first().code == 5001
    assert ks.run("EXPIRE", ["a", 9], NOW).run("TTL", ["a"], NOW).first().ttl == 9
    assert ks.run("MSET", [{"a": "9", "q": "8"}], NOW).run("MGET", [["a", "q"]], NOW).first().data["q"].value == "8"
    numbers = service.Keyspace(spark.createDataFrame([("k", 100, NEVER, 0)], "key string, value long, expiry long, state tinyint"))
    assert numbers.run("INCR", ["k", 10], NOW).run("DECR", ["k", 20], NOW).run("GET", ["k"], NOW).first().value == 90
    assert ks.run("PING", [], NOW).first().code == 200 and ks.run("HELP", ["get"], NOW).first().usage == "GET <key:string>"
    assert ks.run("INFO", [], NOW).first().total_keys == 2
    assert ks.run("GET", [], NOW) == (None, 5000, "ERR: Incorrect number of arguments provided. Want=1, Have=0")
    assert ks.run("INCR", ["k", "1"], NOW) == (None, 5000, "ERR: offset has invalid type. int64 expected")
    with pytest.raises(ValueError):
        ks.run("NOPE", [], NOW)
    assert ks.run("HELP", [], NOW).count() == len(service.COMMANDS)


def test_writes_answer(spark, state, tmp_path):
    ks = service.Keyspace(state, f"file://{tmp_path}/snap")
    said = lambda k: tuple(k.response.first())[:2]
    assert said(ks.run("SET", ["n", "v", 0], NOW)) == ("true", 1001)
    big = ks.run("SET", ["n", "x" * 2_000_000, 0], NOW)
    assert said(big) == ("false", 5005) and big.run("GET", ["n"], NOW).first().code == 5001
    kept = ks.run("SET", ["a", "x" * 2_000_000, 0], NOW)
    assert kept.run("GET", ["a"], NOW).first().value == "1"
    assert said(ks.run("APPEND", ["a", "éx"], NOW)) == ("4", 1001) and said(ks.run("APPEND", ["zz", "x"], NOW)) == (str(SENTINEL), 5001)
    assert said(ks.run("INCR", ["a", 1], NOW)) == (str(SENTINEL), 5004)
    assert said(ks.run("DELETE", ["zz"], NOW)) == ("true", 1002) and said(ks.run("MDELETE", [["a"]], NOW)) == ("true", 1102)
    assert said(ks.run("EXPIRE", ["zz", 5], NOW)) == ("false", 5001) and said(ks.run("EXPIRE", ["a", 5], NOW)) == ("true", 1001)
    many = ks.run("MSET", [{"p": "1", "q": "y" * 2_000_000}], NOW)
    assert said(many) == ("true", 1101) and many.run("GET", ["p"], NOW).first().code == 1000 and many.run("GET", ["q"], NOW).first().code == 5001
    assert tuple(ks.run("SNAPSHOT", [], NOW).first())[::2] == (3, 201)
    assert service.Keyspace(state).run("SNAPSHOT", [], NOW).first().code == 503
    again = service.opened(spark, config.settings(""), f"file://{tmp_path}/snap", NOW)
    assert {r.key for r in again.state.collect()} == {"a", "d"} and again.run("GET", ["a"], NOW).first().value == "1"
    assert service.opened(spark, config.settings(""), f"file://{tmp_path}/none", NOW).state.count() == 0
    maps = service.Keyspace(spark.createDataFrame([], "key string, value map<string,int>, expiry long, state tinyint"))
    assert said(maps.run("SET", ["k", {"a": 1}, 0], NOW)) == ("false", 5006)


def test_batch_of_commands(spark, state):
    commands = spark.createDataFrame([(1, NOW, "APPEND", "a", None, "x", 0), (2, NOW, "INCR", "a", 1, None, 0), (3, NOW, "GET", "b", None, None, 0), (4, NOW, "TTL", "c", None, None, 0), (5, NOW, "DELETE", "a", None, None, 0), (6, NOW, "GET", "a", None, None, 0)], "seq long, ts long, op string, key string, num long, txt string, ttl long")
    got = service.batch(state, commands, NOW)
    assert {(r.seq, r.code, r.data) for r in got.collect()} == {(1, 1001, 2), (2, 5004, SENTINEL), (3, 5001, 0), (4, 1000, 0), (5, 1002, 1), (6, 5001, 0)}
    assert rows(service.counters(got)) == {("APPEND", 1001, 1), ("INCR", 5004, 1), ("GET", 5001, 2), ("TTL", 1000, 1), ("DELETE", 1002, 1)}
    assert '{"data":2,"code":1001,"message":"record updated"}' in {r.response for r in service.encoded(got).collect()}


def test_set_checks(spark):
    df = spark.createDataFrame([("k", "12345", 0), ("l", "123456", 5), ("m", None, -1)], "key string, value string, ttl long")
    assert {(r.key, r.code, r.expiry) for r in writes.set_rows(df, NOW, limit=5).collect()} == {("k", 1001, NEVER), ("l", 5005, NOW + 5), ("m", 1001, NEVER)}
    maps = spark.createDataFrame([("k", {"1": 2}, 0)], "key string, value map<string,int>, ttl long")
    assert writes.set_rows(maps, NOW).first().code == 5006


def test_types_and_sizes(spark):
    tags = [(T.NullType(), 9), (T.BooleanType(), 1), (T.LongType(), 2), (T.DoubleType(), 3), (T.StringType(), 4), (T.ArrayType(T.LongType()), 6), (T.MapType(T.StringType(), T.LongType()), 7), (T.DateType(), 0)]
    assert all(scalar.type_tag(k) == tag for k, tag in tags)
    df = spark.createDataFrame([(1, 1, True, "hello", "", [1, 2, 3, 4, 5], [True, False, True])], "i long, b tinyint, f boolean, s string, e string, l array<long>, m array<boolean>")
    assert list(df.select(*[scalar.size_of(F.col(c), df.schema[c].dataType).alias(c) for c in df.columns]).first()) == [8, 1, 1, 21, 16, 64, 27]


def test_hashes(spark):
    one = spark.range(1)
    assert one.select(scalar.fnv1a32(F.lit("hello")).alias("h")).first().h == 0x4F9F2CAB
    assert one.select(scalar.checksum(F.lit("hello").cast("binary")).alias("h")).first().h == 907060870
    pairs = [(1, 2), (-1, 5), (5, -1), (-7, -9), (2**31 - 1, -(2**31)), (0, 0)]
    df = spark.createDataFrame(pairs, "a int, b int").withColumn("p", scalar.pack(F.col("a"), F.col("b")))
    assert rows(df.select(scalar.unpack_first(F.col("p")), scalar.unpack_second(F.col("p")))) == set(pairs)
    codes = {"": -3750763034362895579, "a": 0xAF63DC4C8601EC8C - 2**64, "hello": 0xA430D84680AABD0B - 2**64}
    assert {k: one.select(scalar.fnv1a64(F.lit(k)).alias("h")).first().h for k in codes} == codes
    assert scalar.bloom_size(1000, 0.01) == (9586, 7)
    assert [scalar.bloom_hashes(1000, r) for r in (0.05, -0.01, 1.2)] == [5, 7, 7]


def plain_murmur(data: bytes, seed: int) -> int:
    m, turn = (1 << 64) - 1, lambda x, r: (x << r | x >> 64 - r) & ((1 << 64) - 1)
    a, b, h = 0x87C37B91114253D5, 0x4CF5AD432745937F, seed
    first = lambda x: turn(x * a & m, 31) * b & m
    second = lambda x: turn(x * b & m, 33) * a & m
    at = 0
    while len(data) - at >= 16:
        h = (turn(h ^ first(int.from_bytes(data[at : at + 8], "little")), 27) * 5 + 0x52DCE729) & m
        h ^= second(int.from_bytes(data[at + 8 : at + 16], "little"))
        at += 16
    rest = data[at:]
    h ^= second(int.from_bytes(rest[8:], "little")) if len(rest) > 8 else 0
    h ^= first(int.from_bytes(rest[:8], "little")) if rest else 0
    h ^= len(data)
    for f in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h = (h ^ h >> 33) * f & m
    return h ^ h >> 33


def test_murmur(spark):
    texts = ["", "a", "key-1", "12345678", "123456789", "1234567890123456", "é" * 21, "x" * 100]
    assert [int(x) for x in murmur.murmur64([t.encode() for t in texts], 7)] == [plain_murmur(t.encode(), 7) for t in texts]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "k string")
    got = {r.k: r.p for r in df.select("k", murmur.partition_of(F.col("k")).alias("p")).collect()}
    assert got == {t: plain_murmur(t.encode(), murmur.PARTITION_SEED) % 4096 for t in texts} | {None: None}


def test_bits_and_bloom(spark):
    pos = lambda *p: bits.bitset(spark.createDataFrame([(x,) for x in p], "p long"), F.col("p"))
    a, b = pos(0, 1, 63, 64, 200), pos(1, 64, 65)
    assert bits.summary(bits.union(a, b), 1000).first().n_set == 6
    assert bits.summary(bits.toggled(a, b), 1000).first().n_set == 4
    assert bits.summary(bits.cleared(a, b), 1000).first().n_set == 3
    assert bits.summary(pos(*range(100)), 100).first().all_set
    asked = spark.createDataFrame([(0,), (2,), (63,), (999,)], "position long")
    assert rows(bits.is_set(a, asked)) == {(0, True), (2, False), (63, True), (999, False)}
    assert a.filter("word = 1").select(bits.rendered(F.col("bits")).alias("s")).first().s == "1" + "0" * 63
    both = a.withColumn("g", F.lit(1)).unionByName(b.withColumn("g", F.lit(2)))
    assert rows(bits.deserialized(bits.serialized(both, ["g"]), ["g"]).select("word", "bits", "g")) == rows(both.select("word", "bits", "g"))
    assert rows(bits.deserialized(bits.serialized(a))) == rows(a) and bits.memory(65) == 16
    assert bits.checked(asked, 1000).count() == 4
    for size in (999, 1):
        with pytest.raises(ValueError):
            bits.checked(asked, size)
    members = keys(spark, *[f"k{i}" for i in range(1000)])
    size, k = scalar.bloom_size(1000, 0.01)
    built = bits.bloom_build(members, size, k)
    found = bits.bloom_probe(built, members.unionByName(keys(spark, *[f"n{i}" for i in range(1000)])), size, k)
    assert found.filter("key like 'k%' and not maybe").count() == 0 and found.filter("key like 'n%' and maybe").count() < 40


def test_merge_and_compaction(spark):
    run = lambda *r: spark.createDataFrame(list(r), "key string, value int")
    one, two = run(("apple", 1), ("banana", 2)), run(("banana", 3), ("date", 6))
    assert [tuple(r) for r in resolve.merge(one, two).orderBy("key").collect()] == [("apple", 1), ("banana", 3), ("date", 6)]
    assert rows(resolve.merge(one.limit(0), two)) == rows(two)
    past, future = NOW - 1000, NOW + 1000
    v = [(1, "key1", "v1", past, 0), (1, "key2", "v2", future, 0), (1, "key3", "v3", future, 0), (1, "key4", "v4", future, 1), (1, "key5", "v5", future, 0), (1, "key8", "v8", past, 0)]
    v += [(2, "key2", "v2", past, 0), (2, "key5", "value5+1", future, 0), (2, "key6", "v6", future, 0), (2, "key7", "v7", future, 0), (2, "key8", "value8+1", future, 0)]
    df = spark.createDataFrame(v, "run_id long, key string, value string, expiry long, state tinyint")
    got = {r.key: r.value for r in maintenance.compact(df, NOW, ["run_id"]).collect()}
    assert got == {"key3": "v3", "key5": "value5+1", "key6": "v6", "key7": "v7", "key8": "value8+1"}
    meta = "run_id long, first_key string, last_key string"
    assert rows(maintenance.overlapping(spark.createDataFrame([(1, "key1", "key2")], meta), spark.createDataFrame([(2, "key3", "key4"), (3, "key2", "key5")], meta))) == {(1, 3)}
    names = spark.createDataFrame([(f"{n}.sst",) for n in (1001, 1003, 1004, 1005, 1002)], "name string")
    assert [r.run_id for r in maintenance.runs_newest_first(names).collect()] == [1005, 1004, 1003, 1002, 1001]


def test_run_store(spark, tmp_path):
    store = RunStore(spark, f"file://{tmp_path}/runs")
    batch = lambda v, lo, hi: spark.createDataFrame([(f"k{i:03}", v, NEVER, 0) for i in range(lo, hi)], STATE)
    store.flush(batch("a", 0, 100), NOW)
    store.flush(batch("b", 50, 120), NOW)
    assert store.get("k060", NOW).first().value == "b" and store.get("k010", NOW).first().value == "a"
    assert store.compact(0, NOW) is None
    store.flush(spark.createDataFrame([("k060", None, NEVER, 1)], STATE), NOW)
    assert store.get("k060", NOW).count() == 0
    assert store.compact(0, NOW) == 4 and store.state(NOW).count() == 119
    m = store.manifest().collect()
    assert [(r.level, r.num_records, r.first_key, r.last_key) for r in m] == [(1, 119, "k000", "k119")]
    store.clean()
    assert store.get("k119", NOW).first().value == "b"


def test_snapshot(spark, state, tmp_path):
    path = f"file://{tmp_path}/snap"
    for _ in range(2):
        assert changelog.snapshot(state, path, NOW).first()["count"] == 3
    assert {r.key for r in changelog.restore(spark, path, NOW).collect()} == {"a", "d"}
    log = spark.createDataFrame([("a", "new", NEVER, 0, 5), ("z", "old", NOW - 5, 0, 6)], STATE + ", seq long")
    assert {r.key: r.value for r in changelog.restore_and_replay(spark, path, log, NOW).collect()} == {"a": "new", "d": "4"}


def test_freeze_and_blocks(spark):
    df = spark.createDataFrame([(f"key{i}", f"value{i}") for i in range(1, 5)], "key string, value string")
    size = scalar.entry_size(F.col("key"), F.col("value"), T.StringType())
    frozen = maintenance.freeze_batches(df, size, 100, ["key"], F.lit(0))
    assert [(r.batch, r.entry_bytes) for r in frozen.orderBy("key").collect()] == [(0, 42), (0, 42), (0, 42), (1, 42)]
    packed = maintenance.greedy_blocks(df.withColumn("run", F.lit(1)), F.lit(60), "run", ["key"], 100)
    assert sorted(r.block for r in packed.collect()) == [0, 1, 2, 3]


def test_eviction(spark):
    df = spark.createDataFrame([("a", 1), ("b", 3), ("c", 2), ("d", 3)], "key string, lat long")
    assert rows(maintenance.lru_plan(df, F.lit(10), 30).select("key", "bytes_ahead", "keep")) == {("b", 0, True), ("d", 10, True), ("c", 20, True), ("a", 30, False)}


@pytest.mark.parametrize("metric, a, b, want", [("cosine", (1, 2, 3), (1, 2, 3), 1), ("cosine", (1, 0), (0, 1), 0), ("cosine", (0, 0), (1, 1), 0), ("cosine", (1, 0), (-1, 0), -1), ("l2", (0, 0), (3, 4), -5), ("l2", (-1, -2), (1, 2), -(20**0.5)), ("dot", (1, 2, 3), (4, 5, 6), 32), ("dot", (-1, 0), (1, 0), -1)])
def test_metrics(spark, metric, a, b, want):
    assert abs(spark.range(1).select(V.METRICS[metric](V.vector_literal(a), V.vector_literal(b)).alias("s")).first().s - want) < 1e-9


@pytest.mark.parametrize("passes", [1, 3])
def test_knn(spark, monkeypatch, passes):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.5, 0.0])], "id long, vector array<float>")
    assert [r.id for r in vector.knn(v, [1, 0], 2, "dot").collect()] == [1, 3]
    monkeypatch.setattr(vector, "QUERY_BYTES", 48 // passes)
    for metric in V.METRICS:
        got = vector.batch_knn(v, v, 2, metric).collect()
        for q in ([1, [1.0, 0.0]], [3, [0.5, 0.0]]):
            want = [r.id for r in vector.knn(v, q[1], 2, metric).collect()]
            assert [r.id for r in sorted((r for r in got if r.query == q[0]), key=lambda r: r["rank"])] == want
    with pytest.raises(ValueError):
        vector.check_index(v.limit(0))
    with pytest.raises(ValueError):
        vector.check_index(v.unionByName(v))


def test_as_of_join(spark):
    left = spark.createDataFrame([("k", 5, "x"), ("k", 1, "y"), ("m", 5, "z")], "key string, ts long, a string")
    right = spark.createDataFrame([("k", 2, 20), ("k", 5, 50)], "key string, ts long, v long")
    assert {(r.a, r.asof_v) for r in reads.as_of_join(left, right, columns=["v"]).collect()} == {("x", 50), ("y", None), ("z", None)}


def test_settings():
    s = config.settings('[storage]\nengine = "lsm"\nbloom_rate = 3.0\nblock_bytes = -1\nexpiry_seconds = 9\n')
    assert (s.engine, s.bloom_rate, s.block_bytes, s.expiry_seconds) == ("LSM", 0.01, 65536, 9)
    assert scalar.gossip_fanout(9) == 3 and scalar.gossip_fanout(100) == 20
