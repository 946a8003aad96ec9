"""Ordered work in ranges against plain loops, with many small ranges and with one."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from kvlake.operators import maintenance, ranges


@pytest.fixture(scope="module")
def sized():
    rng = random.Random(1)
    return [(r, k, rng.choice([1, 5, 20, 60, 99, 130])) for r in range(2) for k in range(120)] + [(9, 0, 500)]


@pytest.mark.parametrize("range_rows, limit", [(7, 100), (30, 1000), (1 << 18, 100)])
def test_greedy_packing(spark, sized, range_rows, limit):
    want = {}
    for run in {r for r, *_ in sized}:
        block = used = 0
        for _, k, s in sorted(x for x in sized if x[0] == run):
            full = used > 0 and used + s > limit
            block, used = block + full, s if full else used + s
            want[run, k] = block
    df = spark.createDataFrame(sized, "run long, k long, s long")
    assert {(r.run, r.k): r.block for r in ranges.packed(df, F.col("s"), "run", ["k"], limit, range_rows).collect()} == want


def test_sums_ahead(spark, sized):
    df = spark.createDataFrame([*sized, (None, 1, 4), (None, 2, 5)], "run long, k long, s long")
    got = {(r.run, r.k): r._ahead for r in ranges.bytes_ahead(df, "s", ["k"], ["run"], 20).collect()}
    assert got == {(r, k): sum(s for a, b, s in sized if a == r and b < k) for r, k, _ in sized} | {(None, 1): 0, (None, 2): 4}


def test_blocks_of_keys(spark, monkeypatch):
    monkeypatch.setattr(ranges, "RANGE_ROWS", 60)
    index = spark.createDataFrame([(i, i * 10, i * 10 + 5) for i in range(50)], "block long, first_key long, last_key long")
    keys = spark.createDataFrame([(i,) for i in range(-5, 520)], "key long")
    found = maintenance.find_blocks(index, keys)
    assert {(r.key, r.block) for r in found.collect()} == {(k, k // 10) for k in range(500) if k % 10 <= 5}
    assert "NestedLoop" not in found._jdf.queryExecution().toString()


def test_meeting_intervals(spark, monkeypatch):
    monkeypatch.setattr(ranges, "RANGE_ROWS", 60)
    rng = random.Random(2)
    runs = [(i, lo := rng.randint(0, 300), lo + rng.choice([0, 3, 40, 200])) for i in range(150)]
    df = spark.createDataFrame(runs, "run_id long, first_key long, last_key long")
    assert sorted(map(tuple, maintenance.overlapping(df, df).collect())) == sorted((a[0], b[0]) for a in runs for b in runs if a[2] >= b[1] and b[2] >= a[1])


@pytest.mark.parametrize("bin_rows", [3, 1024])
def test_meeting_two_sides(spark, bin_rows):
    rng = random.Random(3)
    side = lambda n: [(i % 50, lo := rng.randint(0, 60), lo + rng.choice([0, 0, 2, 30])) for i in range(n)]
    a, b = side(80), side(60)
    kind = "id long, lo long, hi long"
    one, other = spark.createDataFrame([*a, (99, None, 5), (98, 5, None)], kind), spark.createDataFrame(b, kind)
    assert sorted(map(tuple, ranges.meeting(one, other, bin_rows).collect())) == sorted((x[0], y[0]) for x in a for y in b if x[2] >= y[1] and y[2] >= x[1])
    assert ranges.meeting(one, spark.createDataFrame([], kind), bin_rows).collect() == []


def test_meeting_makes_only_its_pairs(spark):
    """15,000 intervals that all meet: 225 million pairs. Work that grows with a power above theirs does not end in the time given."""
    n = 15_000
    df = spark.range(n).selectExpr("id", "id AS lo", f"id + {n} AS hi")
    stop = threading.Timer(120, spark.sparkContext.cancelAllJobs)
    stop.start()
    try:
        got = ranges.meeting(df, df).agg(F.count("*"), F.sum("a"), F.sum("b"), F.sum(F.col("a") * F.col("b"))).first()
    finally:
        stop.cancel()
    ids = n * (n - 1) // 2
    assert tuple(got) == (n * n, n * ids, n * ids, ids * ids)
