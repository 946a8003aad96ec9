"""Ordered work without one task that holds it all: ranges, sums ahead, the last entry at or before a key, and greedy packing.

Rows are dealt out by range of their order and written with the range's number, so that every later
step sees the same ranges. A range is sorted on its own; what goes from range to range is one row
each, a few thousand at most, and only those are ordered together. Rows that are equal in every
column of the order stay in one range.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import scratch

#: Rows of a range on average.
RANGE_ROWS = 1 << 18
#: Pairs of intervals that a task makes on average.
TASK_PAIRS = 1 << 21


def ranged(rows: DataFrame, by: list[str], range_rows: int | None = None) -> DataFrame:
    """The rows with _range, which follows the order of ``by``; written to the shared folder."""
    spark = rows.sparkSession
    n = max(1, -(-rows.count() // (range_rows or RANGE_ROWS)))
    path = scratch(spark, "ranges")
    rows.repartitionByRange(n, *by).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    return spark.read.schema(rows.withColumn("_range", F.spark_partition_id()).schema).parquet(path)


def stored(rows: DataFrame) -> DataFrame:
    """The rows, written to the shared folder and read: for what several steps use."""
    path = scratch(rows.sparkSession, "stored")
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _joined(rows: DataFrame, small: DataFrame, on: list[str]) -> DataFrame:
    """An inner join in which nulls are equal; the columns of ``on`` once."""
    renamed = small.select(*[F.col(c).alias(f"_of_{c}") if c in on else F.col(c) for c in small.columns])
    same = F.lit(True)
    for c in on:
        same &= F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return rows.join(renamed, same).drop(*[f"_of_{c}" for c in on])


def bytes_ahead(rows: DataFrame, size: str, by: list[str], partition: list[str], range_rows: int | None = None) -> DataFrame:
    """Adds _ahead: the sum of ``size`` over the rows of the same partition that come before in the order."""
    rows = ranged(rows, [*partition, *by], range_rows)
    totals = rows.groupBy(*partition, "_range").agg(F.sum(size).alias("_sum"))
    earlier = Window.partitionBy(*partition).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
    inside = Window.partitionBy(*partition, "_range").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    both = rows.withColumn("_inside", F.coalesce(F.sum(size).over(inside), F.lit(0)))
    both = _joined(both, totals, [*partition, "_range"])
    return both.withColumn("_ahead", (F.col("_before") + F.col("_inside")).cast("long")).drop("_range", "_before", "_inside")


def last_at_or_before(entries: DataFrame, at: str, asked: DataFrame, key: str, range_rows: int | None = None) -> DataFrame:
    """``asked`` with entry: the row of ``entries`` with the greatest ``at`` that is not after ``key``, or null."""
    kind = entries.select(F.struct("*").alias("s")).schema["s"].dataType
    wanted = asked.select(F.struct("*").alias("s")).schema["s"].dataType
    e = entries.select(F.col(at).alias("_at"), F.lit(0).alias("_side"), F.struct("*").alias("entry"), F.lit(None).cast(wanted).alias("_row"))
    a = asked.select(F.col(key).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(kind).alias("entry"), F.struct("*").alias("_row"))
    both = ranged(e.unionByName(a), ["_at"], range_rows)
    tops = both.groupBy("_range").agg(F.max_by("entry", F.when(F.col("_side") == 0, F.col("_at"))).alias("_top"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.withColumn("_carried", F.last("_top", ignorenulls=True).over(earlier)).drop("_top")
    inside = Window.partitionBy("_range").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_own", F.last("entry", ignorenulls=True).over(inside)).filter("_side = 1").join(tops, "_range")
    return found.select("_row.*", F.coalesce("_own", "_carried").alias("entry"))


def _reached(x: DataFrame, y: DataFrame, ties: bool, bin_rows: int) -> DataFrame:
    """Pairs of an interval of x and one of y that begins in it: after its begin, or with ``ties`` also where it begins. x and y, the ids.

    In the order of begins, what an interval reaches is one span of y, which is cut where bins of y
    begin. Intervals that begin one after another are a row of tiles, one for each bin that they reach.
    Tasks are dealt whole tiles, and a tile makes ``bin_rows`` squared pairs at most.
    """
    begins = y.select(F.col("lo").alias("at"), F.lit(1).alias("turn"), F.lit(1).alias("_one"), F.lit(None).cast("long").alias("n"), F.lit(None).cast(x.schema["id"].dataType).alias("x"), F.col("id").alias("y"))
    ends = [x.select(F.col(c).alias("at"), F.lit(turn).alias("turn"), F.lit(0).alias("_one"), "n", F.col("id").alias("x"), F.lit(None).cast(y.schema["id"].dataType).alias("y")) for c, turn in (("lo", 0 if ties else 2), ("hi", 2))]
    placed = stored(bytes_ahead(begins.unionByName(ends[0]).unionByName(ends[1]), "_one", ["at", "turn"], []).select("turn", "n", "x", "y", "_ahead"))
    bins = placed.filter("turn = 1").groupBy(F.expr(f"_ahead div {bin_rows}").alias("bin"))
    bins = bins.agg(F.transform(F.array_sort(F.collect_list(F.struct("_ahead", "y"))), lambda p: p["y"]).alias("ids"))
    spans = placed.filter("turn <> 1").groupBy("n", "x").agg(F.min("_ahead").alias("start"), F.max("_ahead").alias("stop")).filter("stop > start")
    spans = stored(spans.withColumn("row", F.expr(f"n div {bin_rows}")))
    reached = F.explode(F.expr(f"sequence(start div {bin_rows}, (stop - 1) div {bin_rows})")).alias("bin")
    tiles = spans.groupBy("row").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).select("row", reached).join(bins, "bin")
    pairs = spans.agg(F.sum(F.expr("stop - start"))).first()[0] or 0
    pieces = spans.select("x", "start", "stop", "row", reached).repartition(max(1, -(-pairs // TASK_PAIRS)), "row", "bin")
    first = F.greatest(F.col("start") - F.col("bin") * bin_rows, F.lit(0))
    size = F.least(F.col("stop") - F.col("bin") * bin_rows, F.lit(bin_rows)) - first
    pieces = pieces.select("row", "bin", "x", (first + 1).cast("int").alias("first"), size.cast("int").alias("size"))
    return pieces.join(tiles.hint("shuffle_hash"), ["row", "bin"]).select("x", F.explode(F.slice("ids", F.col("first"), F.col("size"))).alias("y"))


def meeting(a: DataFrame, b: DataFrame, bin_rows: int = 1024) -> DataFrame:
    """Pairs of intervals that meet. Both sides have id, lo and hi; returns a and b, the ids.

    Of two that meet, the later begins in the other. So the pairs are those where b begins in a and,
    where they don't begin together, those where a begins in b; the work grows with the pairs found.
    Both sides are worked out once.
    """
    # n follows the order of begins
    side = lambda s: stored(s.filter("hi >= lo").orderBy("lo").withColumn("n", F.monotonically_increasing_id()))
    a, b = (side(a),) * 2 if a is b else (side(a), side(b))
    later = _reached(a, b, True, bin_rows).select(F.col("x").alias("a"), F.col("y").alias("b"))
    return later.unionByName(_reached(b, a, False, bin_rows).select(F.col("y").alias("a"), F.col("x").alias("b")))


def _following(sizes: np.ndarray, limit: int) -> np.ndarray:
    """Where the next block begins when one begins at each place; the number of rows where none does."""
    ends = np.cumsum(sizes)
    return np.maximum(np.searchsorted(ends, ends - sizes + limit, "right"), np.arange(len(sizes)) + 1)


def packed(rows: DataFrame, size: Column, run: str, by: list[str], limit: int, range_rows: int | None = None) -> DataFrame:
    """Blocks as a writer packs them: a record that doesn't fit opens the next block. run, the order's columns, block and bytes.

    Where blocks begin depends on all that came before, but a range needs to know of that only how full
    the open block is. So each range first says, for every place at which its first block can begin,
    how many blocks follow and how full the last one is: as many places as one block has records.
    Those lines are followed from range to range, and then each range packs its own rows.
    """
    narrow = rows.select(run, *by, size.cast("long").alias("bytes"))
    placed = ranged(narrow, [run, *by], range_rows)
    order = [(c, "ascending") for c in by]
    kind = placed.schema[run].dataType.simpleString()

    def said(t: pa.Table) -> pa.Table:
        s = t.sort_by(order).column("bytes").to_numpy()
        after, n = _following(s, limit), len(s)
        ends = np.cumsum(s)
        reach = min(n, int(np.searchsorted(ends, limit, "right")) + 1)
        blocks, used = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        for i in range(n - 1, -1, -1):
            j = after[i]
            blocks[i] = 1 + blocks[j]
            used[i] = used[j] if j < n else ends[-1] - ends[i] + s[i]
        lists = [pa.array([x[:reach]], pa.list_(pa.int64())) for x in (ends, blocks, used)]
        return pa.table({run: t.column(run)[:1], "_range": t.column("_range")[:1], "ends": lists[0], "blocks": lists[1], "used": lists[2], "total": pa.array([int(ends[-1])], pa.int64())})

    def followed(t: pa.Table) -> pa.Table:
        t = t.sort_by([("_range", "ascending")])
        block, open_, starts, at = 0, 0, [], []
        for k, (ends, blocks, used, total) in enumerate(zip(*[t.column(c).to_pylist() for c in ("ends", "blocks", "used", "total")], strict=True)):
            first = int(np.searchsorted(np.array(ends), limit - open_, "right")) if k else 0
            starts.append(block)
            if k and open_ + total <= limit:
                at.append(-1)
                open_ += total
                continue
            at.append(first)
            block += blocks[first] - (k == 0)
            open_ = used[first]
        return pa.table({run: t.column(run), "_range": t.column("_range"), "_block": pa.array(starts, pa.int64()), "_first": pa.array(at, pa.int64())})

    def laid(t: pa.Table) -> pa.Table:
        t = t.sort_by(order)
        s, block, first = t.column("bytes").to_numpy(), t.column("_block")[0].as_py(), t.column("_first")[0].as_py()
        begins = np.zeros(len(s), np.int64)
        if first >= 0:
            after, i = _following(s, limit), first
            while i < len(s):
                begins[i] = 1
                i = int(after[i])
        if first == 0 and t.column("_range")[0].as_py() == t.column("_lowest")[0].as_py():
            begins[0] = 0
        return pa.table({run: t.column(run), **{c: t.column(c) for c in by}, "block": pa.array(block + np.cumsum(begins)), "bytes": pa.array(s)})

    lines = placed.groupBy(run, "_range").applyInArrow(said, f"{run} {kind}, _range int, ends array<long>, blocks array<long>, used array<long>, total long")
    starts = lines.groupBy(run).applyInArrow(followed, f"{run} {kind}, _range int, _block long, _first long")
    starts = _joined(starts, lines.groupBy(run).agg(F.min("_range").alias("_lowest")), [run])
    named = ", ".join(f"{c} {placed.schema[c].dataType.simpleString()}" for c in by)
    return _joined(placed, starts, [run, "_range"]).groupBy(run, "_range").applyInArrow(laid, f"{run} {kind}, {named}, block long, bytes long")
