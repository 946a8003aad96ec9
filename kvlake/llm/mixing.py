"""Mixing sources to target weights.

Every document gets a hash-random key. A source's rows are ordered by that key: the key's leading
bits name a range, ranges are sorted on their own, and a prefix sum over the ranges' totals turns
the sums within a range into sums over the source. A source's budget is then a cut in that order,
after as many whole passes as the budget holds. A hot source is as many ranges as it has rows to
fill them, so that no task sorts a whole source.

Rows that repeat id and text would share a key, and a hot one would fill a range; so the second and
later of them get keys from their number among their like, and lie anywhere in the order. Which of
them has which number is left open, as nothing tells them apart.

Built-in functions only. A source is one row of the table of targets, which one task orders by name.
Defined results:
* null source: a source of its own, after all others; null or empty text: size 0, taken 0
* repeated rows: each has a place of its own in the order; equal rows may swap, with equal results
* empty table: no rows; columns of the input beside the named ones are not touched, whatever their names
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import free, own, words_in, written

#: Rows that a range holds on average.
RANGE_ROWS = 32_768
#: Ranges of the smallest table.
LEAST_RANGES = 64


def source_targets(sizes: DataFrame, weights=(5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``sizes`` has source and source_size, a row for each source. Adds target.

    Sources by code point, null last, weigh ``weights`` in turn and divide ``share`` of all words. A
    target ends at ``most`` times its source's size and the excess goes to the others by weight. With
    the sources by (limit / weight), those up to some place are full and the others stand at one
    level; the level is where the words left over, spread on the weights left, pass no limit.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    table = F.array(*[F.lit(float(w)) for w in weights])
    t = sizes.withColumn("_rank", F.row_number().over(by_name))
    t = t.withColumn("_weight", F.element_at(table, ((F.col("_rank") - 1) % len(weights) + 1).cast("int")))
    t = t.withColumn("_limit", F.col("source_size") * F.lit(float(most))).withColumn("_full_at", F.col("_limit") / F.col("_weight"))
    up = Window.orderBy("_full_at", "_rank")
    before, after = up.rowsBetween(Window.unboundedPreceding, -1), up.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    t = t.withColumn("_left", F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("_limit").over(before), F.lit(0.0)))
    t = t.withColumn("_level", F.col("_left") / F.sum("_weight").over(after))
    t = t.withColumn("_at", F.min(F.when(F.col("_level") <= F.col("_full_at"), F.struct("_full_at", "_rank", "_level"))).over(whole)["_level"])
    target = F.when(F.col("_at").isNull(), F.col("_limit")).otherwise(F.least(F.col("_limit"), F.col("_at") * F.col("_weight")))
    return t.select("source", "source_size", target.alias("target"))


def random_key(id_col: str, text_col: str):
    """The first 64 bits of the MD5 of id and text, which any SQL engine can find."""
    both = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(both), 1, 16), 16, -10).cast("long")


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` is a written table with source, key, part (the number of the task that wrote the row) and row. Keys of repeated rows become those of their number.

    Only repeated rows take part: their number is how many of their like earlier tasks wrote, plus the
    place among those of their own task, so that no task sees all of a hot key's rows.
    """
    like = ["source", "key"]
    several = rows.groupBy(*like, "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy(*like).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    several = several.withColumn("ahead", F.coalesce(F.sum("n").over(earlier), F.lit(0))).withColumn("all", F.sum("n").over(Window.partitionBy(*like)))
    several = several.filter("all > 1").select(F.col("source").alias("_s"), F.col("key").alias("_k"), F.col("part").alias("_p"), "ahead")
    found = rows.join(several, F.col("source").eqNullSafe(F.col("_s")) & (F.col("key") == F.col("_k")) & (F.col("part") == F.col("_p")), "left")
    repeated = found.filter(F.col("ahead").isNotNull())
    place = F.row_number().over(Window.partitionBy(*like, "part").orderBy("row")) - 1
    repeated = repeated.withColumn("number", F.col("ahead") + place)
    repeated = repeated.withColumn("key", F.when(F.col("number") > 0, F.xxhash64("key", "number")).otherwise(F.col("key")))
    columns = rows.columns
    return found.filter(F.col("ahead").isNull()).select(*columns).unionByName(repeated.select(*columns))


def _order(key):
    """The key's order as an unsigned number, like that of the ranges."""
    return key.bitwiseXOR(F.lit(-(2**63)))


def prefix_sums(rows: DataFrame) -> DataFrame:
    """``rows`` has source, size and key, among others. Adds before: the words of its source's rows ahead of it by key; and _order."""
    n = rows.count()
    ranges = LEAST_RANGES
    while ranges * RANGE_ROWS < n:
        ranges *= 2
    rows = rows.withColumn("_range", F.shiftrightunsigned("key", 64 - (ranges.bit_length() - 1))).withColumn("_order", _order(F.col("key")))
    totals = rows.groupBy("source", "_range").agg(F.sum("size").alias("_words"))
    ahead = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col("source").alias("_source"), F.col("_range").alias("_r"), F.coalesce(F.sum("_words").over(ahead), F.lit(0)).alias("_ahead"))
    within = Window.partitionBy("source", "_range").orderBy("_order", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    both = rows.join(totals, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_range") == F.col("_r")))
    return both.withColumn("before", F.col("_ahead") + F.col("_inside")).drop("_source", "_r", "_range", "_ahead", "_inside")


def _sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), words_in(F.col(text_col)).alias("size"), random_key(id_col, text_col).alias("key"))
    return written(rows.withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()), "mix-sizes")


def _repeats(rows: DataFrame) -> bool:
    return not rows.groupBy("source", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()


def _taken(rows: DataFrame, weights, share: float, most: float) -> DataFrame:
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = source_targets(sizes, weights, share, most)
    goals = goals.withColumn("_budget", F.round("target").cast("long"))
    goals = goals.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("_budget") / F.greatest(F.col("source_size"), F.lit(1)))).otherwise(F.lit(0)).cast("long"))
    goals = goals.withColumn("rest", F.col("_budget") - F.col("epochs") * F.col("source_size")).withColumnRenamed("source", "_name").drop("_budget")
    keyed = _numbered(rows) if _repeats(rows) else rows
    found = prefix_sums(keyed.drop("part")).join(goals, F.col("source").eqNullSafe(F.col("_name"))).drop("_name")
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before")))
    return found.withColumn("taken", (F.col("epochs") * F.col("size") + part).cast("long"))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=(5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """A row for each document: id, source, size, key, source_size, target, before, epochs, rest, taken.

    ``epochs`` whole passes and the first ``rest`` words of one more make a source's budget, which is
    its target as a whole number. ``taken`` is exact: the document that the cut meets gives the words
    ahead of the cut.
    """
    return _taken(_sizes(docs, id_col, text_col, source_col), weights, share, most).drop("row")


def mixed_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=(5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The mix itself: whole documents with the input's columns, a row for each time that the mix takes one.

    The document that a cut meets is taken where half of its words or more are ahead of the cut. The
    cuts are a row for each source, so that the texts are joined where they are read and not dealt out.
    Where rows repeat, a key does not tell them apart: rows then get numbers, in a written copy, and
    how often each is taken is joined by number.
    """
    rows = _sizes(docs, id_col, text_col, source_col)
    inside = (F.col("before") + F.col("size") / 2 <= F.col("rest")) & (F.col("rest") > 0)
    name, epochs, cut, copies, copy = free(docs, "_name", "_epochs", "_cut", "_copies", "_copy")
    if _repeats(rows):
        number, wanted = free(docs, "_number", "_wanted")
        docs = written(docs.withColumn(number, F.monotonically_increasing_id()), "mix-numbered")
        rows = docs.select(F.col(number).alias("row"), F.col(number).alias("id"), F.shiftright(number, 33).cast("int").alias("part"), F.col(source_col).cast("string").alias("source"), words_in(F.col(text_col)).alias("size"), random_key(id_col, text_col).alias("key"))
        m = _taken(written(rows, "mix-sizes"), weights, share, most)
        times = (F.col("epochs") + F.when(inside, F.lit(1)).otherwise(F.lit(0))).cast("int")
        m = m.filter("size > 0").select(F.col("row").alias(wanted), times.alias(copies)).filter(F.col(copies) > 0)
        out = docs.join(m, F.col(number) == F.col(wanted))
        kept = own(docs, number)
    else:
        m = _taken(rows, weights, share, most)
        cuts = m.groupBy("source").agg(F.max("epochs").alias(epochs), F.max(F.when(inside, F.col("_order"))).alias(cut)).withColumnRenamed("source", name)
        cuts = written(cuts.coalesce(1), "mix-cuts")
        times = F.col(epochs) + F.when(_order(random_key(id_col, text_col)) <= F.col(cut), F.lit(1)).otherwise(F.lit(0))
        out = docs.join(cuts, F.col(source_col).cast("string").eqNullSafe(F.col(name)))
        out = out.withColumn(copies, F.when(words_in(F.col(text_col)) > 0, times).otherwise(F.lit(0)).cast("int")).filter(F.col(copies) > 0)
        kept = own(docs)
    return out.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*kept)
