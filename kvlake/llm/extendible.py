"""Sharding by extendible hashing.

A key's 60-bit hash is read from the left. A directory maps hash prefixes to shards: a bucket within
its byte limit is a shard, and only an oversized one splits on the next bit, so that shards follow
the data's weight. The histogram of prefixes is built for a few bits at a time over those rows alone
whose bucket is still too large; a round's table has at most 2^STEP rows for each open bucket.

Built-in functions only. Rows of one key share all bits, so a key (or a single row) beyond the limit
stays a shard of its own, marked ``oversized``: a limit can't be met by hashing then, and a writer
spreads such a shard over several files. Defined results:
* a null key hashes as the empty string; a null or empty text has 0 bytes; repeated rows share a shard
* empty table: no rows and an empty directory
* other columns are kept, whatever their names; an input's own shard, n_bytes, shard_bytes or oversized is replaced
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import free, own, written

BITS = 60
STEP = 12
ADDED = ("shard", "n_bytes", "shard_bytes", "oversized")


def hash_bits(key: Column) -> Column:
    """The first 60 bits of the key's MD5, a number from 0 to 2^60 - 1 that any SQL engine can find."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def directory(rows: DataFrame, limit: int) -> DataFrame:
    """``rows`` has _ext_hash and _ext_bytes. The shards: depth, prefix, bytes, n_rows, oversized."""
    spark = rows.sparkSession
    cells = rows.groupBy("_ext_hash").agg(F.sum("_ext_bytes").alias("b"), F.count(F.lit(1)).alias("n"))
    cells = written(cells, "ext-keys")
    done, open_, base = None, None, 0
    while base < BITS:
        top = min(BITS, base + STEP)
        here = cells if open_ is None else cells.join(open_, F.expr(f"shiftright(_ext_hash, {BITS - base})") == F.col("_open"), "left_semi")
        leaf = here.groupBy(F.shiftright("_ext_hash", BITS - top).alias("leaf")).agg(F.sum("b").alias("b"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("keys"))
        # every prefix of a leaf between base and top; from 0 in the first round, which may need no split
        depths = F.sequence(F.lit(base + (base > 0)), F.lit(top))
        tree = leaf.withColumn("depth", F.explode(depths)).groupBy("depth", F.expr(f"shiftright(leaf, {top} - depth)").alias("prefix")).agg(F.sum("b").alias("bytes"), F.sum("n").alias("n_rows"), F.sum("keys").alias("keys"))
        fits = (F.col("bytes") <= limit) | (F.col("keys") == 1)
        tree = written(tree.withColumn("fits", fits), "ext-tree")
        # a shard is a prefix that fits below one that doesn't
        above = tree.filter(~F.col("fits")).select((F.col("depth") + 1).alias("_d"), F.col("prefix").alias("_p"))
        start = tree.filter(F.col("fits") & (F.col("depth") == base + (base > 0)))
        below = tree.filter("fits").join(above, (F.col("depth") == F.col("_d")) & (F.shiftright("prefix", 1) == F.col("_p")), "left_semi").filter(F.col("depth") > base + (base > 0))
        found = start.unionByName(below).select("depth", "prefix", "bytes", "n_rows", (F.col("bytes") > limit).alias("oversized"))
        done = found if done is None else done.unionByName(found)
        open_ = tree.filter((F.col("depth") == top) & ~F.col("fits")).select(F.col("prefix").alias("_open"))
        if open_.isEmpty():
            break
        base = top
    return written(done, "ext-directory")


def _placed(rows: DataFrame, limit: int) -> DataFrame:
    """``rows`` has _ext_hash and _ext_bytes. For each hash its shard, the shard's bytes and whether it is oversized.

    A shard's prefix has some depth d, and no other shard lies on the path to it: looking a hash up at
    each depth that the directory has finds one shard. Only the distinct hashes are repeated for the
    depths in use, which differ by few bits; the rows themselves meet the result once.
    """
    plan = directory(rows, limit)
    depths = plan.agg(F.sort_array(F.collect_set("depth")).alias("d")).first()["d"]
    plan = plan.select(F.col("depth").alias("_ext_depth"), F.col("prefix").alias("_ext_prefix"), F.col("bytes").alias("shard_bytes"), "oversized")
    hashes = rows.select("_ext_hash").distinct().withColumn("_ext_depth", F.explode(F.array(*[F.lit(d) for d in depths]) if depths else F.array().cast("array<int>")))
    hashes = hashes.withColumn("_ext_prefix", F.expr(f"shiftright(_ext_hash, {BITS} - _ext_depth)")).join(plan, ["_ext_depth", "_ext_prefix"])
    name = F.expr(f"substring(lpad(bin(_ext_hash), {BITS}, '0'), 1, _ext_depth)")
    return written(hashes.select("_ext_hash", name.alias("shard"), "shard_bytes", "oversized"), "ext-placed")


def shards(df: DataFrame, *, key_col: str = "doc_id", text_col: str = "text", limit: int = 8 << 20) -> DataFrame:
    """The rows with shard (the prefix's bits as text, empty for the root), n_bytes, shard_bytes and oversized."""
    hash_, size = hash_bits(F.col(key_col)), F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long")
    placed = _placed(df.select(hash_.alias("_ext_hash"), size.alias("_ext_bytes")), limit)
    at, n = free(df, "_hash", "_bytes")
    rows = df.withColumn(at, hash_).withColumn(n, size)
    found = rows.join(placed.select(F.struct("shard", "shard_bytes", "oversized").alias("_ext"), F.col("_ext_hash").alias("_ext_at")), F.col(at) == F.col("_ext_at"))
    return found.select(*own(df, *ADDED), F.col("_ext.shard").alias("shard"), F.col(n).alias("n_bytes"), F.col("_ext.shard_bytes").alias("shard_bytes"), F.col("_ext.oversized").alias("oversized"))


def write_shards(df: DataFrame, path: str, *, limit: int = 8 << 20, **how) -> None:
    """Writes a folder for each shard. The rows of a shard go to one task, whose bytes the limit bounds; those of an oversized shard go to as many tasks as it has limits, by the task that read them."""
    (part,) = free(df, "_part")
    placed = shards(df.withColumn(part, F.spark_partition_id()), limit=limit, **how)
    spread = F.when(F.col("oversized"), F.pmod(F.col(part), F.ceil(F.col("shard_bytes") / limit))).otherwise(F.lit(0)).cast("int")
    placed = placed.withColumn(part, spread)
    placed.repartition("shard", part).drop(part).write.partitionBy("shard").parquet(path)
