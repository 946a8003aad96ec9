"""Bitsets and Bloom filters as tables of 64-bit words: (word, bits), a row for each word that has a bit.

A union is ``bit_or`` over stacked tables, which combines before the shuffle; membership is a join
by word, so a filter may be larger than any machine's memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.murmur import murmur_hash

# The seeds of a filter's hash functions, the first primes.
SEEDS = (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41, 43, 47, 53)


def bitset(rows: DataFrame, position: Column, group: list[str] = ()) -> DataFrame:
    """The words of the positions (from 0) in each group."""
    bit = F.expr("shiftleft(1L, cast(_p % 64 as int))")
    placed = rows.select(*group, position.cast("long").alias("_p")).select(*group, F.floor(F.col("_p") / 64).cast("long").alias("word"), bit.alias("bit"))
    return placed.groupBy(*group, "word").agg(F.bit_or("bit").alias("bits"))


def checked(positions: DataFrame, size: int, position: str = "position") -> DataFrame:
    """The same rows; raises where a position is outside a set of ``size`` bits."""
    wrong = positions.filter((F.col(position) < 0) | (F.col(position) >= size)).limit(1).collect()
    if wrong:
        raise ValueError(f"position {wrong[0][position]} is outside 0..{size - 1}")
    return positions


def serialized(bits: DataFrame, group: list[str] = ()) -> DataFrame:
    """One binary value for each group: 16 bytes for each word that has a bit, its number and its bits. For sets that fit a row."""
    words = F.array_sort(F.collect_list(F.struct("word", "bits")))
    text = F.array_join(F.transform(words, lambda w: F.concat(F.lpad(F.hex(w["word"]), 16, "0"), F.lpad(F.hex(w["bits"]), 16, "0"))), "")
    return bits.groupBy(*group).agg(F.unhex(text).alias("data"))


def deserialized(data: DataFrame, group: list[str] = ()) -> DataFrame:
    number = lambda at: F.conv(F.hex(F.substring("data", at, F.lit(8))), 16, -10).cast("long")
    each = data.filter(F.octet_length("data") > 0).select(*group, "data", F.explode(F.expr("sequence(0, octet_length(data) div 16 - 1)")).alias("_k"))
    return each.select(*group, number(F.col("_k") * 16 + 1).alias("word"), number(F.col("_k") * 16 + 9).alias("bits"))


def memory(size: int) -> int:
    """Bytes of a set of so many bits."""
    return -(-size // 64) * 8


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    keys = [c for c in a.columns if c != "bits"]
    return a.unionByName(b).groupBy(*keys).agg(F.bit_or("bits").alias("bits"))


def toggled(a: DataFrame, b: DataFrame) -> DataFrame:
    keys = [c for c in a.columns if c != "bits"]
    return a.unionByName(b).groupBy(*keys).agg(F.bit_xor("bits").alias("bits")).filter("bits <> 0")


def cleared(a: DataFrame, b: DataFrame) -> DataFrame:
    """a without the bits of b."""
    keys = [c for c in a.columns if c != "bits"]
    return a.join(b.withColumnRenamed("bits", "_off"), keys, "left").withColumn("bits", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("_off", F.lit(0).cast("long"))))).drop("_off").filter("bits <> 0")


def is_set(bits: DataFrame, positions: DataFrame) -> DataFrame:
    """``positions`` has position; adds is_set."""
    asked = positions.withColumn("word", F.floor(F.col("position") / 64).cast("long"))
    one = F.expr("shiftright(bits, cast(position % 64 as int)) & 1L")
    return asked.join(bits, "word", "left").withColumn("is_set", F.coalesce(one == 1, F.lit(False))).drop("word", "bits")


def summary(bits: DataFrame, size: int, group: list[str] = ()) -> DataFrame:
    n = F.coalesce(F.sum(F.bit_count("bits")), F.lit(0)).cast("long")
    return bits.groupBy(*group).agg(n.alias("n_set")).withColumn("all_set", F.col("n_set") == size).withColumn("any_set", F.col("n_set") > 0).withColumn("none_set", F.col("n_set") == 0)


def rendered(bits: Column) -> Column:
    """A word's 64 bits as text, bit 0 first."""
    return F.reverse(F.lpad(F.bin(bits), 64, "0"))


def bloom_positions(key: Column, size: int, hashes: int, hash_of=murmur_hash) -> Column:
    """Where a key's bits are; ``hash_of(key, seed)`` gives 64 bits, read as unsigned."""
    def place(seed: int) -> Column:
        h = hash_of(key, seed)
        # unsigned remainder: the high bit is worth 2^63 mod size
        return F.pmod(F.pmod(h.bitwiseAND(F.lit(2**63 - 1)), F.lit(size)) + F.when(h < 0, F.lit(2**63 % size)).otherwise(F.lit(0)), F.lit(size)).cast("long")

    return F.array(*[place(SEEDS[i % hashes]) for i in range(hashes)])


def bloom_build(keys: DataFrame, size: int, hashes: int, hash_of=murmur_hash) -> DataFrame:
    spread = keys.select(F.explode(bloom_positions(F.col("key"), size, hashes, hash_of)).alias("_p"))
    return bitset(spread, F.col("_p"))


def bloom_probe(bits: DataFrame, keys: DataFrame, size: int, hashes: int, hash_of=murmur_hash) -> DataFrame:
    """The distinct keys with maybe: false only for keys that were never added."""
    asked = keys.select("key").distinct().withColumn("position", F.explode(bloom_positions(F.col("key"), size, hashes, hash_of)))
    return is_set(bits, asked).groupBy("key").agg(F.every("is_set").alias("maybe"))
