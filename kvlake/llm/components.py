"""Connected components of an edge table, by alternating large and small stars.

A round replaces each node's links by links to the least node it knows; rounds end when none changes
the table, after a number that grows with the logarithm of the longest chain. Every round is written to
the shared folder, so that a lost executor costs a round at most. Joins back to a hub's least neighbour
are plain equi-joins, which Spark can split where a hub is hot; no group is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import remove, scratch


def _state(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(big, small))")).first())


def components(edges: DataFrame) -> DataFrame:
    """``edges`` has u and v of type long. Returns node and root (its component's least node); roots and nodes without links have no row."""
    spark = edges.sparkSession
    first = edges.filter("u <> v").select(F.greatest("u", "v").alias("big"), F.least("u", "v").alias("small")).distinct()

    def put(df: DataFrame) -> tuple[DataFrame, str]:
        path = scratch(spark, "components")
        df.write.parquet(path)
        return spark.read.schema("big long, small long").parquet(path), path

    e, path = put(first)
    before = _state(e)
    while before[0]:
        both = e.select(F.col("big").alias("a"), F.col("small").alias("b")).unionByName(e.select(F.col("small").alias("a"), F.col("big").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("big"), F.col("m").alias("small")).distinct()
        least = large.groupBy("big").agg(F.min("small").alias("m"))
        moved = large.join(least, "big").filter("small > m").select(F.col("small").alias("big"), F.col("m").alias("small"))
        e, new = put(moved.unionByName(least.withColumnRenamed("m", "small")).distinct())
        now = _state(e)
        remove(spark, path)
        path = new
        if now == before:
            break
        before = now
    return e.select(F.col("big").alias("node"), F.col("small").alias("root"))
