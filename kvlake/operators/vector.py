"""Exact nearest neighbours by cosine, negative Euclidean distance or dot product.

A vector table has a unique id and an array. One query is scored by built-in expressions and kept by
a top-k that never sorts the table. A batch of queries is scored in tiles in numpy: every task holds
the query matrix, whose size is checked, scores some queries against some vectors at a time and keeps
k rows a query, so that k rows a query and task reach the final top-k.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import METRICS, vector_literal

#: Bytes of query vectors that one pass carries to the tasks; more queries go in several passes.
QUERY_BYTES = 64 << 20
#: Queries and vectors of a tile of scores.
TILE_QUERIES, TILE_ROWS = 1024, 2048


def check_index(vectors: DataFrame, id_col: str = "id") -> None:
    """Refuses an empty index and repeated ids."""
    n = vectors.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(id_col).alias("d")).first()
    if n.n == 0:
        raise ValueError("the index is empty")
    if n.n != n.d:
        raise ValueError("repeated vector ids")


def knn(vectors: DataFrame, query: Sequence[float], k: int, metric: str = "cosine", *, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """id and score of the k closest; equal scores by id."""
    score = METRICS[metric](F.col(vector_col), vector_literal(query))
    return vectors.select(id_col, score.alias("score")).orderBy(F.desc("score"), id_col).limit(k)


def _scores(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    if metric == "l2":
        return -np.sqrt(np.maximum((q * q).sum(1)[:, None] - 2 * (q @ x.T) + (x * x).sum(1)[None, :], 0))
    s = q @ x.T
    if metric == "cosine":
        norms = np.sqrt((q * q).sum(1))[:, None] * np.sqrt((x * x).sum(1))[None, :]
        s = np.divide(s, norms, out=np.zeros_like(s), where=norms > 0)
    return s


def batch_knn(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", *, id_col: str = "id", vector_col: str = "vector", exclude_self: bool = False) -> DataFrame:
    """query, id, score and rank (from 1) of the k closest for each query row (same columns as ``vectors``, any number of rows)."""
    spark = vectors.sparkSession
    asked = queries.select(F.col(id_col).cast("long").alias("query"), F.col(vector_col).cast("array<double>").alias("v"))
    n, dim = asked.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    passes = max(1, -(-n * dim * 8 // QUERY_BYTES))
    out = None
    for p in range(passes):
        part = asked.filter(F.pmod(F.xxhash64("query"), F.lit(passes)) == p) if passes > 1 else asked
        rows = part.toArrow()
        q = np.array(rows.column("v").to_pylist(), np.float64).reshape(len(rows), dim)
        sent = spark.sparkContext.broadcast((rows.column("query").to_numpy(), q))

        def top(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names, q = sent.value
            best_id, best = np.zeros((len(q), k), np.int64), np.full((len(q), k), -np.inf)
            for b in batches:
                ids = b.column(0).to_numpy()
                for lo in range(0, len(ids), TILE_ROWS):
                    own = ids[lo : lo + TILE_ROWS]
                    x = b.column(1).slice(lo, TILE_ROWS).flatten().to_numpy().astype(np.float64).reshape(len(own), -1)
                    for at in range(0, len(q), TILE_QUERIES):
                        part = slice(at, at + TILE_QUERIES)
                        s = _scores(x, q[part], metric)
                        if exclude_self:
                            s[names[part, None] == own[None, :]] = -np.inf
                        s, i = np.concatenate([best[part], s], 1), np.concatenate([best_id[part], np.broadcast_to(own, s.shape)], 1)
                        order = np.lexsort((i, -s), axis=1)[:, :k]
                        best[part], best_id[part] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
            keep = np.isfinite(best)
            yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(names[:, None], best.shape)[keep]), pa.array(best_id[keep]), pa.array(best[keep])], ["query", "id", "score"])

        found = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).mapInArrow(top, "query long, id long, score double")
        out = found if out is None else out.unionByName(found)
    w = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def label_vote(neighbours: DataFrame, labels: DataFrame) -> DataFrame:
    """The most frequent label among each query's neighbours; equal counts by the smaller label. ``labels`` has id and label."""
    counts = neighbours.join(labels.select("id", "label"), "id").groupBy("query", "label").agg(F.count(F.lit(1)).alias("votes"))
    top = F.max_by(F.struct("label", "votes"), F.struct("votes", -F.col("label"))).alias("t")
    return counts.groupBy("query").agg(top).select("query", "t.label", "t.votes")
