"""Approximate nearest neighbours: navigable small-world graphs, one for each shard of the vectors.

Vectors are dealt out by a hash of their id into shards of bounded size, and a task links its shard's
vectors: each has a level drawn from its id, and on every level up to it links to the closest of those
that a search of that level finds. The index is a table with a row for each shard, so that it is kept,
read and lost like any other. A search asks every shard, from its entry point down the levels, and the
best of all shards' answers are ranked together. Recall is measured against ``vector.batch_knn``.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import METRICS
from .vector import QUERY_BYTES, check_index

#: Vectors of a shard on average.
SHARD_ROWS = 20_000
#: Links of a vector on a level, twice as many on the lowest; candidates that are kept when one is linked, and by a search.
LINKS, LINK_WIDTH, WIDTH = 16, 48, 96

INDEX = "shard int, dim int, ids array<long>, vectors array<float>, levels array<int>, source array<int>, target array<int>, level array<int>"


def level_of(i: int) -> int:
    """Levels above the lowest; each holds one in e of the one below."""
    h = (i * 0x9E3779B97F4A7C15 + 0xD1B54A32D192ED03) & (1 << 64) - 1
    h = ((h ^ h >> 29) * 0xBF58476D1CE4E5B9) & (1 << 64) - 1
    return int(-math.log(((h ^ h >> 32) + 1) / 2.0**64))


class Graph:
    """Vectors are held so that every metric is a dot product: of unit length for the cosine, with half the squared length taken off for the distance."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, levels: np.ndarray, metric: str):
        self.ids, self.levels, self.metric = ids, levels, metric
        self.x, self.off = self.held(x), None
        if metric == "l2":
            self.off = (self.x * self.x).sum(1) / 2
        self.links: list[dict[int, list[int]]] = [{} for _ in range(int(levels.max(initial=0)) + 1)]
        self.entry = -1

    def held(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        if self.metric == "cosine":
            x = x / np.maximum(np.sqrt((x * x).sum(-1, keepdims=True)), 1e-300)
        return x

    def near(self, q: np.ndarray, at: list[int]) -> np.ndarray:
        s = self.x[at] @ q
        return s if self.off is None else s - self.off[at]

    def score(self, q: np.ndarray, near: float) -> float:
        """The metric's own value."""
        return near if self.metric != "l2" else -math.sqrt(max(0.0, float(q @ q) - 2 * near))

    def explore(self, q: np.ndarray, begin: list[int], level: int, width: int) -> list[tuple[float, int]]:
        """The closest that are reached from ``begin`` on a level, best first: while something unseen can still improve the ``width`` kept."""
        links, seen = self.links[level], set(begin)
        kept = list(zip(self.near(q, begin).tolist(), begin, strict=True))
        ahead = [(-s, n) for s, n in kept]
        heapq.heapify(kept)
        heapq.heapify(ahead)
        while ahead:
            s, n = heapq.heappop(ahead)
            if -s < kept[0][0] and len(kept) >= width:
                break
            new = [t for t in links.get(n, ()) if t not in seen]
            if not new:
                continue
            seen.update(new)
            for score, t in zip(self.near(q, new).tolist(), new, strict=True):
                if len(kept) < width or score > kept[0][0]:
                    heapq.heappush(ahead, (-score, t))
                    heapq.heappush(kept, (score, t))
                    if len(kept) > width:
                        heapq.heappop(kept)
        return sorted(kept, key=lambda p: (-p[0], p[1]))

    def descend(self, q: np.ndarray, down_to: int) -> list[int]:
        at = [self.entry]
        for level in range(int(self.levels[self.entry]), down_to, -1):
            at = [self.explore(q, at, level, 1)[0][1]]
        return at

    def insert(self, n: int) -> None:
        top = int(self.levels[n])
        if self.entry >= 0:
            q, old = self.x[n], int(self.levels[self.entry])
            at = self.descend(q, top)
            for level in range(min(top, old), -1, -1):
                found = self.explore(q, at, level, LINK_WIDTH)
                most = LINKS * (1 + (level == 0))
                chosen = self.spread(found, LINKS)
                self.links[level][n] = chosen
                for t in chosen:
                    back = self.links[level].setdefault(t, [])
                    back.append(n)
                    if len(back) > 2 * most:
                        scores = self.near(self.x[t], back).tolist()
                        self.links[level][t] = self.spread(sorted(zip(scores, back, strict=True), key=lambda p: (-p[0], p[1])), most)
                at = [t for _, t in found]
        if self.entry < 0 or top > self.levels[self.entry]:
            self.entry = n

    def spread(self, found: list[tuple[float, int]], most: int) -> list[int]:
        """Of candidates, the best first, those that are closer to the vector than to any chosen before; then the others."""
        at = [t for _, t in found]
        between = self.x[at] @ self.x[at].T
        if self.off is not None:
            between = between - self.off[at][None, :]
        chosen: list[int] = []
        later: list[int] = []
        for k, (score, _) in enumerate(found):
            if len(chosen) >= most:
                break
            (later if chosen and between[k, chosen].max() > score else chosen).append(k)
        return [at[k] for k in chosen + later[: most - len(chosen)]]

    def search(self, q: np.ndarray, k: int, width: int) -> list[tuple[float, int]]:
        q = self.held(q)
        return [(self.score(q, s), t) for s, t in self.explore(q, self.descend(q, 0), 0, max(k, width))[:k]]


def build(vectors: DataFrame, metric: str = "cosine", *, id_col: str = "id", vector_col: str = "vector", shard_rows: int | None = None) -> DataFrame:
    """The index of a table of unique ids and vectors of one length. Raises on an empty table and on repeated ids."""
    if metric not in METRICS:
        raise ValueError(f"no metric {metric}")
    check_index(vectors, id_col)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("v"))
    shards = max(1, -(-rows.count() // (shard_rows or SHARD_ROWS)))

    def linked(t: pa.Table) -> pa.Table:
        t = t.sort_by([("id", "ascending")])
        ids = t.column("id").to_numpy()
        x = t.column("v").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        levels = np.array([level_of(i) for i in ids.tolist()], np.int32)
        g = Graph(ids, x, levels, metric)
        for n in range(len(ids)):
            g.insert(n)
        edges = np.array([(s, e, level) for level, links in enumerate(g.links) for s, ends in links.items() for e in ends], np.int32).reshape(-1, 3)
        listed = lambda a, kind: pa.array([a], pa.list_(kind))
        return pa.table({"shard": t.column("shard")[:1], "dim": pa.array([x.shape[1]], pa.int32()), "ids": listed(ids, pa.int64()), "vectors": listed(x.ravel(), pa.float32()), "levels": listed(levels, pa.int32()), **{c: listed(edges[:, k], pa.int32()) for k, c in enumerate(("source", "target", "level"))}})

    return rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")).groupBy("shard").applyInArrow(linked, INDEX)


def search(index: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", *, id_col: str = "id", vector_col: str = "vector", width: int = WIDTH, exclude_self: bool = False) -> DataFrame:
    """query, id, score and rank (from 1) of about the k closest of each query row. The index has to be one of the same metric."""
    spark = index.sparkSession
    asked = queries.select(F.col(id_col).cast("long").alias("query"), F.col(vector_col).cast("array<double>").alias("v"))
    n, dim = asked.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    passes = max(1, -(-n * dim * 8 // QUERY_BYTES))
    out = None
    for p in range(passes):
        rows = (asked.filter(F.pmod(F.xxhash64("query"), F.lit(passes)) == p) if passes > 1 else asked).toArrow()
        sent = spark.sparkContext.broadcast((rows.column("query").to_numpy(), np.array(rows.column("v").to_pylist(), np.float64).reshape(len(rows), dim)))

        def found(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names, q = sent.value
            for b in batches:
                for row in b.to_pylist():
                    ids = np.array(row["ids"], np.int64)
                    g = Graph(ids, np.array(row["vectors"], np.float32).reshape(len(ids), -1), np.array(row["levels"]), metric)
                    g.entry = int(g.levels.argmax())
                    for s, e, level in zip(row["source"], row["target"], row["level"], strict=True):
                        g.links[level].setdefault(s, []).append(e)
                    hits = [(name, int(ids[t]), score) for name, v in zip(names.tolist(), q, strict=True) for score, t in g.search(v, k + exclude_self, width) if not (exclude_self and ids[t] == name)]
                    cells = list(zip(*hits, strict=True)) or [(), (), ()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query", "id", "score"])

        part = index.mapInArrow(found, "query long, id long, score double")
        out = part if out is None else out.unionByName(part)
    w = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
