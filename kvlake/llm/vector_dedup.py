"""Embedding near-duplicates by PCA-ordered tiled comparison.

Vectors are rotated onto the principal axes of the whole table, so that leading dimensions carry most
of every product. Within a label, rows are ordered by the leading coordinate and cut into tiles of
bounded size; two tiles meet only where their coordinates are close enough for the threshold. A tile
pair adds up the leading dimensions first; what the remaining ones can add is at most the product of
the two suffix norms, so a pair stops as soon as that bound cannot reach the threshold. Survivors are
verified on the original components in double precision.

Equal vectors are one node with a count. A tile pair returns a count of links for each node and a
spanning forest, never its pairs. Defined results:
* a null label, a null, empty or zero vector, null or non-finite components: no links, a component of its own
* a null id: linked and counted like any other, but it names no component; a component of null ids alone has a null id and its rows are kept
* vectors of different lengths are never linked; repeated rows and repeated ids are all counted
* empty table: no rows; columns of the input beside the named ones are not touched
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import batches_of, written
from .simhash import _roots

THRESHOLD = 0.93
#: Rows of a tile.
TILE = 1536
#: Bins of the leading coordinate, over [-1, 1].
BINS = 4096
#: Dimensions after which the bound is looked at.
STEPS = (8, 16, 32)
#: Room for rounding where a pair is discarded unseen.
EPS = 1e-9


def _matrix(col: pa.Array) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    big = np.abs(x).max(1, keepdims=True)
    x = x / big
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def rotation(nodes: DataFrame, dim: int) -> np.ndarray:
    """The principal axes of the unit vectors of one length, leading first. Moments are added up in Spark: dim^2 numbers reach the driver."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for b in batches:
            if b.num_rows:
                u = _unit(_matrix(b.column(0)))
                total += u.T @ u
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim * dim)), pa.array(total.ravel())], ["i", "x"])

    rows = nodes.filter(F.col("dim") == dim).select("v").mapInArrow(moments, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
    m = np.zeros(dim * dim)
    for r in rows:
        m[r.i] = r.x
    m = m.reshape(dim, dim)
    return np.linalg.eigh((m + m.T) / 2)[1][:, ::-1].copy()


def compare(a: np.ndarray, b: np.ndarray, axes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows i of a and j of b whose cosine reaches the threshold."""
    ua, ub = _unit(a) @ axes, _unit(b) @ axes
    dim, steps = a.shape[1], [s for s in STEPS if s < a.shape[1]]
    tails = lambda u, s: np.sqrt(np.maximum((u[:, s:] ** 2).sum(1), 0))
    out_i, out_j = [], []
    for k in range(0, len(a), 512):
        x = ua[k : k + 512]
        part, done, i, j = np.zeros((len(x), len(b))), 0, None, None
        for s in steps:
            if i is None:
                part += x[:, done:s] @ ub[:, done:s].T
                alive = part + tails(x, s)[:, None] * tails(ub, s)[None, :] >= threshold - EPS
                if np.count_nonzero(alive) < alive.size / 16:
                    i, j = np.nonzero(alive)
                    rest = part[i, j]
            else:
                rest = rest + np.einsum("ij,ij->i", x[i, done:s], ub[j, done:s])
                alive = rest + tails(x, s)[i] * tails(ub, s)[j] >= threshold - EPS
                i, j, rest = i[alive], j[alive], rest[alive]
            done = s
        if i is None:
            part += x[:, done:dim] @ ub[:, done:dim].T
            i, j = np.nonzero(part >= threshold - EPS)
        for c in range(0, len(i), 1 << 16):
            p, q = i[c : c + (1 << 16)] + k, j[c : c + (1 << 16)]
            va, vb = a[p], b[q]
            sa, sb = np.abs(va).max(1), np.abs(vb).max(1)
            va, vb = va / sa[:, None], vb / sb[:, None]
            cos = np.einsum("ij,ij->i", va, vb) / np.sqrt(np.einsum("ij,ij->i", va, va) * np.einsum("ij,ij->i", vb, vb))
            ok = cos >= threshold
            out_i.append(p[ok])
            out_j.append(q[ok])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *out_i]), np.concatenate([none, *out_j])


def _tiles(nodes: DataFrame, reach: float) -> DataFrame:
    """Nodes with g, the tile pair, and side: 0 in the first tile, 1 in the second; a row for each pair of its tile."""
    group = ["label", "dim"]
    bins = nodes.groupBy(*group, "bin").agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy(*group).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    # a tile is the bins that begin within one TILE of rows; a bin that is larger alone is cut by hash
    bins = bins.withColumn("cut", F.floor(F.coalesce(F.sum("n").over(ahead), F.lit(0)) / TILE).cast("long")).withColumn("k", F.ceil(F.col("n") / TILE).cast("int"))
    bins = written(bins, "vector-bins")
    tiles = bins.withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).groupBy(*group, "cut", "sub").agg(F.min("bin").alias("lo"), F.max("bin").alias("hi"))
    one, two = tiles.alias("x"), tiles.alias("y")
    bins_apart = F.lit(int(reach * BINS / 2) + 2)
    first = (F.col("x.cut") < F.col("y.cut")) | ((F.col("x.cut") == F.col("y.cut")) & (F.col("x.sub") <= F.col("y.sub")))
    met = one.join(two, (F.col("x.label") == F.col("y.label")) & (F.col("x.dim") == F.col("y.dim")) & first & (F.col("y.lo") - F.col("x.hi") <= bins_apart))
    met = met.select(*[F.col(f"x.{c}").alias(c) for c in group], F.col("x.cut").alias("c0"), F.col("x.sub").alias("s0"), F.col("y.cut").alias("c1"), F.col("y.sub").alias("s1"))
    met = met.withColumn("g", F.xxhash64(*met.columns))
    sides = met.select(*group, F.col("c0").alias("cut"), F.col("s0").alias("sub"), "g", F.lit(0).alias("side")).unionByName(met.select(*group, F.col("c1").alias("cut"), F.col("s1").alias("sub"), "g", F.when((F.col("c0") == F.col("c1")) & (F.col("s0") == F.col("s1")), F.lit(2)).otherwise(F.lit(1)).alias("side")).filter("side = 1"))
    placed = nodes.join(bins.select(*group, "bin", "cut", "k"), [*group, "bin"]).withColumn("sub", F.pmod(F.xxhash64("node"), "k").cast("int"))
    return placed.join(sides, [*group, "cut", "sub"]).select("g", "side", "node", "n", "v")


def near_duplicates(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """id, n_links, component_id and kept for each row."""
    spark = vectors.sparkSession
    v = F.col(vector_col).cast("array<double>")
    fine = v.isNotNull() & F.col(label_col).isNotNull() & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False)) & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), v.alias("v"), F.coalesce(fine, F.lit(False)).alias("fine"))
    rows = written(rows, "vector-rows")
    nodes = rows.filter("fine").groupBy("label", "v").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
    nodes = written(nodes.select(F.monotonically_increasing_id().alias("node"), "label", F.size("v").alias("dim"), "v", "n", "least"), "vector-nodes")
    dims = nodes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    dim = dims[0].dim if dims else 1
    with batches_of(spark, 2048):
        axes = rotation(nodes, dim) if dims else np.eye(1)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # other lengths than the most frequent one are compared in the order that they have
        for t in batches:
            if not t.num_rows:
                continue
            lists = t.column("v")
            size = t.column("dim").to_numpy()
            lead = np.zeros(t.num_rows)
            for d in np.unique(size):
                at = np.flatnonzero(size == d)
                u = _unit(_matrix(lists.take(pa.array(at))))
                lead[at] = u @ axes[:, 0] if d == len(axes) else u[:, 0]
            bins = pa.array(np.floor((lead + 1) * (BINS / 2)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([t.column(c) for c in ("node", "label", "dim")] + [bins, t.column("n"), lists], ["node", "label", "dim", "bin", "n", "v"])

    with batches_of(spark, 2048):
        chosen = nodes.select("node", "label", "dim", "n", "v")
        placed = written(chosen.mapInArrow(binned, "node long, label string, dim int, bin int, n long, v array<double>"), "vector-placed")

    def linked(t: pa.Table) -> pa.Table:
        side = t.column("side").to_numpy()
        node, n, x = t.column("node").to_numpy(), t.column("n").to_numpy(), _matrix(t.column("v"))
        own = np.flatnonzero(side == 0)
        cross = np.flatnonzero(side == 1)
        within = not len(cross)
        turn = axes if x.shape[1] == len(axes) else np.eye(x.shape[1])
        i, j = compare(x[own], x[own if within else cross], turn, threshold)
        i, j = own[i], (own if within else cross)[j]
        if within:
            i, j = i[i < j], j[i < j]
        links = np.zeros(len(node), np.int64)
        np.add.at(links, i, n[j])
        np.add.at(links, j, n[i])
        lab = _roots(len(node), i, j)
        has = np.flatnonzero(links)
        return pa.table({"node": node[has], "links": links[has], "root": node[lab[has]]})

    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    tiles = _tiles(placed, reach)
    found = written(tiles.groupBy("g").applyInArrow(linked, "node long, links long, root long"), "vector-links")
    roots = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    counted = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).join(counted, "node", "left")
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    known = known.join(least, "root").select("label", "v", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id", F.lit(True).alias("fine"))
    # null where all ids of a component are null
    out = rows.join(known, ["label", "v", "fine"], "left")
    component = F.coalesce("component_id", F.when(~F.col("fine"), F.col("id")))
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
