"""Edited and cropped copies in a column of pictures, by local descriptors.

Equal pixels are one node from the start. A node's descriptors have keys in several Hamming tables; nodes
that share enough keys are candidates, and a geometric consensus decides. Two passes find the links:

* Rounds of meetings join what is large: each node meets one node of its bucket, the first in an order
  that changes from round to round, unless both are in one component by then. A key that thousands share,
  a common corner or a large group of copies, costs as many meetings as it has nodes.
* Then nodes are dealt into tiles and tile meets tile: every pair of two components that shares enough keys
  is compared, unless links found on the way already join it. A tile pair returns a spanning forest.
  Its work grows with the square of the nodes that share common keys, its exchange with nodes times tiles.

So no candidate goes uncompared; what is approximate is the index that makes candidates, whose recall is
measured against comparing all pairs. ``exact=True`` compares all pairs in the second pass, keys or not,
for tables whose square is affordable. Bounds of the comparison itself, all of them settings of
``pictures``: sides are reduced to MOST_SIDE, pictures above MOST_PIXELS count as not read, corners
are the strongest on each scale and as many as the picture's size allows, two pictures differ in scale
by 0.4 to 2.5, and fewer than AGREE corners link nothing. Defined results:
* media files in formats that decode() does not read (JPEG, GIF, WebP, 16-bit or interlaced PNG, sound, film) link where their bytes are equal
* null, empty or what does not begin like a media file: no link, a component of its own; pictures without enough corners link by equal pixels only
* repeated rows count alike; null ids stay and name no component, one of null ids alone is null
* empty table: no rows; columns of the input beside the named ones are not touched
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pictures
from .components import components
from .shared import batches_of, release, written

#: Pictures in an Arrow batch; keys that candidates share at least.
BATCH, VOTES = 64, 3
#: Rounds of meetings.
ROUNDS = 2
#: Nodes that a tile holds at most on average, tiles at least, and candidate votes that are counted at once.
TILE, TILES, EVENTS = 8192, 6, 1 << 20


def descriptors(media: DataFrame, *, id_col: str = "id", media_col: str = "media") -> DataFrame:
    """id, digest (of a media file that is not read, of its bytes; null for what is no media) and corners (packed) for each row."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column(1).to_pylist()
            seen = [pictures.decode(x) for x in raw]
            names = [pictures.file_digest(y) if x is None else pictures.digest(x) for x, y in zip(seen, raw, strict=True)]
            found: dict[int, tuple] = {}
            by_shape: dict[tuple, list[int]] = {}
            for k, x in enumerate(seen):
                if x is not None and min(x.shape):
                    by_shape.setdefault(x.shape, []).append(k)
            for at in by_shape.values():
                found |= dict(zip(at, pictures.describe(np.stack([seen[k] for k in at])), strict=True))
            packed = [pictures.pack(*found[k]) if k in found else b"" for k in range(len(seen))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.binary()), pa.array(packed, pa.binary())], ["id", "digest", "corners"])

    chosen = media.select(F.col(id_col).cast("long").alias("id"), F.col(media_col).cast("binary").alias("media"))
    with batches_of(media.sparkSession, BATCH):
        return written(chosen.mapInArrow(of, "id long, digest binary, corners binary"), "media-rows")


def _keyed(nodes: DataFrame) -> DataFrame:
    """``nodes`` has node, root and corners. A row (key, node, root) for each of a node's keys."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [pictures.keys(pictures.unpack(x)[1]) for x in b.column(2).to_pylist()]
            times = [len(k) for k in keys]
            flat = np.concatenate([np.zeros(0, np.int64), *keys])
            yield pa.RecordBatch.from_arrays([pa.array(flat), *[pa.array(np.repeat(b.column(c).to_numpy(), times)) for c in (0, 1)]], ["key", "node", "root"])

    return nodes.select("node", "root", "corners").mapInArrow(of, "key long, node long, root long")


def _verified(pairs: DataFrame, corners: DataFrame) -> DataFrame:
    """``pairs`` has u and v; those whose pictures agree."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [pictures.linked(x, y) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield b.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    left = corners.select(F.col("node").alias("u"), F.col("corners").alias("a"))
    right = corners.select(F.col("node").alias("v"), F.col("corners").alias("b"))
    return pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b").mapInArrow(of, "u long, v long")


def _rooted(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    roots = components(edges).withColumnRenamed("root", "_root")
    return nodes.join(roots, "node", "left").withColumn("root", F.coalesce("_root", "node")).drop("_root")


def _crowded(root: np.ndarray, corners: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys that nodes of two components have, and those nodes' positions, ordered by key and component. A part of the keys at a time, which bounds what is sorted at once."""
    keys = [pictures.keys(pictures.unpack(x)[1]) for x in corners]
    key, who = np.concatenate([np.zeros(0, np.int64), *keys]), np.repeat(np.arange(len(keys), dtype=np.int32), [len(k) for k in keys])
    del keys
    out = []
    for part in range(8):
        at = np.flatnonzero(key & 7 == part)
        at = at[np.lexsort((root[who[at]], key[at]))]
        k, w = key[at], who[at]
        if not len(k):
            continue
        first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        last = np.r_[first[1:], len(k)] - 1
        two = np.repeat(root[w[first]] != root[w[last]], last - first + 1)
        out.append((k[two], w[two]))
    return tuple(np.concatenate([np.zeros(0, t), *x]) for t, x in zip((np.int64, np.int32), zip(*out) if out else ((), ()), strict=True))


def _forest(tile: np.ndarray, root: np.ndarray, corners: list[bytes], exact: bool = False) -> list[tuple[int, int]]:
    """Positions of linked pairs that span what is linked between two tiles, or inside one where there is only one."""
    if exact:
        return _all_pairs(tile, root, corners)
    key, who = _crowded(root, corners)
    if not len(key):
        return []
    fresh = np.r_[True, key[1:] != key[:-1]]
    other = fresh | np.r_[True, root[who[1:]] != root[who[:-1]]]
    del key

    def ends(starts: np.ndarray) -> np.ndarray:
        first = np.flatnonzero(starts)
        return np.r_[first[1:], len(starts)][np.cumsum(starts) - 1]

    # an entry meets those of its bucket that stand after its own component
    first, n = ends(other), ends(fresh)
    n -= first
    at = np.argsort(who, kind="stable")
    at = at[n[at] > 0]
    total = np.cumsum(n[at])
    of_node = np.flatnonzero(np.r_[np.diff(who[at]) > 0, True]) + 1 if len(at) else at
    lab = list(range(len(corners)))

    def find(i: int) -> int:
        while lab[i] != i:
            lab[i] = i = lab[lab[i]]
        return i

    found, a, two = [], 0, tile.min() != tile.max()
    while a < len(at):
        # whole nodes only, since a pair's votes are counted together
        before = total[a - 1] if a else 0
        k = np.searchsorted(total[of_node - 1], before + EVENTS, "right")
        b = max(int(of_node[max(k - 1, 0)]), int(of_node[np.searchsorted(of_node, a, "right")]))
        part, times = at[a:b], n[at[a:b]]
        step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        u, v = np.repeat(who[part].astype(np.int64), times), who[np.repeat(first[part], times) + step]
        if two:
            apart = tile[u] != tile[v]
            u, v = u[apart], v[apart]
        pair, votes = np.unique(u * len(corners) + v, return_counts=True)
        for p in pair[votes >= VOTES].tolist():
            i, j = divmod(p, len(corners))
            x, y = find(i), find(j)
            if x != y and pictures.linked(corners[i], corners[j]):
                lab[max(x, y)] = min(x, y)
                found.append((i, j))
        a = b
    return found


def _all_pairs(tile: np.ndarray, root: np.ndarray, corners: list[bytes]) -> list[tuple[int, int]]:
    lab = {int(r): int(r) for r in np.unique(root)}
    out, first = [], tile == tile.min()
    ones = np.flatnonzero(first)
    others = np.flatnonzero(~first) if not first.all() else ones

    def find(r: int) -> int:
        while lab[r] != r:
            lab[r] = r = lab[lab[r]]
        return r

    for i in ones.tolist():
        for j in others.tolist():
            x, y = find(int(root[i])), find(int(root[j]))
            if x != y and pictures.linked(corners[i], corners[j]):
                lab[max(x, y)] = min(x, y)
                out.append((i, j))
    return out


def _rest(rooted: DataFrame, exact: bool = False) -> DataFrame:
    """``rooted`` has node, root and corners. Edges between components, of all pairs with enough keys in common."""
    k = max(TILES, -(-rooted.count() // TILE))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(rows)
            node, root, tile = (t.column(c).to_numpy() for c in ("node", "root", "t"))
            found = np.array(_forest(tile, root, t.column("corners").to_pylist(), exact), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(node[found[:, 0]]), pa.array(node[found[:, 1]])], ["u", "v"])

        held: list[pa.RecordBatch] = []
        for b in batches:
            g = b.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(g)) + 1).tolist(), len(g)]
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                if x == y:
                    continue
                if held and held[0].column(0)[0].as_py() != g[x]:
                    yield done(held)
                    held = []
                held.append(b.slice(x, y - x))
        if held:
            yield done(held)

    tiled = rooted.select("node", "root", "corners", F.pmod(F.xxhash64("node"), F.lit(k)).alias("t"))
    tiled = tiled.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    tiled = tiled.select((F.least("t", F.col("o").cast("long")) * k + F.greatest("t", F.col("o").cast("long"))).alias("g"), "t", "node", "root", "corners")
    return tiled.repartition("g").sortWithinPartitions("g").mapInArrow(of, "u long, v long")


def links(nodes: DataFrame, *, exact: bool = False) -> DataFrame:
    """``nodes`` has node and corners. Edges u, v of verified pairs, which span all that is linked among candidates."""
    spark = nodes.sparkSession
    rooted, edges = nodes.withColumn("root", F.col("node")), None
    for r in range(ROUNDS):
        keyed = _keyed(rooted)
        first = F.min(F.struct(F.xxhash64("node", F.lit(r)).alias("order"), "node", "root"))
        buckets = keyed.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b"), first.alias("first")).filter("a <> b")
        met = keyed.join(buckets.select("key", F.col("first.node").alias("other"), F.col("first.root").alias("other_root")), "key").filter("root <> other_root")
        votes = met.groupBy(F.least("node", "other").alias("u"), F.greatest("node", "other").alias("v")).agg(F.count(F.lit(1)).alias("n"))
        found = written(_verified(votes.filter(F.col("n") >= VOTES).select("u", "v"), nodes), "media-links")
        edges = found if edges is None else edges.unionByName(found)
        del keyed, first, buckets, met, votes, found
        release(spark)
        rooted = written(_rooted(nodes, edges), "media-rooted")
        release(spark)
    edges = edges.unionByName(written(_rest(rooted, exact), "media-links"))
    del rooted
    release(spark)
    return edges


def copies(media: DataFrame, *, id_col: str = "id", media_col: str = "media", exact: bool = False) -> DataFrame:
    """id, n_corners, component_id (the least id of the pictures that links reach) and kept for each row."""
    rows = descriptors(media, id_col=id_col, media_col=media_col)
    nodes = rows.filter(F.col("digest").isNotNull()).groupBy("digest").agg(F.min("id").alias("least"), F.any_value("corners").alias("corners"))
    nodes = written(nodes.select(F.monotonically_increasing_id().alias("node"), "*"), "media-nodes")
    release(media.sparkSession)
    roots = components(links(nodes.select("node", "corners"), exact=exact))
    known = written(nodes.select("node", "digest", "least").join(roots, "node", "left").select("digest", "least", F.coalesce("root", "node").alias("root")), "media-roots")
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = known.join(least, "root").select("digest", "component_id", F.lit(True).alias("_known"))
    out = rows.join(classes, "digest", "left")
    component = F.when(F.col("_known"), F.col("component_id")).otherwise(F.col("id"))
    n = (F.octet_length("corners") / pictures.PACKED).cast("int")
    return out.select("id", n.alias("n_corners"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
