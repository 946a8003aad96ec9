"""SimHash near-duplicates found through pivot distance tables.

Every distinct fingerprint gets its Hamming distances to many reference fingerprints (pivots). By the
triangle inequality two fingerprints at distance d differ by d at most in each coordinate, so a pair
whose largest coordinate difference passes the limit is discarded unseen; survivors are verified on
all 64 bits.

Which pairs to look at also comes from such tables: the bits form six blocks and each block has
pivots of its own. At most three differing bits leave three blocks untouched, whose distances then
agree in every coordinate, so one of the 20 tables keyed by three blocks' distances holds the pair
under one key (no link is lost), while unrelated fingerprints agree in about 32 bits' worth of
distances by chance alone.

A key with two fingerprints is a pair. Larger buckets are cut into tiles of bounded size and compared
tile against tile; a tile pair returns a spanning forest, never its pairs, and exact copies are one
fingerprint from the start. Defined results:
* null, empty or blank text: fingerprint 0, linked like any other
* fewer words than a shingle: the whole sequence is the one shingle; repeated rows are kept
* null ids: rows stay, and count for no component's least id; a component of null ids has a null id
* empty table: no rows; columns of the input beside the named ones are not touched, whatever their names
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import batches_of, free, lean, written

SHINGLE_WORDS = 3
SEED = 42
LIMIT = 3
#: Rows of a bucket that one tile holds.
TILE = 2048
#: Buckets up to this size are compared together, by shifts.
SMALL = 48
#: Texts are read in Arrow batches of so many rows.
BATCH = 512

_WIDTHS = (11, 11, 11, 11, 10, 10)
BLOCKS = tuple((sum(_WIDTHS[:i]), w) for i, w in enumerate(_WIDTHS))
TABLES = tuple(combinations(range(len(BLOCKS)), len(BLOCKS) - LIMIT))
#: Reference fingerprints: fixed pseudo-random 64-bit numbers.
PIVOTS = tuple(xxhash.xxh64_intdigest(b"pivot %d" % i, 0) for i in range(24))
#: So many of them serve within each block, and as many over all bits.
PER_BLOCK = 8
_signed = lambda x: x - 2**64 if x >= 2**63 else x


def fingerprint(text: str | None) -> int:
    """Of one text, as an unsigned number; words split at ASCII white space after A-Z became a-z."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, n = memoryview(b" ".join(words)), len(words)
    starts = np.zeros(n + 1, np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1, out=starts[1:])
    if n < SHINGLE_WORDS:
        h = np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        a, b = starts[: n - SHINGLE_WORDS + 1].tolist(), (starts[SHINGLE_WORDS:] - 1).tolist()
        digest = xxhash.xxh64_intdigest
        h = np.fromiter((digest(joined[i:j], SEED) for i, j in zip(a, b, strict=True)), np.uint64, len(a))
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 8192):
        ones += np.unpackbits(h[k : k + 8192].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and fp (the fingerprint as a signed long) for each row, written to the shared folder."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = pa.array([_signed(fingerprint(t.as_py())) for t in b.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), fps], ["id", "fp"])

    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    with batches_of(docs.sparkSession, BATCH):
        return written(chosen.mapInArrow(lean(of), "id long, fp long"), "simhash")


def _distance(fp, pivot: int, mask: int):
    return F.bit_count(fp.bitwiseXOR(F.lit(_signed(pivot))).bitwiseAND(F.lit(_signed(mask))))


def _block_key(fp, block: int):
    """The distances to a block's pivots, four bits each."""
    at, width = BLOCKS[block]
    mask = ((1 << width) - 1) << at
    key = F.lit(0).cast("long")
    for i, p in enumerate(PIVOTS[:PER_BLOCK]):
        key = key.bitwiseOR(F.shiftleft(_distance(fp, p, mask).cast("long"), 4 * i))
    return key


def coordinates(fps: np.ndarray) -> np.ndarray:
    """Distances of unsigned fingerprints to the pivots over all bits, a row for each pivot."""
    p = np.array(PIVOTS[PER_BLOCK : 2 * PER_BLOCK], np.uint64)
    return np.bitwise_count(fps[None, :] ^ p[:, None]).astype(np.int8)


def _roots(n: int, i: np.ndarray, j: np.ndarray, lab: np.ndarray | None = None) -> np.ndarray:
    """Least member of each of n nodes' components under the links (i, j)."""
    lab = np.arange(n) if lab is None else lab
    while len(i):
        a, b = lab[i], lab[j]
        off = a != b
        if not off.any():
            return lab
        i, j, a, b = i[off], j[off], a[off], b[off]
        m = np.minimum(a, b)
        np.minimum.at(lab, a, m)
        np.minimum.at(lab, b, m)
        while (nxt := lab[lab]).tobytes() != lab.tobytes():
            lab = nxt
    return lab


def _forest_small(group: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within the groups, which are runs of equal numbers of at most SMALL rows."""
    c, found_i, found_j = coordinates(fps), [], []
    at = np.arange(len(fps))
    for d in range(1, SMALL):
        at = at[at + d < len(fps)]
        at = at[group[at] == group[at + d]]
        if not len(at):
            break
        near = (np.abs(c[:, at] - c[:, at + d]) <= LIMIT).all(0)
        i = at[near]
        i = i[np.bitwise_count(fps[i] ^ fps[i + d]) <= LIMIT]
        found_i.append(i)
        found_j.append(i + d)
    if not found_i:
        return fps[:0], fps[:0]
    lab = _roots(len(fps), np.concatenate(found_i), np.concatenate(found_j))
    off = np.flatnonzero(lab != np.arange(len(fps)))
    return fps[off], fps[lab[off]]


def _forest_large(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within one group: by its first coordinate, a row meets those whose coordinate is within the limit."""
    fps = np.unique(fps)
    c = coordinates(fps)
    order = np.argsort(c[0], kind="stable")
    fps, c = fps[order], c[:, order]
    lab = np.arange(len(fps))
    for k in range(0, len(fps), 256):
        rows = np.arange(k, min(k + 256, len(fps)))
        cols = np.arange(k, np.searchsorted(c[0], c[0, rows[-1]] + LIMIT, "right"))
        near = np.ones((len(rows), len(cols)), bool)
        for x in c:
            near &= np.abs(x[rows][:, None] - x[cols][None, :]) <= LIMIT
        i, j = np.nonzero(near)
        i, j = rows[i], cols[j]
        ok = np.bitwise_count(fps[i] ^ fps[j]) <= LIMIT
        lab = _roots(len(fps), i[ok], j[ok], lab)
    off = np.flatnonzero(lab != np.arange(len(fps)))
    return fps[off], fps[lab[off]]


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition sorted by group: a group is whole before it is compared; at most two tiles wait."""

    def out(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (u, v)], ["u", "v"])

    def done(group: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        cut = np.flatnonzero(np.diff(group)) + 1
        starts, stops = np.r_[0, cut], np.r_[cut, len(group)]
        large = stops - starts > SMALL
        small = np.repeat(~large, stops - starts)
        if small.any():
            yield out(*_forest_small(group[small], fps[small]))
        for a, b in zip(starts[large], stops[large], strict=True):
            yield out(*_forest_large(fps[a:b]))

    held_g, held_f = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    for b in batches:
        g = np.concatenate([held_g, b.column(0).to_numpy(zero_copy_only=False)])
        f = np.concatenate([held_f, b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
        if not len(g):
            continue
        last = np.searchsorted(-(g != g[-1]).astype(np.int8), 0)  # where the last group begins
        if last:
            yield from done(g[:last], f[:last])
        held_g, held_f = g[last:], f[last:]
    if len(held_g):
        yield from done(held_g, held_f)


def links(fps: DataFrame) -> DataFrame:
    """``fps`` has distinct fp. Edges u, v that span every component of fingerprints within the limit."""
    keyed = fps.select("fp", *[_block_key(F.col("fp"), b).alias(f"b{b}") for b in range(len(BLOCKS))])
    tables = F.array(*[F.xxhash64(F.lit(i), *[F.col(f"b{b}") for b in t]) for i, t in enumerate(TABLES)])
    keyed = keyed.select("fp", F.explode(tables).alias("key"))
    buckets = written(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v")).filter("n > 1"), "simhash-buckets")
    near = F.lit(True)
    for p in PIVOTS[PER_BLOCK : 2 * PER_BLOCK]:
        near &= F.abs(_distance(F.col("u"), p, 2**64 - 1) - _distance(F.col("v"), p, 2**64 - 1)) <= LIMIT
    pairs = buckets.filter("n = 2").select("u", "v").distinct().filter(near).filter(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= LIMIT)
    crowded = keyed.join(buckets.filter("n > 2").select("key", "n"), "key")
    k = F.ceil(F.col("n") / TILE).cast("int")
    crowded = crowded.select("key", "fp", k.alias("k"), F.pmod(F.xxhash64("fp"), k).cast("int").alias("t"))
    other = F.explode(F.sequence(F.lit(0), F.col("k") - 1))
    tiles = crowded.select("key", "fp", "t", other.alias("o")).select(F.xxhash64("key", F.least("t", "o"), F.greatest("t", "o")).alias("g"), "fp")
    dealt = tiles.repartition("g").sortWithinPartitions("g")
    return pairs.unionByName(dealt.mapInArrow(lean(_forests), "u long, v long"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp and component_id (the least id of the rows that links reach) for each row."""
    rows = fingerprints(docs, id_col=id_col, text_col=text_col)
    distinct = rows.groupBy("fp").agg(F.min("id").alias("least"))
    roots = components(links(distinct.select("fp")))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = written(rooted, "simhash-roots")
    classes = rooted.select("fp", "root").join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return rows.join(classes, "fp").select("id", "fp", "component_id")


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Exactly one row of each component, columns as before: that of the least id, null ids last; of rows that share it any one.

    Where ids tell rows apart, the kept ids are looked up in the documents. Where one repeats, or two are
    null, rows get numbers first, in a written copy, and the numbers are looked up.
    """
    ids = docs.select(F.col(id_col).cast("long").alias("id"))
    if ids.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        found = near_duplicates(docs, id_col=id_col, text_col=text_col)
        keep = found.filter(F.col("id").eqNullSafe(F.col("component_id"))).select(F.col("id").alias("_kept"))
        return _kept(docs, keep, F.col(id_col).cast("long"))
    (row,) = free(docs, "_row")
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "simhash-numbered")
    found = near_duplicates(numbered, id_col=row, text_col=text_col)
    ids = numbered.select(F.col(row).alias("id"), F.col(id_col).cast("long").alias("_own"))
    least = found.join(ids, "id").groupBy("component_id").agg(F.min(F.struct(F.col("_own").isNull(), "_own", "id"))["id"].alias("_kept"))
    return _kept(numbered, least.select("_kept"), F.col(row)).drop(row)


def _kept(docs: DataFrame, keep: DataFrame, by) -> DataFrame:
    """The documents whose ``by`` is in ``keep``, a table of _kept."""
    (name,) = free(docs, "_kept")
    keep = keep.withColumnRenamed("_kept", name)
    return docs.join(keep.hint("shuffle_hash"), by.eqNullSafe(F.col(name)), "left_semi")
