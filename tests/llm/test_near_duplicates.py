"""SimHash and embedding near-duplicates against brute force."""

import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from kvlake.llm import queries, simhash, vector_dedup
from kvlake.llm.components import components


def least(n, pairs):
    at = list(range(n))

    def root(i):
        while at[i] != i:
            at[i] = at[at[i]]
            i = at[i]
        return i

    for i, j in pairs:
        a, b = root(i), root(j)
        at[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64)) if h else 0


def test_one_row_of_each_component(spark):
    """Also where ids repeat, are null, or columns have any name."""
    text = {"a": "one two three four five", "b": "six seven eight nine ten eleven", "c": "x y z"}
    for rows, want in (
        ([(1, "a"), (2, "a"), (3, "b")], [1, 3]),
        ([(1, "a"), (1, "a"), (1, "b"), (2, "b")], [1, 1]),
        ([(None, "a"), (5, "a"), (None, "b"), (None, "b"), (7, "c"), (7, "c")], [-1, 5, 7]),
        ([(None, "a"), (5, "a")], [5]),
    ):
        df = spark.createDataFrame([(i, text[t], "p", "q", "r") for i, t in rows], "doc_id long, text string, _id string, _kept string, _row string")
        out = simhash.one_of_each(df)
        assert out.columns == df.columns
        got = out.collect()
        assert sorted(-1 if r.doc_id is None else r.doc_id for r in got) == want and len({r.text for r in got}) == len(got)
        assert {(r._id, r._kept, r._row) for r in got} == {("p", "q", "r")}


def test_components(spark):
    rng = np.random.default_rng(1)
    pairs = [(i, i + 1) for i in range(300)] + [(400 + int(a), 400 + int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(5, 5)]
    want = least(800, pairs)
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {i: r for i, r in enumerate(want) if r != i}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def check_simhash(rows, texts):
    fps = [brute_fingerprint(t) for _, t in texts]
    x = np.array(fps, np.uint64)
    near = np.argwhere(np.bitwise_count(x[:, None] ^ x[None, :]) <= 3)
    comp = least(len(x), [(i, j) for i, j in near.tolist() if i < j])
    ids = [i for i, _ in texts]
    first = {}
    for i, c in zip(ids, comp, strict=True):
        if i is not None:
            first[c] = min(first.get(c, i), i)
    want = Counter((i, f"{f:016x}", first.get(c)) for i, f, c in zip(ids, fps, comp, strict=True))
    assert Counter(rows) == want


def test_simhash(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").toPandas()
    rows = [tuple(r) for r in queries.op6_simhash(spark, "/root/testdata/sf0.01").collect()]
    check_simhash(rows, list(zip(docs.doc_id, docs.text, strict=True)))


def test_simhash_odd_inputs(spark):
    texts = [(1, None), (2, ""), (3, "  \n"), (4, "One"), (5, "one"), (5, "one"), (6, "a b"), (None, "x y z w"), (None, "x y z w"), (8, "ÄÖ ä"), (9, "word " * 20000)]
    df = spark.createDataFrame([(i, t, "k") for i, t in texts], "doc_id long, text string, component_id string")
    found = simhash.near_duplicates(df)
    check_simhash([(r.id, f"{r.fp % 2**64:016x}", r.component_id) for r in found.collect()], texts)
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 4, 6, 8, 9]
    assert simhash.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("tile", [2048, 40])
def test_links_lose_nothing(spark, monkeypatch, tile):
    """Clusters and chains around a few fingerprints, also with buckets of many tiles."""
    monkeypatch.setattr(simhash, "TILE", tile)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**64, 40, dtype=np.uint64)
    fps = set(base.tolist())
    for b in base[:6].tolist():
        for _ in range(120):
            x = b
            for bit in rng.choice(64, rng.integers(1, 5), replace=False).tolist():
                x ^= 1 << bit
            fps.add(x)
    x = np.array(sorted(fps), np.uint64)
    near = np.argwhere(np.bitwise_count(x[:, None] ^ x[None, :]) <= 3)
    want = least(len(x), [(i, j) for i, j in near.tolist() if i < j])
    edges = simhash.links(spark.createDataFrame([(int(i),) for i in x.view(np.int64)], "fp long")).collect()
    at = {int(v): i for i, v in enumerate(x.view(np.int64))}
    assert least(len(x), [(at[e.u], at[e.v]) for e in edges]) == want


def brute_vectors(rows, threshold=0.93):
    """rows: (id, vector, label)."""
    def ok(i, v, lab):
        return lab is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)

    n, pairs, links = len(rows), [], Counter()
    for a in range(n):
        for b in range(a + 1, n):
            (i, v, p), (j, w, q) = rows[a], rows[b]
            if p == q and ok(i, v, p) and ok(j, w, q) and len(v) == len(w):
                x, y = np.array(v, float), np.array(w, float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                    pairs.append((a, b))
                    links[a] += 1
                    links[b] += 1
    comp, first = least(n, pairs), {}
    for c, (i, *_) in zip(comp, rows, strict=True):
        if i is not None:
            first[c] = min(first.get(c, i), i)
    return Counter((r[0], links[k], first.get(comp[k]), r[0] == first.get(comp[k])) for k, r in enumerate(rows))


@pytest.mark.parametrize("tile", [1536, 16])
def test_vectors(spark, monkeypatch, tile):
    monkeypatch.setattr(vector_dedup, "TILE", tile)
    rng = np.random.default_rng(5)
    rows = []
    for i in range(150):
        v = rng.normal(size=24)
        rows.append((i, v.astype(np.float32).tolist(), int(i % 3)))
        for _ in range(int(rng.integers(0, 3))):
            w = v + rng.normal(size=24) * rng.choice([0.0, 0.1, 0.3, 0.38, 0.4])
            rows.append((len(rows) + 1000, w.astype(np.float32).tolist(), int(i % 3)))
    v = [float(np.float32(x)) for x in rng.normal(size=24)]
    rows += [(2000 + i, v, 1) for i in range(60)] + [(3000, v, None), (None, v, 1), (None, [-x for x in v], 2), (None, None, 1), (3001, None, 1), (3002, [0.0] * 24, 1), (3003, [float("nan")] + v[1:], 1), (3004, v[:5], 1), (3005, v[:5], 1), (3006, [None] + v[1:], 1), (3007, [], 1), (3007, [], 1), (3008, [float("inf")] * 24, 2), (2000, v, 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, n_links string")
    got = Counter(tuple(r) for r in vector_dedup.near_duplicates(df).select("id", "n_links", "component_id", "kept").collect())
    assert got == brute_vectors(rows)


def test_vectors_empty(spark):
    assert vector_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
