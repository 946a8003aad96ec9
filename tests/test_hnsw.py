"""The graph index: recall against exact neighbours, exactness on few vectors, and refusals."""

import numpy as np
import pytest

from kvlake.operators import hnsw, vector


def table(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, vector array<float>")


@pytest.mark.parametrize("metric, shard_rows", [("cosine", 400), ("l2", 5000), ("dot", 5000)])
def test_recall(spark, metric, shard_rows):
    x = np.random.default_rng(7).normal(size=(800, 24)).astype(np.float32)
    v = table(spark, x).cache()
    index = hnsw.build(v, metric, shard_rows=shard_rows).cache()
    asked = v.filter("id % 50 = 0")
    pairs = lambda df: {(r.query, r.id) for r in df.collect()}
    want = pairs(vector.batch_knn(v, asked, 10, metric, exclude_self=True))
    got = pairs(hnsw.search(index, asked, 10, metric, exclude_self=True))
    assert len(got & want) / len(want) >= 0.95 and len(got) == len(want)
    exact = {(r.query, r.id): r.score for r in vector.batch_knn(v, asked, 10, metric, exclude_self=True).collect()}
    assert all(abs(exact.get((r.query, r.id), r.score) - r.score) < 1e-5 for r in hnsw.search(index, asked, 10, metric, exclude_self=True).collect())


def test_few_vectors_are_exact(spark):
    v = table(spark, [[1, 0], [0, 1], [1, 1], [-1, 0]])
    got = hnsw.search(hnsw.build(v), v, 2).collect()
    assert {(r.query, r.id): r.rank for r in got if r["rank"] == 1}.keys() == {(i, i) for i in range(4)}
    assert len(got) == 8 and hnsw.search(hnsw.build(v), v, 9).count() == 16
    for wrong in (v.limit(0), v.unionByName(v)):
        with pytest.raises(ValueError):
            hnsw.build(wrong)
    with pytest.raises(ValueError):
        hnsw.build(v, "manhattan")


def test_given_vectors(spark, sf_dir):
    from kvlake.plans import catalogue

    got = {(r.query, r.id) for r in catalogue.queries()["vec_hnsw_knn"](spark, sf_dir).collect()}
    want = {(r.query, r.id) for r in catalogue.queries()["vec_batch_knn"](spark, sf_dir).collect()}
    assert len(got & want) / len(want) >= 0.9
