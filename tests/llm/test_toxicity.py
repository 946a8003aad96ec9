"""Toxicity: held-out accuracy, what the model may see, and odd inputs."""

import zlib

import numpy as np
import pytest

from kvlake.llm import queries, toxicity

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def scored(spark):
    return queries.op9_toxicity(spark, SF).toPandas()


def test_held_out_accuracy(spark, scored):
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    assert len(scored) == len(docs) and scored.score.between(0, 1).all()
    assert (scored.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in scored.doc_id]).all()
    assert (scored.predicted == (scored.score >= 0.5)).all()
    both = scored.merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")
    held = both[both.held_out]
    assert (held.predicted == held.toxic).mean() > 0.96
    assert held.predicted[held.toxic == 1].mean() > 0.85
    assert held.predicted[held.toxic == 0].mean() < 0.02


def test_held_out_labels_are_never_seen(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    from pyspark.sql import functions as F

    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, turned)
    assert np.array_equal(a.table, b.table) and a.bias == b.bias
    assert np.array_equal(a.table, toxicity.fit(docs.repartition(5), labels.repartition(3)).table)


def test_tasks_agree_with_the_definition():
    words = ["idiot", "ÄÖ!", "..", "a", "x" * 200]
    table = np.arange(toxicity.BUCKETS, dtype=float)
    alone = [toxicity.word_values([w], table)[0] for w in words]
    assert np.allclose(toxicity.word_values(words, table), alone)
    m = toxicity.Model(table / toxicity.BUCKETS, -0.5)
    known = {}
    assert np.allclose(m.score(["idiot a a", None, " "], known), 1 / (1 + np.exp(-(np.array([(alone[0] + 2 * alone[3]) / 3, 0, 0]) / toxicity.BUCKETS - 0.5))))
    assert set(known) == {"idiot", "a"}


def test_misspellings_share_vectors():
    rng = np.random.default_rng(0)
    plain = [" ".join("w%d" % i for i in rng.integers(0, 50, 40)) for _ in range(400)]
    texts = [t + " horrible nasty horrible" if k % 4 == 0 else t for k, t in enumerate(plain)]
    m = toxicity.train(texts, [int(k % 4 == 0) for k in range(400)])
    s = m.score([plain[1] + " horribble nassty horribles", plain[1]])
    assert s[0] > 0.5 > s[1]


def test_odd_inputs(spark):
    rows = [(1, None, "x"), (2, "", "x"), (2, "", "x"), (None, "a b", "x"), (5, "word " * 50000, "x"), (6, "\n \t", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (5, 0), (5, 1), (None, 1), (6, None), (77, 0)], "doc_id long, toxic int")
    m = toxicity.fit(docs, labels)
    assert toxicity.scores(docs, m).count() == len(rows)
    assert toxicity.clean(docs, toxicity.Model(np.zeros(toxicity.BUCKETS), -1.0)).columns == docs.columns
    none = toxicity.fit(docs, labels.limit(0))
    assert {r.predicted for r in toxicity.scores(docs, none).collect()} == {0}
    assert toxicity.scores(docs.limit(0), none).count() == 0


def test_few_labels_are_learned_from():
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma"]
    texts = [" ".join(words[(k + j) % 6] for j in range(8)) + (" vile wretch" if k % 2 else " kind friend") for k in range(20)]
    m = toxicity.train(texts, [k % 2 for k in range(20)])
    s = m.score(["alpha gamma vile wretch", "alpha gamma kind friend", "alpha gamma"])
    assert s[0] > 0.5 > s[1] and s[0] > s[2] > s[1]
    assert np.allclose(toxicity.train(["a b", "c d"], [0, 1]).score(["a b", "c d", ""]), 0.5)


def test_one_text_of_a_labelled_id(spark):
    """However often a labelled id repeats, one row of it reaches the driver."""
    from pyspark.sql import functions as F

    docs = spark.range(3000).select((F.col("id") % 3).alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 4).cast("string")).alias("text"))
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 0)], "doc_id long, toxic int")
    seen = []
    real, toxicity.descend = toxicity.descend, lambda bags, y, read: seen.append((len(bags), y.tolist())) or real(bags, y, read)
    try:
        m = toxicity.fit(docs, labels)
    finally:
        toxicity.descend = real
    usable = [i for i in range(3) if zlib.crc32(str(i).encode()) % 5]
    if 0 in usable and len(usable) > 1:
        assert seen == [(len(usable), [int(i == 0) for i in usable])]
    local = toxicity.train(["text 0"] * len(usable), [int(i == 0) for i in usable])
    assert np.array_equal(m.table, local.table) and m.bias == local.bias


def test_a_table_and_a_list_give_one_model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = docs.join(labels, "doc_id").filter(~toxicity.held_out(docs.doc_id)).orderBy("doc_id").collect()
    local, m = toxicity.train([r.text for r in rows], [r.toxic for r in rows]), toxicity.fit(docs, labels)
    assert np.array_equal(m.table, local.table) and m.bias == local.bias and np.count_nonzero(m.table) > 5


def test_training_against_plain_loops():
    """The same steps, document by document, on vectors kept in a dictionary."""
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(12)]
    y = [int(k % 3 == 0) for k in range(90)]
    texts = [" ".join([*rng.choice(vocabulary, 6), *(["awful"] if c else ["lovely"])]) for c in y]
    model = toxicity.train(texts, y)

    bags = []
    for t in texts:
        words, bag = t.split(), {}
        for w in words:
            ids = toxicity.subwords([w])[0].tolist()
            for i in ids:
                bag[i] = bag.get(i, 0) + 1 / len(ids) / len(words)
        bags.append(bag)
    n = [y.count(0), y.count(1)]
    read = {}
    for i in set().union(*bags):
        seen = [sum(i in b for b, c in zip(bags, y, strict=True) if c == k) for k in (0, 1)]
        share = (sum(seen) + 1) / (len(y) + 2)
        z = abs(seen[1] / n[1] - seen[0] / n[0]) / (share * (1 - share) * (1 / n[0] + 1 / n[1])) ** 0.5
        if z >= toxicity.LEAST_Z and sum(seen) >= 3:
            read[i] = (sum(b.get(i, 0) for b in bags) / len(y)) ** -0.5
    draw = np.random.default_rng(7)
    e = draw.normal(size=(toxicity.BUCKETS, toxicity.DIM)) * 0.01
    w = np.outer(draw.normal(size=toxicity.DIM), [-0.5, 0.5])
    b = np.log(np.array(n) / len(y))
    for epoch in range(toxicity.EPOCHS):
        rate = toxicity.RATE * (1 - epoch / toxicity.EPOCHS)
        for part in np.array_split(draw.permutation(len(y)), max(1, len(y) // toxicity.STEP)):
            de, dw, db = {}, np.zeros_like(w), np.zeros_like(b)
            for k in part:
                own = {i: v * read[i] for i, v in bags[k].items() if i in read}
                x = sum((v * e[i] for i, v in own.items()), np.zeros(toxicity.DIM))
                z = np.exp(x @ w + b)
                g = (z / z.sum() - np.eye(2)[y[k]]) / len(part)
                for i, v in own.items():
                    de[i] = de.get(i, 0) + v * (w @ g)
                dw += np.outer(x, g)
                db += g
            for i, d in de.items():
                e[i] -= rate * (d + toxicity.DECAY * e[i])
            w -= rate * 0.1 * dw
            b -= rate * 0.1 * db
    want = {i: float(e[i] @ (w[:, 1] - w[:, 0])) * r for i, r in read.items()}
    assert set(np.flatnonzero(model.table)) == set(want) and len(want) > 10
    assert np.allclose([model.table[i] for i in want], list(want.values()), rtol=0.02, atol=0.02) and abs(model.bias - (b[1] - b[0])) < 0.02
