"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word is the average of the vectors of its character n-grams, a document the average of its words,
and a linear softmax sits on top; vectors and softmax are trained together, in numpy, on the driver, to
which tasks send labelled documents as bags of n-grams.
An unseen misspelling is made of n-grams that were seen. As everything above the n-grams is linear, a
trained model is a number for each n-gram bucket, which is what tasks carry; a document's score needs
one look at each of its words.

Labels are learned from at most ``SAMPLE`` labelled rows, those with the least hash, and never from
held-out ones; all else covers every row and the whole text. Defined results:
* null, empty or blank text: the score of an empty average, label 0 unless the model's bias says else
* no usable label, or labels of one class alone: every score is that class's rate (0 without labels)
* null ids: not held out, as they have no text to take a remainder of; repeated rows are scored alike
* labels with a null id or value are left out; of several for one id the largest holds; of several texts
  under one labelled id the least is learned from, so that at most ``SAMPLE`` bags reach the driver
* few labels: what the classes differ in is looked for by standard errors, which n labels bring to the
  root of n at most, so the demand falls with n below 39; from a handful every score is the classes' rate
* columns of the input beside the named ones are not touched, whatever their names
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import lean, written

#: Labelled rows that the model is fitted to, at most.
SAMPLE = 8000
BUCKETS = 1 << 17
NGRAMS = (3, 4, 5, 6)
DIM = 8
EPOCHS = 12
RATE = 6.0
DECAY = 0.0001
#: Standard errors by which the classes must differ in an n-gram; of n labels no more than this part of the root of n.
LEAST_Z, OF_ROOT = 5.0, 0.8
#: Documents of a training step.
STEP = 64
#: Words whose values a task keeps; beyond it the table starts anew.
KEPT_WORDS = 300_000
#: Documents whose words are in memory at once.
SLICE = 128
_EDGE = "\"'`.,;:!?#$%&*|()[]{}<>~^+=-_/\\@"


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the words, and the number of the word that each is from."""
    marked = [f"<{w.strip(_EDGE) or w}>" for w in words]
    c = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    of = np.repeat(np.arange(len(words)), np.fromiter(map(len, marked), np.int64, len(words)))
    ids, at = [], []
    for n in NGRAMS:
        if len(c) < n:
            break
        whole = np.flatnonzero(of[: len(of) - n + 1] == of[n - 1 :])
        h = np.full(len(whole), n, np.uint64)
        for k in range(n):
            h = (h ^ c[whole + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        ids.append((h >> np.uint64(20)).astype(np.int64) & (BUCKETS - 1))
        at.append(of[whole])
    if len(words):  # and each word as a whole
        size = np.fromiter(map(len, marked), np.int64, len(words))
        first = np.cumsum(size) - size
        odd = np.uint64(0x9E3779B97F4A7C15) ** (np.arange(64, dtype=np.uint64) + np.uint64(1))
        h = np.add.reduceat(c * odd[(np.arange(len(c)) - first[of]) % 64], first)
        ids.append(((h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(20)).astype(np.int64) & (BUCKETS - 1))
        at.append(np.arange(len(words)))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *ids]), np.concatenate([none, *at])


def word_values(words: list[str], table: np.ndarray) -> np.ndarray:
    """Each word's average of its n-grams' values."""
    ids, at = subwords(words)
    n = np.bincount(at, minlength=len(words))
    return np.bincount(at, table[ids], minlength=len(words)) / np.maximum(n, 1)


def split(text: str | None) -> list[str]:
    return (text or "").lower().split()


class Model:
    """A value for each bucket and a bias: the log-odds of the toxic class are the bias plus the document's average."""

    def __init__(self, table: np.ndarray, bias: float):
        self.table, self.bias = table, bias

    def score(self, texts: list[str | None], known: dict[str, float] | None = None) -> np.ndarray:
        """``known`` keeps words' values from call to call; it is emptied when it holds too many."""
        known, z = {} if known is None else known, np.zeros(len(texts))
        for at in range(0, len(texts), SLICE):
            docs = [split(t) for t in texts[at : at + SLICE]]
            if len(known) > KEPT_WORDS:
                known.clear()
            new = list({w for d in docs for w in d}.difference(known))
            for k in range(0, len(new), 1 << 15):
                part = new[k : k + (1 << 15)]
                known.update(zip(part, word_values(part, self.table).tolist(), strict=True))
            z[at : at + SLICE] = [sum(map(known.__getitem__, d)) / len(d) if d else 0.0 for d in docs]
        return 1 / (1 + np.exp(-np.clip(z + self.bias, -60, 60)))


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """A text's n-gram buckets and their parts of its average."""
    words = split(text)
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    own, count = _counts(words)
    ids, at = subwords(own)
    per = np.bincount(at, minlength=len(count))
    u, inv = np.unique(ids, return_inverse=True)
    return u.astype(np.int32), np.bincount(inv, (count / per / len(words))[at]).astype(np.float32)


#: Parts are added up as whole numbers of this size, which have the same sum in any order.
UNIT = 2.0**-40


class Tally:
    """Of labelled texts: how many of each class have each bucket, and the sum of the parts."""

    def __init__(self):
        self.n, self.seen, self.parts = np.zeros(2, np.int64), np.zeros((2, BUCKETS), np.int64), np.zeros(BUCKETS, np.int64)

    def add(self, own: tuple[np.ndarray, np.ndarray], label: int) -> None:
        u, v = own
        self.n[label] += 1
        self.seen[label, u] += 1
        self.parts[u] += np.rint(v.astype(np.float64) / UNIT).astype(np.int64)

    def read(self) -> np.ndarray:
        """By how much each bucket's parts are multiplied; 0 where it gets no vector.

        Vectors are given to the n-grams that are in more, or fewer, toxic documents than chance explains;
        of the many others each would fit a few documents. All are read by the square root of their rate,
        at which they vary alike by chance.
        """
        n, seen = self.n, self.seen
        share = (seen.sum(0) + 1) / (n.sum() + 2)
        z = np.abs(seen[1] / n[1] - seen[0] / n[0]) / np.sqrt(share * (1 - share) * (1 / n[0] + 1 / n[1]))
        rate = self.parts * UNIT / n.sum()
        return np.where((z >= min(LEAST_Z, OF_ROOT * np.sqrt(n.sum()))) & (seen.sum(0) >= 3), 1 / np.sqrt(np.maximum(rate, 1e-9)), 0)


def kept(own: tuple[np.ndarray, np.ndarray], read: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bag as the vectors see it."""
    u, v = own
    k = read[u] > 0
    return u[k], (v[k] * read[u[k]]).astype(np.float32)


def of_one_class(n: np.ndarray) -> Model | None:
    """The model of no labels, or of labels of one class; None where there are both."""
    return None if n.all() else Model(np.zeros(BUCKETS), 60.0 if n[1] else -60.0)


def train(texts: list[str], labels: list[int], seed: int = 7) -> Model:
    """A model of labelled texts that are all here; ``fit`` is the same over a table."""
    tally, bags = Tally(), [bag(t) for t in texts]
    for own, y in zip(bags, labels, strict=True):
        tally.add(own, y)
    if one := of_one_class(tally.n):
        return one
    read = tally.read()
    return descend([kept(own, read) for own in bags], np.asarray(labels, np.int64), read, seed)


def descend(bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, read: np.ndarray, seed: int = 7) -> Model:
    """Gradient descent, by steps of ``STEP`` documents that shrink to nothing, on the cross-entropy of the softmax, over n-gram vectors and both classes' weights together."""
    n = np.bincount(y, minlength=2)
    rng = np.random.default_rng(seed)
    e = (rng.normal(size=(BUCKETS, DIM)) * 0.01).astype(np.float32)
    w = np.outer(rng.normal(size=DIM), [-0.5, 0.5]).astype(np.float32)
    b = np.log(n / n.sum()).astype(np.float32)
    for epoch in range(EPOCHS):
        step = RATE * (1 - epoch / EPOCHS)
        for part in np.array_split(rng.permutation(len(y)), max(1, len(y) // STEP)):
            ids = np.concatenate([bags[i][0] for i in part])
            val = np.concatenate([bags[i][1] for i in part])
            doc = np.repeat(np.arange(len(part)), [len(bags[i][0]) for i in part])
            u, inv = np.unique(ids, return_inverse=True)
            dense = np.zeros((len(part), len(u)), np.float32)
            dense[doc, inv] = val
            x = dense @ e[u]
            z = x @ w + b
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = (p - np.eye(2, dtype=np.float32)[y[part]]) / len(part)
            e[u] -= step * (dense.T @ (g @ w.T) + DECAY * e[u])
            w -= step * 0.1 * (x.T @ g)
            b -= step * 0.1 * g.sum(0)
    side = w[:, 1] - w[:, 0]
    return Model((e @ side).astype(np.float64) * read, float(b[1] - b[0]))


def _counts(words: list[str]) -> tuple[list[str], np.ndarray]:
    n: dict[str, int] = {}
    for x in words:
        n[x] = n.get(x, 0) + 1
    return list(n), np.fromiter(n.values(), np.int64, len(n))


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """At most ``sample`` ids reach the join. Texts stay in the tasks: the driver gets the buckets' tallies, then each text's bag of the buckets that have vectors."""
    usable = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
    chosen = usable.groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    text = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    rows = text.join(F.broadcast(chosen), "_id").groupBy("_id", "_y").agg(F.min("_text").alias("_text"))
    rows = written(rows, "toxicity-sample")

    def tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Tally()
        for b in batches:
            for y, x in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                t.add(bag(x), y)
        at = np.flatnonzero(t.seen.sum(0))
        # the classes' own counts are a row of their own
        cells = [np.r_[at, -1], np.r_[t.seen[0, at], t.n[0]], np.r_[t.seen[1, at], t.n[1]], np.r_[t.parts[at], 0]]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cells], ["bucket", "zero", "one", "parts"])

    found = rows.mapInArrow(lean(tallied), "bucket long, zero long, one long, parts long").groupBy("bucket").agg(*[F.sum(c).alias(c) for c in ("zero", "one", "parts")]).toArrow()
    at, *cells = (found.column(c).to_numpy() for c in ("bucket", "zero", "one", "parts"))
    tally, real = Tally(), at >= 0
    tally.seen[0, at[real]], tally.seen[1, at[real]], tally.parts[at[real]] = (c[real] for c in cells)
    tally.n[:] = [c[~real].sum() for c in cells[:2]]
    if one := of_one_class(tally.n):
        return one
    read = tally.read()
    sent = docs.sparkSession.sparkContext.broadcast(read)

    def bagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bags = [kept(bag(x), sent.value) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([u for u, _ in bags], pa.list_(pa.int32())), pa.array([v for _, v in bags], pa.list_(pa.float32()))], ["_id", "_y", "u", "v"])

    kind = docs.schema[id_col].dataType.simpleString()
    bags = rows.mapInArrow(lean(bagged), f"_id {kind}, _y int, u array<int>, v array<float>").toArrow().sort_by("_id")
    pairs = [(np.array(u.as_py(), np.int32), np.array(v.as_py(), np.float32)) for u, v in zip(bags.column("u"), bags.column("v"), strict=True)]
    return descend(pairs, bags.column("_y").to_numpy().astype(np.int64), read)


def scores(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score and predicted for each row."""
    sent = docs.sparkSession.sparkContext.broadcast((model.table.astype(np.float32), model.bias))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, known = Model(*sent.value), {}
        for b in batches:
            s = m.score(b.column(2).to_pylist(), known)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).alias("id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lean(of), f"id {docs.schema[id_col].dataType.simpleString()}, held_out boolean, score double, predicted int")


def clean(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """The documents that the model doesn't reject, whatever their columns; each is scored where it is read."""
    sent = docs.sparkSession.sparkContext.broadcast((model.table.astype(np.float32), model.bias))
    at = docs.columns.index(text_col)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, known = Model(*sent.value), {}
        for b in batches:
            keep = m.score(b.column(at).to_pylist(), known) < 0.5
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(lean(of), docs.schema)
