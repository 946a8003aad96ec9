"""The pipeline against its stages done one by one in plain Python."""

import hashlib
from collections import Counter

from tokenizers import Tokenizer

import corpus_pipeline
from kvlake.llm import mixing, queries, toxicity

from .test_native import brute_spans
from .test_near_duplicates import brute_fingerprint, least

SF = "/root/testdata/sf0.001"


def masked(text):
    spans, out, at = [s.split(":") for s in brute_spans(text).split(",") if s], "", 0
    for _, a, b in spans:
        a, b = int(a), int(b)
        if b > at:
            out += text[at : max(a, at)] + ("[SECRET]" if a >= at else "")
            at = b
    return out + text[at:]


def test_against_brute_force(spark):
    raw = spark.read.parquet(f"{SF}/documents.parquet")
    docs = [r.asDict() for r in raw.collect()]
    model = toxicity.fit(raw.select("doc_id", "text"), spark.read.parquet(f"{SF}/labels.parquet"))
    docs = [d for d, s in zip(docs, model.score([d["text"] for d in docs]), strict=True) if s < 0.5]
    fps = [brute_fingerprint(d["text"]) for d in docs]
    comp = least(len(docs), [(i, j) for i in range(len(docs)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    first = {}
    for d, c in zip(docs, comp, strict=True):
        first[c] = min(first.get(c, d["doc_id"]), d["doc_id"])
    docs = [d for d, c in zip(docs, comp, strict=True) if d["doc_id"] == first[c]]
    for d in docs:
        d["text"] = masked(d["text"] or "")
        d["n_chars"] = len(d["text"])
    third = spark.createDataFrame([tuple(d[c] for c in raw.columns) for d in docs], raw.schema)
    copies = {r.id: r.epochs + (r.rest > 0 and r.before + r.size / 2 <= r.rest) if r.size else 0 for r in mixing.mix(third).collect()}
    whole = Tokenizer.from_str(queries.tokenizer_spec())
    want = Counter()
    for d in docs:
        ids = whole.encode(d["text"], add_special_tokens=False).ids
        want[(d["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(d["text"].encode()).hexdigest())] += copies[d["doc_id"]]
    got = corpus_pipeline.run(spark, SF)
    assert Counter(tuple(r) for r in got.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()) == +want
    assert all(len(r.tokens) == r.n_tokens for r in got.collect())


def test_stages_keep_columns_and_take_odd_rows(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "x y z password: abcdef1", "en", None, 9), (5, "word " * 30_000, "de", "s", 150_000)]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "bpe":
            assert out.columns == docs.columns, name
        assert out.count() <= 2 * len(rows)
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "secrets", "mixing", "bpe"]
