"""The registered queries ``opN_<name>``: each applies its operator to a whole table and derives the agreed columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import bpe, extendible, html_text, media, media_samples, mixing, secrets_ledger, simhash, toxicity, vector_dedup, warc


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark, sf_dir):
    packages = warc.write_packages(table(spark, sf_dir, "pages"))
    r = warc.read_packages(spark, packages)
    return r.select(warc.page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", warc.page_of(F.col("refers_to")).alias("refers_to"))


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages),
h AS (SELECT page_id, first, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS hex FROM p),
b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: ['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111', '1000', '1001', '1010', '1011', '1100', '1101', '1110', '1111'][strpos('0123456789abcdef', substr(hex, i, 1))]), '') AS bits FROM h)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(list_sum(list_transform(range(1, 6), lambda k: CAST(substr(bits, j * 5 + k, 1) AS INTEGER) << (5 - k))) AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM b
"""


def tokenizer_spec(path: str | None = None) -> str:
    """The JSON of a tokenizer file, read where the driver is; tasks get its text."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def token_digests(encoded):
    """n_tokens and the digests of ids and of the decoded text."""
    ids = F.array_join(F.col("tokens").cast("array<string>"), ",")
    return [F.size("tokens").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256")]


def op2_bpe(spark, sf_dir):
    found = bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer_spec())
    return found.select(F.col("id").alias("doc_id"), *token_digests(found))


def op3_html(spark, sf_dir):
    found = html_text.main_text(table(spark, sf_dir, "pages"))
    return found.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))


def op4_sharding(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return extendible.shards(docs, limit=SHARD_BYTES).select("doc_id", "shard", "n_bytes", "shard_bytes", "oversized")


SHARD_BYTES = 1 << 20

#: A prefix is a shard where it fits, or has one key alone, and the one above it does neither.
OP4_SQL = f"""
WITH h AS (
  SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h,
         coalesce(octet_length(encode(text)), 0) AS n_bytes FROM documents),
t AS (SELECT d, h >> (60 - d) AS p, sum(n_bytes) AS b, count(DISTINCT h) AS keys FROM h, range(0, 61) r(d) GROUP BY ALL),
s AS (SELECT h.doc_id, h.h, h.n_bytes, min(t.d) AS d FROM h, range(0, 61) r(e) JOIN t ON t.d = r.e AND t.p = h.h >> (60 - r.e)
      WHERE t.b <= {SHARD_BYTES} OR t.keys = 1 GROUP BY ALL)
SELECT s.doc_id, substr(lpad(bin(s.h), 60, '0'), 1, CAST(s.d AS INTEGER)) AS shard, s.n_bytes,
       CAST(t.b AS BIGINT) AS shard_bytes, t.b > {SHARD_BYTES} AS oversized
FROM s JOIN t ON t.d = s.d AND t.p = s.h >> (60 - s.d)
"""


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 16) AS UBIGINT) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM d GROUP BY source),
w AS (SELECT *, source_size * 2.0::DOUBLE AS most, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(r - 1) % 3 + 1] AS weight FROM s),
f AS (SELECT *, most / weight AS full_at FROM w),
l AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE - coalesce(sum(most) OVER (ORDER BY full_at, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY full_at, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM f),
g AS (SELECT l.*, (SELECT x.level FROM l x WHERE x.level <= x.full_at ORDER BY x.full_at, x.r LIMIT 1) AS stop FROM l),
t AS (SELECT source, source_size, CASE WHEN stop IS NULL THEN most ELSE least(most, stop * weight) END AS target FROM g),
e AS (SELECT *, CAST(round(target) AS BIGINT) AS budget, CASE WHEN source_size > 0 THEN CAST(round(target) AS BIGINT) // source_size ELSE 0 END AS epochs FROM t),
b AS (SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM d)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - before)) AS BIGINT) AS taken
FROM b JOIN e ON b.source IS NOT DISTINCT FROM e.source
"""


def op5_mixing(spark, sf_dir):
    m = mixing.mix(table(spark, sf_dir, "documents"))
    return m.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op6_simhash(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_secrets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets_ledger.fresh_ledger(spark).scan(docs, path_col="doc_id")
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    return found.select(F.col("path").alias("doc_id"), n("assign"), n("access"), n("hex"), F.sha2(joined, 256).alias("base_sha256"), joined.alias("spans"))


def _spans_sql(kind: str, rank: int, pattern: str, group: int, least: int) -> str:
    """Spans of one kind: what stands between the matches and the matches alternate."""
    p = pattern.replace("'", "''")
    return f"""m{rank} AS (SELECT doc_id, regexp_extract_all(text, '{p}', 0) AS hits, regexp_extract_all(text, '{p}', {group}) AS tests, regexp_split_to_array(text, '{p}') AS gaps FROM d),
n{rank} AS (SELECT doc_id, length(hits[i]) AS n, length(tests[i]) AS test, sum(length(gaps[i])) OVER w + coalesce(sum(length(hits[i])) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM m{rank}) WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
k{rank} AS (SELECT doc_id, {rank} AS rank, start, '{kind}:' || CAST(start AS BIGINT) || ':' || CAST(start + n AS BIGINT) AS span FROM n{rank} WHERE test >= {least})"""


OP7_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), {", ".join(_spans_sql(*r) for r in secrets_ledger.RULES)},
u AS (SELECT * FROM k0 UNION ALL SELECT * FROM k1 UNION ALL SELECT * FROM k2),
j AS (SELECT doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex, string_agg(span, ',' ORDER BY start, rank) AS spans FROM u GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN j USING (doc_id)
"""


def op8_media(spark, sf_dir):
    """The tables hold no pictures: every row of embeddings gets one, edits and crops of a family's picture among them."""
    pictures = media_samples.media_of(table(spark, sf_dir, "embeddings"), "vec_id")
    return media.copies(pictures).withColumnRenamed("id", "vec_id")


def op9_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.scores(docs, model).withColumnRenamed("id", "doc_id")


def op10_vectors(spark, sf_dir):
    return vector_dedup.near_duplicates(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def queries():
    return {
        "op1_warc": op1_warc,
        "op2_bpe": op2_bpe,
        "op3_html": op3_html,
        "op4_sharding": op4_sharding,
        "op5_mixing": op5_mixing,
        "op6_simhash": op6_simhash,
        "op7_secrets": op7_secrets,
        "op8_media": op8_media,
        "op9_toxicity": op9_toxicity,
        "op10_vectors": op10_vectors,
    }


def oracle_sql():
    return {"op1_warc": OP1_SQL, "op4_sharding": OP4_SQL, "op5_mixing": OP5_SQL, "op7_secrets": OP7_SQL}
