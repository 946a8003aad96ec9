"""From raw documents to token ids: five stages, each written as Parquet and reread as the next one's documents.

All but the last keep the columns of ``documents``. Every stage works on all that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvlake.llm import bpe, mixing, queries, secrets_ledger, simhash, toxicity
from kvlake.llm.shared import written


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labels that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.clean(docs, toxicity.fit(docs.select("doc_id", "text"), labels))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of SimHash near-copies the document with the smallest id stays."""
    return simhash.one_of_each(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets become a mask, and n_chars follows the text."""
    clean = secrets_ledger.masked(docs)
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents by source weights; one that the mix takes twice is two rows."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the token ids, their number and digests."""
    found = bpe.encode_decode(docs, queries.tokenizer_spec())
    return found.select(F.col("id").alias("doc_id"), "tokens", *queries.token_digests(found))


STAGES = [
    ("toxicity", without_toxic),
    ("simhash", without_near_copies),
    ("secrets", without_secrets),
    ("mixing", mixed),
    ("bpe", tokens),
]

#: A trained classifier and fingerprints have no SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
