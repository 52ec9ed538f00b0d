"""The corpus pipeline: documents in, token ids out.

Each stage works on all that its predecessor kept, and returns the columns of ``documents`` (the last
one: doc_id, lang, source and the ids). Between stages the rows are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftline.llm import bpe, language_id, mixing, near_dedup, secret_scan
from siftline.llm.shared import written

#: The stages' decisions (models fitted here, projected rates, drawn by hash) are beyond SQL.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those that no language claims clearly."""
    return language_id.keep_identified(docs, language_id.train(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the least doc_id of each group of near copies."""
    return near_dedup.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces each secret in the texts by its kind."""
    return secret_scan.redact(docs)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws documents, each at most once, by the rates that bring the domains' tokens to the target weights."""
    return mixing.draw(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), most_rate=1.0)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The byte-pair ids of every document that is left."""
    return bpe.encode(docs, keep=("doc_id", "lang", "source"))


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_copies),
    ("secret_scan", redact_secrets),
    ("mixing", mix_to_weights),
    ("bpe", encode_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the table ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
