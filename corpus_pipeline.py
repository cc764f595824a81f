"""The corpus pipeline: quality rules, near-duplicates, decontamination, personal data, token ids.

Each stage reads what the one before it wrote. No SQL can express the near-duplicate and token stages, so ORACLE_SQL is
None and the stages are tested against brute force. An empty table passes through as an empty table; stages before the last
return the columns they are given, whatever the names of extra ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidegraph.llm import bpe, decontam, pii, quality, simhash
from tidegraph.llm.common import scratch, small_batches, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that no rule rejects; null and empty texts have no words, so go."""
    return quality.passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least doc_id, of each group of near copies: SimHash within 3 bits over five-word shingles, or a
    similarity of 0.8 or more. Null texts are equal texts, a null doc_id comes last, of repeated rows one stays."""
    small_batches(spark)
    return simhash.keep_one(docs, shingle=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that share no window with a benchmark item; null texts and items share none."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; null texts stay null."""
    return pii.redact(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids) of every document; null and empty texts have no ids."""
    small_batches(spark)
    out = bpe.encode(docs)
    return out.selectExpr("doc_id", "lang", "source", "cast(size(ids) as bigint) as n_tokens", "ids")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("token_ids", token_ids),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's result is written and read back as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
