"""The corpus pipeline: quality, near duplicates, benchmark decontamination, secrets, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and reread as the next
one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from wanderframe.llm import decontaminate, ngram_join, quality_classifier, secret_scan, tokens
from wanderframe.llm.common import shipped, table, written

TOKENIZER = "byte_bpe_multi_50k.tiktoken"


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, fitted on the labels outside the held-out fold, does not reject."""
    shipped(spark)
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return quality_classifier.kept(docs, quality_classifier.fitted(docs, labels))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group of near duplicates."""
    return ngram_join.one_of_each(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than one word in twenty stands in a benchmark passage."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced."""
    shipped(spark)
    return secret_scan.redacted(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and n_tokens of every document."""
    shipped(spark)
    return tokens.encoded(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality_classifier", good),
    ("ngram_join", distinct),
    ("decontaminate", uncontaminated),
    ("secret_scan", without_secrets),
    ("byte_bpe", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in order, each written to the shared folder and reread by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: The first stage fits a model, which SQL does not express: the stages are tested against plain Python instead.
ORACLE_SQL = None
