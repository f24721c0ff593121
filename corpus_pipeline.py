"""Corpus pipeline: from raw documents to packed token ids.

Each stage takes (spark, docs, sf_dir) and returns a frame, which is written as Parquet and read
again as the next stage's documents. All stages but the last keep the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from eventide.llm import decontaminate, jaccard_join, language_id, mixture
from eventide.llm.queries import language_model, table, token_digest
from eventide.storage import shared_dir


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in some language; texts that are null or without a letter go."""
    return language_id.known_language(docs, language_model(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group that near-copy links connect."""
    return jaccard_join.one_of_each(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no word window of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to target weights takes them."""
    return mixture.mixed(docs)


def store_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in packed blocks; what reading them back gives per document."""
    return token_digest(docs)


STAGES = [("language ID", identify_language), ("n-gram Jaccard join", drop_near_copies),
          ("benchmark decontamination", drop_benchmark_leaks), ("mix to target weights", mix_sources),
          ("token-ID output", store_tokens)]

# No SQL can run a suffix automaton or a tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{k}")
    return docs
