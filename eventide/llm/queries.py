"""Registered queries of the package: each operator over its whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.llm import (centroids, chat_preferences, decontaminate, infill, jaccard_join, language_id,
                          license_scan, mixture, neighbours, quality, repeats, search, token_blocks)
from eventide.llm.oracle_sql import ORACLE
from eventide.storage import shared_dir

QUERIES: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_class(n: int):
    """The remainder by which rows are held out: crc32 of the id's digits."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op2_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digest(table(spark, sf_dir, "documents"))


def token_digest(docs: DataFrame) -> DataFrame:
    """Store documents as a file set in the shared folder; what is read back from it."""
    path = f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    token_blocks.write(docs, path, tokenizer_path())
    return token_blocks.documents(token_blocks.read(docs.sparkSession, path), ids=False)


@query
def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.taken_words(table(spark, sf_dir, "documents"))


def language_model(docs: DataFrame) -> language_id.Model:
    return language_id.train(docs.where(id_class(4) != 2),
                             order=F.xxhash64(F.col("doc_id")))


@query
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    slim = docs.select("doc_id", (id_class(4) == 2).alias("held_out"), "text")
    return language_id.predict(slim, language_model(docs), keep=["doc_id", "held_out"])


@query
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"),
                                table(spark, sf_dir, "benchmark"))


@query
def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.classes(table(spark, sf_dir, "documents"))


@query
def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removed(table(spark, sf_dir, "documents"), keep=False)


@query
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"),
                                     learn_from=id_class(3) != 1)
    return scored.select("doc_id", (id_class(3) == 1).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op8_chat_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = lambda c: F.array_join(F.transform(c, lambda r: F.concat_ws(
        "-", r["first"].cast("string"), r["last"].cast("string"))), ",")
    out = chat_preferences.formatted(
        chat_preferences.stale_reply_pairs(table(spark, sf_dir, "conversations")))
    return out.select(F.col("conv").alias("conv_id"), "prompt_turns", "prompt", "chosen_completion",
                      "rejected_completion", ranges("chosen_loss").alias("chosen_loss"),
                      ranges("rejected_loss").alias("rejected_loss"))


@query
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.matches(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.try_element_at("found", F.lit(1))["license"].alias("license"),
                        F.try_element_at("found", F.lit(1))["dice"].alias("dice"),
                        F.size("found").cast("long").alias("n_licenses"),
                        F.array_join(F.array_sort(F.transform("found", lambda x: x["license"])), ",")
                        .alias("licenses"))


@query
def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top(table(spark, sf_dir, "documents"), F.pmod("doc_id", F.lit(20)) == 0)


@query
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = infill.transformed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return infill.restored(cut).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("restored_sha256"))


@query
def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.assigned(centroids.clustered(table(spark, sf_dir, "embeddings")))


@query
def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.top(table(spark, sf_dir, "embeddings"), F.pmod("id", F.lit(20)) == 0)
