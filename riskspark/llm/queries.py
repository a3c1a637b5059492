"""The operators of this package as queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from riskspark.llm import (
    bpe, chat, fingerprints, langid, lexical, licences, neardup, packing, quality, suffixes, topk, toxicity, whitening,
)

Query = Callable[[SparkSession, str], DataFrame]


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def op1_chat_perspectives(spark: SparkSession, sf: str) -> DataFrame:
    return chat.rotate(spark.read.parquet(f"{sf}/conversations.parquet"))


def op2_licences(spark: SparkSession, sf: str) -> DataFrame:
    return licences.licence_paragraphs(documents(spark, sf))


def op3_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.packed_documents(documents(spark, sf), bpe.vocabulary())


def op4_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprints.document_fingerprints(documents(spark, sf))


def op5_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality.quality_scores(documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet"))


def op6_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.bpe_digests(documents(spark, sf), bpe.vocabulary())


def op7_language_id(spark: SparkSession, sf: str) -> DataFrame:
    return langid.language_predictions(documents(spark, sf))


def op8_exact_top_k(spark: SparkSession, sf: str) -> DataFrame:
    return topk.embedding_top_k(spark.read.parquet(f"{sf}/embeddings.parquet"))


def op9_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.toxicity_scores(documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet"))


def op10_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.duplicate_groups(documents(spark, sf))


def op11_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return suffixes.repeat_digests(documents(spark, sf))


def op12_embedding_whitening(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.embedding_whitening(spark.read.parquet(f"{sf}/embeddings.parquet"))


def op13_lexical_search(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.top_documents(documents(spark, sf), spark.read.parquet(f"{sf}/benchmark.parquet"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_chat_perspectives, op2_licences, op3_best_fit_packing, op4_fingerprints, op5_quality, op6_bpe, op7_language_id,
        op8_exact_top_k, op9_toxicity, op10_near_duplicates, op11_suffix_dedup, op12_embedding_whitening, op13_lexical_search,
    )
}
#: The others are tested against brute force, exact round trips or held-out labels.
ORACLE_SQL: dict[str, str] = {"op1_chat_perspectives": chat.SQL, "op11_suffix_dedup": suffixes.SQL, "op13_lexical_search": lexical.SQL}
