"""The opN_ queries: each operator with production parameters on its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import divergence, hnsw_dedup, imatch, language_id, merkle, mixing, piece_sampling, quality_classifier, quality_rules, simhash_dedup, token_store, toxicity, warc
from millrace.llm.common import remainder, shared_path, table


def op1_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return piece_sampling.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"])


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(remainder("doc_id", 4) != 2))
    return language_id.predict(docs.select("doc_id", "text", (remainder("doc_id", 4) == 2).alias("held_out")), model, keep=["doc_id", "held_out"])


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(remainder("doc_id", 4) != 2))
    return toxicity.score(docs.select("doc_id", "text", (remainder("doc_id", 4) == 2).alias("held_out")), model, keep=["doc_id", "held_out"])


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_mix_to_target_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality_classifier.fit(docs, labels.where(remainder("doc_id", 5) != 0))
    return quality_classifier.score(docs.select("doc_id", "text", (remainder("doc_id", 5) == 0).alias("held_out")), model, keep=["doc_id", "held_out"])


def op7_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(table(spark, sf_dir, "pages"), captures=True)


def op8_hnsw_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "tokens")
    token_store.write(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return token_store.read_sums(spark, folder)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    trees = quality_rules.fit(docs, labels.where(remainder("doc_id", 5) != 0))
    return quality_rules.judge(docs.select("doc_id", "text"), trees, keep=["doc_id"])


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints(table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, 1).otherwise(0)
    return merkle.prove(table(spark, sf_dir, "documents"), claimed={"n_chars": F.col("n_chars") + more})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece_sampling": op1_sentencepiece_sampling,
    "op2_language_id": op2_language_id,
    "op3_toxicity": op3_toxicity,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_mix_to_target_weights": op5_mix_to_target_weights,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_warc_derivatives": op7_warc_derivatives,
    "op8_hnsw_near_dedup": op8_hnsw_near_dedup,
    "op9_token_store": op9_token_store,
    "op10_quality_rules": op10_quality_rules,
    "op11_source_divergence": op11_source_divergence,
    "op12_document_fingerprints": op12_document_fingerprints,
    "op13_merkle_manifest": op13_merkle_manifest,
}
ORACLES: dict[str, str] = {"op5_mix_to_target_weights": mixing.oracle(), "op11_source_divergence": divergence.oracle(), "op13_merkle_manifest": merkle.oracle()}
