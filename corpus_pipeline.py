"""The corpus pipeline: documents through five of the training-data operators, each stage written and read again."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import language_id, mixing, piece_sampling, simhash_dedup, toxicity
from millrace.llm.common import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models don't reject, as they are. The models learn from the labels of sf_dir."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, out="__toxicity", predicted="__toxic")
    return scored.where("__toxic = 0").select(docs.columns)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with enough confidence, as they are. Learned from the documents' lang column."""
    model = language_id.fit(docs)
    told = language_id.predict(docs, model, pred="__lang", score="__confidence", rejected="__rejected")
    return told.where("not __rejected").select(docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near copies, as it is; rows without an id stay.

    Rows that share an id are told apart by their texts: each goes or stays with its own group, and of rows that repeat
    both one stays.
    """
    coded = docs.withColumn("__text_code", F.xxhash64("text"))
    found = written(simhash_dedup.near_duplicates(coded, carry=["__text_code"]), "near-copies").select(F.col("doc_id").alias("__id"), F.col("__text_code").alias("__code"), "kept")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("__text_code").eqNullSafe(F.col("__code"))
    stay = coded.join(found.where("not kept").select("__id", "__code").distinct(), same, "left_anti")
    repeats = written(found.where("kept and __id is not null").groupBy("__id", "__code").count().where("count > 1").select("__id", "__code"), "repeated-ids")
    once = stay.join(repeats, same, "left_semi").dropDuplicates(["doc_id", "__text_code"])
    return stay.join(repeats, same, "left_anti").unionByName(once).select(docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: a row for each document and pass that takes words of it, with those words as its text."""
    return mixing.mixed_documents(docs)


def sampled_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, ids, n_pieces, lossless): sampled piece ids of every row."""
    return piece_sampling.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id", "lang", "source"])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("language_id", known_language),
    ("simhash_near_dedup", one_of_each),
    ("mixing", mixed),
    ("sentencepiece", sampled_pieces),
]
#: Learned models and sampled pieces can't be told in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
