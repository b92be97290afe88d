"""The corpus pipeline: stages over documents, each one written and read again by the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontamination, language_id, ngram_join, secret_scan, sentencepiece_codec
from tidemark.llm.common import fold, table, written
from tidemark.llm.queries import tokenizer_path


def own_columns(docs: DataFrame) -> list[Column]:
    """The columns of docs, whatever their names hold."""
    return [F.col(f"`{c}`") for c in docs.columns]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified, with the language put into lang; those without a letter to tell by go."""
    model = language_id.train(docs, fold(F.col("doc_id"), 4) != 2)
    found = language_id.annotated(docs, model, lang_out="_stage_lang", score_out="_stage_score").where("_stage_lang <> 'und'")
    return found.withColumn("lang", F.col("_stage_lang")).select(*own_columns(docs))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents that near copies connect, the one with the smallest id."""
    return ngram_join.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no item of the benchmark."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark; n_chars follows the text."""
    return secret_scan.redacted(docs).withColumn("n_chars", F.length("text").cast("long")).select(*own_columns(docs))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of token ids of each document, with digests of the ids and of the text they decode to."""
    return sentencepiece_codec.digests(docs, tokenizer_path())


STAGES = [
    ("language_id", known_language),
    ("ngram_join", one_of_each_group),
    ("decontamination", without_benchmark),
    ("secret_scan", without_secrets),
    ("sentencepiece", encoded),
]

#: A trained stage and a tokenizer can't be put into SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
