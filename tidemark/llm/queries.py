"""The registered queries of the text operators: thin, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, html_extraction, language_id, language_model, license_scan, ngram_join, quality_rules, secret_scan, sentencepiece_codec, toxicity
from .common import fold, table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 4) == 2
    model = language_id.train(docs, ~held_out)
    return language_id.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(table(spark, sf_dir, "pages"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = fold(F.col("doc_id"), 3) == 1
    model = toxicity.train(docs, labels, ~held_out)
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_rules.score(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components_of(table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    remainder = fold(F.col("doc_id"), 10)
    scored = language_model.score(docs, remainder > 0)
    return scored.select("doc_id", (remainder == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_scan": op1_license_scan,
        "op2_language_id": op2_language_id,
        "op3_html_extraction": op3_html_extraction,
        "op4_sentencepiece": op4_sentencepiece,
        "op5_toxicity": op5_toxicity,
        "op6_quality_rules": op6_quality_rules,
        "op7_ngram_join": op7_ngram_join,
        "op8_secret_scan": op8_secret_scan,
        "op9_decontamination": op9_decontamination,
        "op10_language_model": op10_language_model,
    }


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words_sql(name: str, key: str) -> str:
    return f"SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM {name}"


#: n-grams of w: every five words in a row; of fewer words, all of them.
_GRAMS_SQL = "list_distinct([array_to_string(w[i : i + 4], ' ') FOR i IN range(1, greatest(len(w) - 4, 1) + 1)])"

_OP7_SQL = f"""
WITH RECURSIVE words AS ({_words_sql("documents", "doc_id")}),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE {_GRAMS_SQL} END AS g FROM words),
grams AS (SELECT doc_id, len(g) AS n, unnest(g) AS gram FROM sets),
frequent AS (SELECT gram FROM grams GROUP BY gram HAVING count(*) > 1),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y
  FROM grams a JOIN frequent f ON a.gram = f.gram JOIN grams b ON a.gram = b.gram AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))
),
reach(doc_id, other) AS (
  SELECT x, y FROM pairs
  UNION
  SELECT r.doc_id, p.y FROM reach r JOIN pairs p ON r.other = p.x
)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(min(r.other), s.doc_id)) AS component_id
FROM sets s LEFT JOIN reach r ON s.doc_id = r.doc_id GROUP BY s.doc_id, s.g
"""

_OP9_SQL = f"""
WITH item_words AS ({_words_sql("benchmark", "item_id")}),
items AS (SELECT item_id, least(len(w), 5) AS width, {_GRAMS_SQL} AS g FROM item_words WHERE len(w) > 0),
item_grams AS (SELECT item_id, width, len(g) AS n, unnest(g) AS gram FROM items),
doc_words AS ({_words_sql("documents", "doc_id")}),
doc_grams AS (
  SELECT DISTINCT doc_id, width, unnest([array_to_string(w[i : i + width - 1], ' ') FOR i IN range(1, len(w) - width + 2)]) AS gram
  FROM doc_words, (SELECT DISTINCT width FROM items)
)
SELECT d.doc_id, i.item_id, CAST(any_value(i.n) AS BIGINT) AS item_shingles, count(*) AS shared, count(*) / CAST(any_value(i.n) AS DOUBLE) AS containment
FROM item_grams i JOIN doc_grams d ON d.gram = i.gram AND d.width = i.width
GROUP BY d.doc_id, i.item_id HAVING 100 * count(*) >= 75 * any_value(i.n)
"""


def oracle_sql() -> dict[str, str]:
    """The joins in SQL. The other queries learn, decode or hash what SQL can't: tests hold them against brute force or held-out labels."""
    return {"op7_ngram_join": _OP7_SQL, "op9_decontamination": _OP9_SQL}
