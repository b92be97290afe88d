"""The registered queries on the smallest tables: contract columns, one row where the contract says so, SQL where there is some."""

import os

import pytest

from tidemark.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
COLUMNS = {
    "op2_language_id": ("documents", ["doc_id", "held_out", "lang_pred", "score"]),
    "op3_html_extraction": ("pages", ["page_id", "url", "text", "n_chars"]),
    "op4_sentencepiece": ("documents", ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]),
    "op5_toxicity": ("documents", ["doc_id", "held_out", "score", "predicted"]),
    "op6_quality_rules": ("documents", ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]),
    "op7_ngram_join": ("documents", ["doc_id", "n_shingles", "component_id"]),
    "op8_secret_scan": ("documents", ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]),
    "op10_language_model": ("documents", ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]),
}
KINDS = {"held_out": "boolean", "lang_pred": "string", "text": "string", "n_chars": "bigint", "ids_sha256": "string", "decoded_sha256": "string", "predicted": "int", "base_failed": "boolean", "kept": "boolean", "base_sha256": "string", "spans": "string", "url": "string", "score": "double", "base_score": "double"}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_contract(spark, name):
    source, columns = COLUMNS[name]
    df = queries.queries()[name](spark, SF)
    kinds = dict(df.dtypes)
    assert {c: kinds[c] for c in columns} == {c: KINDS.get(c, "bigint") for c in columns}
    ids = sorted(r[0] for r in df.select(columns[0]).collect())
    assert ids == sorted(r[0] for r in spark.read.parquet(f"{SF}/{source}.parquet").select(columns[0]).collect())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    cur = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    want = sorted(tuple(r[names.index(c)] for c in df.columns) for r in cur.fetchall())
    assert sorted(map(tuple, df.collect())) == want


def test_licences(spark):
    got = queries.queries()["op1_license_scan"](spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {(r.doc_id, r.family) for r in got} >= {(d, "mit") for d, t in texts.items() if "Released under the MIT License." in t}
