import hashlib
import random
import re

import public_tokenizers
import sentencepiece

import corpus_pipeline
from tests.llm.test_language_id import PARTS
from tests.llm.test_ngram_join import brute as components
from tests.llm.test_secret_scan import brute as secrets


def documents():
    rng = random.Random(12)
    word = lambda lang: "".join(rng.choice(PARTS[lang]) for _ in range(rng.randint(1, 4)))
    items = [(i, " ".join(word("en") for _ in range(20))) for i in range(3)] + [(9, None)]
    docs = []
    for _ in range(60):
        lang = rng.choice(list(PARTS))
        words = [word(lang) for _ in range(rng.choice([3, 30, 120]))]
        for _ in range(rng.choice([1, 1, 3])):
            w = list(words)
            w[rng.randrange(len(w))] = word(lang)
            if rng.random() < 0.2:
                w.insert(rng.randrange(len(w)), "password=" + "".join(rng.choice("0123456789abcdef") for _ in range(20)))
            if rng.random() < 0.1:
                w[1:1] = rng.choice(items[:3])[1].split()
            docs.append((len(docs), " ".join(w), lang, "s", 0))
    docs += [(900, None, "en", "s", 0), (901, "", "de", None, None), (902, "1234 5678", None, "s", 9), docs[0]]
    return docs, items


def brute(docs, items):
    docs = [d for d in dict.fromkeys(docs) if d[1] and any(map(str.isalpha, d[1]))]
    kept = {c for _, _, c in components([d[:2] for d in docs])}
    docs = [d for d in docs if d[0] in kept]
    grams = lambda t: {tuple(w[i : i + 5]) for w in [t.lower().split()] for i in range(len(w) - 4)}
    sets = [grams(t) for _, t in items if t]
    docs = [d for d in docs if not any(100 * len(s & grams(d[1])) >= 75 * len(s) for s in sets)]
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    out = []
    for d in docs:
        at, text = 0, ""
        for _, a, b in [x.split(":") for x in secrets(d[1])[1].split(",") if x]:
            if int(a) >= at:
                text += d[1][at : int(a)] + "[SECRET]"
            at = max(at, int(b))
        ids = sp.encode(text + d[1][at:])
        out.append((d[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    return sorted(out)


def test_pipeline_equals_brute_force(spark, tmp_path):
    docs, items = documents()
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = brute(docs, items)
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == want
    assert 0 < len(want) < len(docs) - 10
    odd = spark.read.parquet(f"{tmp_path}/documents.parquet").selectExpr("*", "1 AS lang_pred", "'s' AS secret_spans", "2 AS _id", "3 AS _text", "4 AS score", "5 AS sig", "6 AS component_id", "7 AS `a.b`")
    columns, before = odd.columns, odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        odd = stage(spark, odd, str(tmp_path))
        assert odd.columns == columns
    rows = odd.collect()
    assert rows and all((r.lang_pred, r.secret_spans, r["_id"], r["_text"], r.score, r.sig, r.component_id, r["a.b"]) == (1, "s", 2, 3, 4, 5, 6, 7) for r in rows)
    assert sorted(map(tuple, corpus_pipeline.STAGES[-1][1](spark, odd, str(tmp_path)).collect())) == want and before.count() == len(docs)
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, str(tmp_path))
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    assert re.fullmatch(r"\w+", corpus_pipeline.STAGES[0][0])
