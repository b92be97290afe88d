import random

from pyspark.sql import functions as F

from tidemark.llm import language_id as L

PARTS = {"en": ["the", "ing", "th", "wh", "ly", "ea", "nd"], "de": ["sch", "ung", "ein", "ich", "ä", "ß", "zu"], "fr": ["eau", "que", "è", "ment", "ou", "é", "le"], "es": ["ción", "ñ", "rr", "os", "ja", "mente", "ll"]}


def rows(n=60, seed=1):
    rng = random.Random(seed)
    out = []
    for lang, parts in PARTS.items():
        for i in range(n):
            out.append((len(out), " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(30)), lang, 5))
    return out


def test_held_out_accuracy_and_defined_cases(spark):
    made = rows()
    df = spark.createDataFrame(made, "doc_id long, text string, lang string, score int")
    held = F.col("doc_id") % 4 == 2
    model = L.train(df, ~held)
    assert model.families == {"germanic": ["de", "en"], "romance": ["es", "fr"]}
    got = {r.doc_id: r for r in L.predict(df.where(held), model).collect()}
    assert len(got) == 60 and all(0 <= r.score <= 1 for r in got.values())
    assert sum(got[i].lang_pred == lang for i, _, lang, _ in made if i in got) >= 58
    odd = spark.createDataFrame([(1, None), (1, None), (None, "123 !"), (3, ""), (4, "ße" * 50000)], "doc_id long, text string")
    out = L.predict(odd, model).collect()
    assert [r.lang_pred for r in out[:4]] == ["und"] * 4 and out[4].lang_pred == "de"
    assert L.predict(df.limit(0), model).collect() == []


def test_no_labels_and_one_language(spark):
    df = spark.createDataFrame([(1, "abc", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in L.predict(df, L.train(df, F.lit(True))).collect()} == {"und"}
    one = spark.createDataFrame([(1, "abc", "xx"), (2, "abd", "xx")], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in L.predict(one, L.train(one, F.lit(True))).collect()} == {"xx"}


def test_every_language_is_learned_and_ids_may_be_text(spark):
    """More languages than any fixed number of classes that a frequency cut would keep: each has characters of its own."""
    langs = [f"x{i:02d}" for i in range(80)]
    own = {lang: [chr(0x4E00 + 40 * i + j) for j in range(8)] for i, lang in enumerate(langs)}
    rng = random.Random(3)
    made = [(f"{lang}-{n}", "".join(rng.choice(own[lang]) for _ in range(40)), lang) for i, lang in enumerate(langs) for n in range(4 + i % 3)]
    df = spark.createDataFrame(made, "doc_id string, text string, lang string")
    model = L.train(df, F.lit(True))
    assert sorted(x for members in model.families.values() for x in members) == langs
    got = {r.doc_id: r.lang_pred for r in L.predict(df, model).collect()}
    assert sum(got[i] == lang for i, _, lang in made) > 0.97 * len(made)
