import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import toxicity as T

BAD = ["scumm", "morony", "trashy", "clownish"]


def rows(n=2400, seed=2):
    rng = random.Random(seed)
    words = [f"{a}{b}{c}" for a in "abcdefgh" for b in "aeiou" for c in "klmnop"]
    docs, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.choice([5, 40, 300]))]
        toxic = i % 8 == 0
        if toxic:
            for w in rng.sample(BAD, 2):
                text.insert(rng.randrange(len(text)), w.capitalize() + ",")
        docs.append((i, " ".join(text), "score"))
        if rng.random() < 0.5:
            labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_precision_and_recall(spark):
    docs, labels = rows()
    df = spark.createDataFrame(docs, "doc_id long, text string, predicted string")
    lb = spark.createDataFrame(labels, "doc_id long, toxic int")
    held = F.col("doc_id") % 3 == 1
    model = T.train(df, lb, ~held)
    got = {r.doc_id: r for r in T.score(df.where(held), model).collect()}
    toxic = [got[i].predicted for i, _, _ in docs if i % 3 == 1 and i % 8 == 0]
    clean = [got[i].predicted for i, _, _ in docs if i % 3 == 1 and i % 8]
    assert np.mean(toxic) > 0.95 and np.mean(clean) < 0.02


def test_defined_cases(spark):
    df = spark.createDataFrame([(1, None), (1, None), (None, ""), (4, "9 8 7"), (5, "scumm " * 30000)], "doc_id long, text string")
    lb = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    model = T.train(df, lb, F.lit(True))
    out = T.score(df, model).collect()
    assert len(out) == 5 and all(0 <= r.score < 0.7 and r.predicted == 0 for r in out)
    assert T.score(df.limit(0), T.train(df.limit(0), lb.limit(0), F.lit(True))).collect() == []


def test_ids_may_be_text(spark):
    docs, labels = rows(400)
    df = spark.createDataFrame([(f"d{i}", t) for i, t, _ in docs], "doc_id string, text string")
    lb = spark.createDataFrame([(f"d{i}", y) for i, y in labels], "doc_id string, toxic int")
    assert T.score(df, T.train(df, lb, F.lit(True))).count() == 400


def test_risk_and_its_slope_against_brute_force():
    """Training must end no higher than any small step away from it, by a risk computed text by text."""
    rng = np.random.default_rng(4)
    positive = [np.unique(rng.integers(0, 12, 6)).astype(np.int32) for _ in range(60)]
    unlabelled = [np.unique(rng.integers(4, 30, 6)).astype(np.int32) for _ in range(240)]
    prior = 0.2
    model = T.fit(positive, unlabelled, prior, rounds=3000, rate=0.02, decay=1e-2, sigmas=0.0)
    loss = lambda z: float(np.log1p(np.exp(-z)))

    def risk(w, b):
        g = lambda ids: b + sum(x for h, x in zip(model.known, w) if h in ids)
        p, u = [g(set(s.tolist())) for s in positive], [g(set(s.tolist())) for s in unlabelled]
        rest = np.mean([loss(-z) for z in u]) - prior * np.mean([loss(-z) for z in p])
        return prior * np.mean([loss(z) for z in p]) + max(0.0, rest) + 1e-2 * (float(w @ w) + b * b)

    best = risk(model.w, model.b)
    for i in range(len(model.w)):
        for d in (0.05, -0.05):
            w = model.w.copy()
            w[i] += d
            assert risk(w, model.b) > best - 2e-4
    assert min(risk(model.w, model.b + 0.05), risk(model.w, model.b - 0.05)) > best - 2e-4
