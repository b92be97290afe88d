import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import language_model as M

WORD = re.compile(r"[^\x20\x09-\x0D]+")
lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def corpus(n=300, seed=5):
    rng = random.Random(seed)
    a, b = ["the", "a", "this", "One"], ["cat", "dog", "house", "tree", "É"]
    rows = [(i, " ".join(rng.choice(a) + " " + rng.choice(b) for _ in range(rng.randint(1, 12))) + (f" rare{i}" if i % 5 == 0 else "")) for i in range(n)]
    return rows + [(n, None), (n + 1, ""), (3, rows[3][1]), (None, "the cat"), (n + 2, "unseen words only")]


def test_base_equals_brute_force_and_model_is_better(spark):
    rows = corpus()
    train = [r for r in rows if r[0] is not None and r[0] % 10]
    counts = Counter()
    for _, t in train:
        counts.update([*WORD.findall(lower(t or "")), None])
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, t in rows:
        tokens = [*WORD.findall(lower(t or "")), None]
        want.append((i, len(tokens), sum(counts[w] > 0 for w in tokens), n, sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)))
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, score string")
    got = M.score(df, F.col("doc_id") % 10 != 0, clustered=12, classes=3, frequent=15).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    got.sort(key=key)
    for g, w in zip(got, sorted(want, key=key), strict=True):
        assert tuple(g[:4]) == w[:4] and g.base_score == pytest.approx(w[4], abs=1e-9)
        assert g.score < 0 and g.perplexity == pytest.approx(10 ** (-g.score / g.n_tokens))
    held = [g for g in got if g.doc_id is not None and g.doc_id % 10 == 0 and g.doc_id < 300]
    assert sum(g.score for g in held) > sum(g.base_score for g in held)


def test_exchange_parts_words_by_their_neighbours():
    counts = np.zeros((7, 7))
    for i in (0, 1, 2):
        for j in (3, 4, 5):
            counts[i, j] = counts[j, i] = 50
    of = M.exchange(counts, 2)
    assert len({of[0], of[1], of[2]}) == 1 and len({of[3], of[4], of[5]}) == 1 and of[0] != of[3] and of[6] == 2


def test_probabilities_sum_to_one_at_most(spark):
    df = spark.createDataFrame(corpus(60), "doc_id long, text string")
    words = ["the", "a", "this", "one", "cat", "dog", "house", "tree", "É".lower(), "É", "zzz"]
    probe = spark.createDataFrame([(1000 + i, w) for i, w in enumerate(words)] + [(2000, "")], "doc_id long, text string")
    got = M.score(df.unionByName(probe), F.col("doc_id") < 60, clustered=8, classes=2, frequent=100).where("doc_id >= 1000").collect()
    assert sum(10**g.score for g in got) < 1


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    out = sorted(M.score(df, F.lit(False)).collect())
    assert [r.n_known for r in out] == [0, 0] and [r.n_tokens for r in out] == [3, 1] and out[0].train_tokens == 0
    assert M.score(df.limit(0), F.lit(True)).collect() == []


def test_words_beyond_the_first_are_exchanged_too(spark):
    rng = random.Random(7)
    a, b = [f"a{i}xyz" for i in range(40)], [f"b{i}xyz" for i in range(40)]  # endings tell nothing
    rows = [(i, " ".join(f"{rng.choice(a)} {rng.choice(b)}" for _ in range(8))) for i in range(200)]
    probe = [(1000, "a31xyz b37xyz a39xyz b33xyz"), (1001, "a31xyz a39xyz b37xyz b33xyz")]
    got = M.score(spark.createDataFrame(rows + probe, "doc_id long, text string"), F.col("doc_id") < 1000, clustered=4, classes=2)
    fits, scrambled = (r.score for r in sorted(got.where("doc_id >= 1000").collect()))
    assert fits > scrambled + 1


def test_gains_equal_the_likelihood_after_each_move():
    """The best class of a word by moving it to every class and counting anew; no word comes after itself."""
    rng = np.random.default_rng(12)
    for _ in range(20):
        n, k = 12, 6  # classes: 0 to 3, those of words without one, the text's end
        counts = rng.poisson(1.2, (n, n)).astype(float)
        np.fill_diagonal(counts, 0)
        of = np.append(rng.integers(0, 4, n - 2), [4, 5])
        table = lambda c: np.eye(k)[c].T @ counts @ np.eye(k)[c]
        right, left = counts @ np.eye(k)[of], counts.T @ np.eye(k)[of]
        new = M.better(table(of), of[:-1], right[:-1], left[:-1])
        for w in range(n - 1):
            value = {}
            for c in range(4):
                moved = of.copy()
                moved[w] = c
                value[c] = M.likelihood(table(moved))
            best = max(value.values())
            assert value.get(int(new[w]), -np.inf) >= best - 1e-6 or (of[w] < 4 and new[w] == of[w] and value[int(of[w])] >= best - 1e-5), (w, value, new[w])


def test_neighbours_equal_brute_force(spark):
    rng = random.Random(13)
    rest, end, first_rest = 9, 10, 7
    texts = [[end, *(rng.choice([0, 1, 2, 3, 6, 7, 8, 9]) for _ in range(rng.randrange(6))), end] for _ in range(200)]
    df = spark.createDataFrame([(bytearray(np.array(t, np.uint16).tobytes()),) for t in texts], "s binary").repartition(3)
    want = Counter()
    for t in texts:
        folded = [rest if first_rest <= x < end else x for x in t]
        want.update(zip(folded, folded[1:]))
    right, left = Counter(), Counter()
    for r in M.neighbours(df, rest, end, first_rest, 2000, flush_at=100).collect():
        for k, n in zip(np.frombuffer(r.right, np.uint32).tolist(), np.frombuffer(r.right_n, np.int64).tolist()):
            right[k >> 16, k & 0xFFFF] += n
        for k, n in zip(np.frombuffer(r.left, np.uint32).tolist(), np.frombuffer(r.left_n, np.int64).tolist()):
            left[k & 0xFFFF, k >> 16] += n
    assert right == want == left


def test_score_equals_brute_force(spark, monkeypatch):
    """The model's probability from the classes it found, word by word in plain Python."""
    rows = corpus(200, seed=21)
    kept, written = {}, M.written
    monkeypatch.setattr(M, "written", lambda df, label, *codec: kept.setdefault(label, []).append(out := written(df, label, *codec)) or out)
    monkeypatch.setattr(M, "dropped", lambda df: None)
    got = M.score(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") % 10 != 0, clustered=6, classes=3, frequent=8).collect()
    lexicon = {bytes(r.word): (r.c, r["class"]) for r in kept["lm-lexicon"][0].collect()}
    endings = {bytes(r.ending): r.e_class for r in kept["lm-endings"][0].collect()}
    words = lambda t: lower(t or "").encode().split()
    train = [words(t) for i, t in rows if i is not None and i % 10]
    assert {w: c for w, (c, _) in lexicon.items()} == Counter(w for t in train for w in t)
    k = max(c for _, c in lexicon.values()) + 1
    sizes = Counter(c for _, c in lexicon.values())
    found = []

    def class_of(w):
        if w in lexicon:
            return lexicon[w][1]
        return endings.get(w[-3:] + (b"\xff" if any(b > 127 for b in w) else b""))

    steps, after, into = Counter(), Counter(), Counter()
    for t in train:
        c = ["end", *map(class_of, t), "end"]
        for a, b in zip(c, c[1:]):
            steps[a, b] += 1
            after[a] += 1
            into[b] += 1
    for g, (i, t) in zip(sorted(got, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.n_tokens, r.score)), sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, len(words(r[1]))))):
        c = ["end", *map(class_of, words(t)), "end"]
        if None in c:
            continue  # an ending that was never seen has the commonest class, which the tables don't tell
        for total in range(k + 1, k + 4):  # classes, with those of words without one and of the end
            p = sum(math.log10((steps[a, b] + 0.1) / (after[a] + 0.1 * total)) for a, b in zip(c, c[1:]))
            p += sum(math.log10((lexicon.get(w, (0, 0))[0] + 0.1) / (into[x] + 0.1 * (sizes[x] + 1))) for w, x in zip(words(t), c[1:]))
            if abs(p - g.score) < 1e-6:
                found.append(total)
                break
        else:
            raise AssertionError((i, t, g.score, p))
    assert len(set(found)) == 1 and len(found) > 150


def test_least_count_keeps_words_of_one_count_together():
    assert M.least_count({5: 2, 3: 4, 1: 100}, 6) == 3 and M.least_count({5: 2, 3: 4, 1: 100}, 5) == 5 and M.least_count({1: 9}, 8) == 2 and M.least_count({}, 8) == 1 and M.least_count({2: 1, 1: 1}, 8) == 1


def moves(rng, words, k, most):
    """A table of classes, words with classes of their own or none, and their neighbours' classes with counts up to most."""
    old = rng.integers(0, k - 1, words)
    right, left = (np.where(rng.random((words, k)) < 0.2, rng.integers(1, most + 1, (words, k)), 0).astype(float) for _ in range(2))
    return rng.poisson(900, (k, k)).astype(float), old, right, left


def test_gains_of_small_counts_are_looked_up(monkeypatch):
    """a logarithm for each pair and class was most of what a word's step into its class took."""
    args = moves(np.random.default_rng(3), 400, 40, 3)
    taken, log = [], np.log
    monkeypatch.setattr(np, "log", lambda x: taken.append(np.size(x)) or log(x))
    M.better(*args)
    assert sum(taken) < (np.count_nonzero(args[2]) + np.count_nonzero(args[3])) * 40 / 2


def test_gains_looked_up_equal_those_counted(monkeypatch):
    for seed in range(8):
        args = moves(np.random.default_rng(seed), 150, 12, 14)
        looked_up = M.better(*args)
        with monkeypatch.context() as m:
            m.setattr(M, "_FEW", 0)
            assert (M.better(*args) == looked_up).all()


def test_words_and_endings_equal_plain_ones(spark):
    rng = random.Random(4)
    signs = [chr(i) for i in range(1, 128)] + list(" \n \t\x1c\x85\xa0\u2028\u3000ÉİK日𝄞")
    texts = [None, "", " ", " a ", *("".join(rng.choice(signs) for _ in range(rng.randrange(50))) for _ in range(500))]
    want = [[w.encode() for w in WORD.findall(lower(t or ""))] for t in texts]
    flat, sizes = M.words_of(pa.array(texts).slice(2))
    assert sizes.tolist() == [len(w) for w in want[2:]] and [w.encode() for w in flat.to_pylist()] == [w for ws in want for w in ws]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    counts = M.count_words(df, most=50).withColumn("ending", M.ending(F.col("word"))).collect()
    assert {bytes(r.word): r.c for r in counts} == Counter(w for ws in want for w in ws) and len({r.word for r in counts}) == len(counts)
    assert all(bytes(r.ending) == bytes(r.word)[-3:] + (b"\xff" if any(b > 127 for b in r.word) else b"") for r in counts)


def test_endings_by_shuffle_give_the_same_scores(spark):
    df = spark.createDataFrame(corpus(120, seed=8), "doc_id long, text string")
    run = lambda most: sorted(map(tuple, M.score(df, F.col("doc_id") % 10 != 0, clustered=6, classes=3, frequent=8, most_broadcast=most).collect()), key=str)
    assert run(-1) == run(500_000)
