import random
import re

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import ngram_join as J
from tidemark.llm.common import WordHashes
from tidemark.llm.components import components
from tidemark.llm.shingles import shingle_set

WORD = re.compile(r"[^\x20\x09-\x0D]+")
lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def brute(rows):
    sets = []
    for _, t in rows:
        w = WORD.findall(lower(t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = root(i)
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return sorted(((d, len(s), least.get(root(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def corpus(n=150, seed=8):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["É", "Été"]
    passage = " ".join(rng.choice(vocab) for _ in range(60))
    rows = []
    while len(rows) < n:
        words = [rng.choice(vocab) for _ in range(rng.choice([3, 8, 20, 60, 200]))]
        base = " ".join(words)
        for _ in range(rng.choice([1, 1, 1, 2, 6])):
            w = list(words)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            text = " ".join(w)
            rows.append((len(rows), rng.choice([text, text.upper().replace(" ", "\n"), text + " " + passage if rng.random() < 0.5 else base])))
    return rows + [(n + 50, None), (n + 51, ""), (None, rows[0][1]), (0, rows[0][1]), (0, "a b"), (n + 52, "A  b"), (None, None)]


def test_components_equal_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, sig int")
    want = brute(rows)
    assert sorted((tuple(r) for r in J.components_of(df).collect()), key=str) == want
    small = J.linked_classes(df, most_in_group=300, most_ids=0)
    assert sorted((tuple(r) for r in small.select("doc_id", "n_shingles", "component_id").collect()), key=str) == want
    by_prefix = J.linked_classes(df, most_in_group=300, most_ids=0, most_blocks=1)
    assert sorted((tuple(r) for r in by_prefix.select("doc_id", "n_shingles", "component_id").collect()), key=str) == want


def test_one_group_over_many_blocks(spark):
    """A chain of texts, each linked with its neighbours only: every link matters, and they all share words."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[4 * i : 4 * i + 60])) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert len({c for _, _, c in want}) == 1
    for blocks in (16, 1):
        got = J.linked_classes(df, most_in_group=500, most_blocks=blocks).select("doc_id", "n_shingles", "component_id")
        assert sorted((tuple(r) for r in got.collect()), key=str) == want


def test_a_text_without_an_id_joins_two_others(spark):
    words = [f"w{i}" for i in range(100)]
    rows = [(7, " ".join(words[:60])), (None, " ".join(words[6:66])), (3, " ".join(words[12:72]))]
    want = brute(rows)
    assert {c for _, _, c in want} == {3} and brute([rows[0], rows[2]])[0][2] != brute([rows[0], rows[2]])[1][2]
    assert sorted((tuple(r) for r in J.components_of(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str) == want


def test_tree_equals_all_pairs():
    rng = np.random.default_rng(3)
    for _ in range(60):
        bases = [rng.choice(300, rng.integers(1, 60), replace=False) for _ in range(4)]
        sets = []
        for _ in range(25):
            s = set(bases[rng.integers(4)].tolist())
            s ^= set(rng.choice(300, rng.integers(0, 6), replace=False).tolist())
            if s:
                sets.append(np.array(sorted(s), np.uint64))
        forest = J.Forest(len(sets))
        for i in range(len(sets)):
            for j in range(i):
                o = len(np.intersect1d(sets[i], sets[j]))
                if 100 * o >= 75 * (len(sets[i]) + len(sets[j]) - o):
                    forest.join(i, j)
        assert J.join_group(sets) == [forest.root(i) for i in range(len(sets))]


def test_prefix_bound_holds():
    rng = np.random.default_rng(4)
    for _ in range(300):
        x = np.unique(rng.integers(0, 2**63, rng.integers(1, 80)).astype(np.uint64))
        y = np.unique(np.concatenate([x[rng.random(len(x)) > 0.12], rng.integers(0, 2**63, rng.integers(0, 12)).astype(np.uint64)]))
        o = len(np.intersect1d(x, y))
        if len(y) and 100 * o >= 75 * (len(x) + len(y) - o):
            shared = len(np.intersect1d(x[: J.prefix_length(len(x))], y[: J.prefix_length(len(y))]))
            assert shared >= max(J.least_shared(len(x)), J.least_shared(len(y)))


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(1000, i) for i in range(1001, 1100)] + [(5000, 5000)]
    for most in (300_000, 0):
        got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long"), most_in_task=most).collect()))
        assert all(got[i] == 0 for i in range(41)) and all(got[i] == 1000 for i in range(1000, 1100)) and got[5000] == 5000


def test_one_of_each_and_empty(spark):
    rows = corpus(40)
    df = spark.createDataFrame([r for r in rows if r[0] is not None and r[0] != 0] + [rows[0]], "doc_id long, text string")
    kept = {r.doc_id for r in J.one_of_each(df).collect()}
    assert kept == {c for _, _, c in brute([(r.doc_id, r.text) for r in df.collect()])}
    assert J.components_of(df.limit(0)).collect() == []


def test_shingles():
    h = WordHashes()
    assert len(shingle_set("a b c d e f a b c d e", h)) == 6 and len(shingle_set("a b", h)) == 1 and len(shingle_set(None, h)) == 0
    assert shingle_set("A b", h).tolist() == shingle_set("a\n B ", h).tolist() != shingle_set("b a", h).tolist()
    assert F is not None


def test_linked_sets_have_a_key_in_common():
    rng = np.random.default_rng(3)
    frequent = rng.integers(0, 2**63, 400).astype(np.uint64)
    of, met = J.Parts(J.Order(frequent)), 0
    for n in [1, 2, 3, 4, 5, 7, 20, 44, 59, 60, 61, 80, 133, 199, 200, 300, 900] * 12:
        own = np.unique(np.concatenate([rng.choice(frequent, min(n // 3, 300), replace=False), rng.integers(0, 2**63, n - min(n // 3, 300)).astype(np.uint64)]))
        n = len(own)
        kept = rng.permutation(own)[: rng.integers(J.least_common(n), n + 1)]
        more = rng.integers(0, 2**63, int(len(kept) / 0.75) - n if len(kept) / 0.75 > n else 0).astype(np.uint64)
        other = np.unique(np.concatenate([kept, more]))
        if 100 * len(kept) >= 75 * (n + len(other) - len(kept)):
            met += 1
            assert np.intersect1d(of.keys(own), of.keys(other)).size, n
    assert met > 150


def test_a_sieve_finds_all_that_was_put_in():
    rng = np.random.default_rng(4)
    numbers, others = rng.integers(-(2**63), 2**63, 5000), rng.integers(-(2**63), 2**63, 20_000)
    sieve = J.Sieve(np.append(numbers, [0, -1]))
    assert sieve.has(np.append(numbers, [0, -1])).all() and sieve.has(others).mean() < 0.01
    assert not J.Sieve(numbers[:0]).has(others).any()


def test_shared_passages_join_no_groups(spark, monkeypatch):
    """Families of copies in a ring, each with a passage of the next: before, all were one group, copied for each prefix n-gram."""
    rng = random.Random(5)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passages, rows, want = [words(40) for _ in range(30)], [], {}
    for f in range(30):
        text = words(200) + passages[f] + passages[(f + 1) % 30]
        for k in range(3):
            rows.append((f * 3 + k, " ".join(text[:100] + [f"x{k}"] + text[101:])))
            want[f * 3 + k] = f * 3

    def never(*args):
        raise AssertionError("a group of families that aren't linked")

    monkeypatch.setattr(J, "_by_prefix", never)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for most_ids in (0, 500_000):
        got = J.linked_classes(df, most_in_group=5000, most_blocks=1, most_ids=most_ids, most_frequent=0).collect()
        assert {r.doc_id: r.component_id for r in got} == want


def test_copies_of_large_groups_move_in_rounds(spark, monkeypatch):
    """Before, all copies of a group too large for one tree moved at once."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[4 * i : 4 * i + 60])) for i in range(80)]
    df, grouped, moved = spark.createDataFrame(rows, "doc_id long, text string"), J._grouped, []

    def counted(sets, keys, link):
        if "i" in keys:
            moved.append(sets.agg(F.coalesce(F.sum(F.length("grams") / 8), F.lit(0))).first()[0])
        return grouped(sets, keys, link)

    monkeypatch.setattr(J, "_grouped", counted)
    for blocks in (16, 1):
        moved.clear()
        got = J.linked_classes(df, most_in_group=500, most_blocks=blocks).select("doc_id", "n_shingles", "component_id")
        assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)
        assert sum(moved) > 30_000 and max(moved) < 12_000, moved


def test_large_groups_walk_few_nodes(monkeypatch):
    rng, hashes = random.Random(4), WordHashes()
    base = [f"b{i}" for i in range(200)]

    def repeated():
        """A word eight times, then the next: most of its n-grams are in many others, all of them in few."""
        return " ".join(" ".join([f"r{int(60 * rng.random() ** 2)}"] * 8) for _ in range(8))

    def near():
        words = list(base)
        for _ in range(rng.randint(2, 10)):
            words[rng.randrange(200)] = f"x{rng.random()}"
        return " ".join(words)

    for make in (repeated, near):
        sets = list({J.signature(g): g for g in (shingle_set(make(), hashes) for _ in range(700))}.values())
        plain = [set(g.tolist()) for g in sets]
        up = list(range(len(sets)))

        def root(i, up=up):
            while up[i] != i:
                i = up[i]
            return i

        for i in range(len(sets)):
            for j in range(i):
                if 100 * (o := len(plain[i] & plain[j])) >= 75 * (len(plain[i]) + len(plain[j]) - o):
                    a, b = root(i), root(j)
                    up[max(a, b)] = min(a, b)
        visits, counted = [0], np.count_nonzero

        def count(x):
            visits[0] += 1
            return counted(x)

        monkeypatch.setattr(np, "count_nonzero", count)
        assert J.join_group(sets) == [root(i) for i in range(len(sets))]
        after, visits[0] = visits[0], 0
        J.join_group(sets, few=len(sets))
        monkeypatch.undo()
        print(make.__name__, len(sets), after, visits[0])
        assert after * 4 < visits[0]
