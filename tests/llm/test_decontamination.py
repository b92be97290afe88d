import random
import re

from tidemark.llm import decontamination as D

WORD = re.compile(r"[^\x20\x09-\x0D]+")
lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def brute(docs, items):
    out = []
    for i, t in items:
        w = WORD.findall(lower(t or ""))
        k = min(5, len(w))
        if not k:
            continue
        own = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
        for d, text in docs:
            x = WORD.findall(lower(text or ""))
            shared = len(own & {tuple(x[j : j + k]) for j in range(len(x) - k + 1)})
            if 100 * shared >= 75 * len(own):
                out.append((d, i, len(own), shared, shared / len(own)))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 3, 5, 7, 20, 40, 70])))) for i in range(40)]
    items += [(100, None), (101, "  "), (102, items[5][1]), (5, items[5][1]), (None, items[6][1])]
    docs = []
    for d in range(200):
        words = [rng.choice(vocab) for _ in range(rng.choice([2, 30, 300]))]
        if rng.random() < 0.6:
            passage = rng.choice(items[:40])[1].split()
            for _ in range(rng.choice([0, 1, 3])):
                passage[rng.randrange(len(passage))] = "other"
            at = rng.randrange(len(words))
            words[at:at] = passage
        docs.append((d, rng.choice(["\n", " "]).join(words).upper()))
    return docs + [(500, None), (501, ""), (None, items[9][1]), (3, docs[3][1])], items


def test_search_equals_brute_force(spark):
    docs, items = corpus()
    want = brute(docs, items)
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id int")
    it = spark.createDataFrame(items, "item_id long, text string")
    assert sorted((tuple(r) for r in D.search(df, it).collect()), key=str) == want
    assert sorted((tuple(r) for r in D.search(df, it, block_bytes=500).collect()), key=str) == want
    caught = {r[0] for r in want}
    left = D.clean(df, it, most_items_bytes=900)
    assert left.columns == df.columns and {r.doc_id for r in left.collect()} == {d for d, _ in docs} - caught
    assert D.search(df.limit(0), it).collect() == [] == D.search(df, it.limit(0)).collect()
    assert D.clean(df, it.limit(0)).count() == len(docs)
