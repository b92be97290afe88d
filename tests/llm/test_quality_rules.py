import random
import re
from collections import Counter

from tidemark.llm import quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


def texts():
    rng = random.Random(3)
    made = [None, "", " \n\t", "a b c", "a a a a", "x\x85y\xa0z\x1cw　v q", "a b c\na b c\n\n \na b c\r"]
    for _ in range(300):
        made.append("".join(rng.choice(["a", "bb", "#", " ", " ", "\n", "é", "|", "C!! "]) for _ in range(rng.randrange(200))))
    return made


def test_statistics_equal_brute_force():
    for text in texts():
        assert Q.text_stats(text)[:5] == brute(text), repr(text)


def test_em_finds_the_bad_class():
    patterns = {(1, 1, 1): 900, (0, 0, -1): 60, (0, 0, 0): 30, (1, 1, 0): 20, (1, -1, 1): 40}
    prior, chance = Q.em(patterns)
    assert 0.85 < prior < 0.97
    assert Q.posterior((1, 1, 1), prior, chance) > 0.95 > 0.05 > Q.posterior((0, 0, 0), prior, chance)
    assert Q.posterior((-1, -1, -1), prior, chance) == Q.posterior((-1, -1, -1), prior, chance)


def test_query(spark):
    good = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)} ends," for i in range(60)) + "."
    loud = " ".join(f"W{chr(65 + i % 26)}{chr(65 + i // 26)}!!" for i in range(80)).upper()
    marked = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}$$$" for i in range(80))
    rows = [(i, good.replace("ends", f"ends{chr(97 + i % 7)}"), "z") for i in range(40)] + [(100, loud, "z"), (101, marked, "z")] * 6 + [(102, "a b " * 40, "z"), (103, None, "z"), (None, good, "z"), (0, good, "z")]
    out = Q.score(spark.createDataFrame(rows, "doc_id long, text string, votes string")).collect()
    assert len(out) == len(rows)
    kept = Counter((r.doc_id, r.kept) for r in out)
    assert all(kept[(i, True)] for i in range(40)) and kept[(None, True)] and kept[(0, True)] == 2
    assert kept[(101, False)] == 6 and kept[(102, False)] and kept[(103, False)] and kept[(100, False)] == 6
    assert Q.score(spark.createDataFrame([], "doc_id long, text string")).collect() == []
