"""Quality rules combined by weak supervision.

Each rule votes good (1) or bad (0) on a text, or abstains (-1). Expectation-maximisation over the counts of vote
patterns (at most 3 to the power of the number of rules, whatever the corpus) estimates how often each rule is right
about good and about bad texts, without labels. A text's posterior probability of being good replaces the demand that
it pass every rule.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SEPARATORS, map_rows, written

SYMBOLS = "#*$%&|<>"
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_letters long, n_upper long, n_distinct long, n_plain long, n_lines long"
WORD_IN_SENTENCE = re.compile(r"^[\"'(\[]*[^\W_]+(?:['’-][^\W_]+)*[\])\"']*[.,;:!?]?[\"')]*$")


def repeated_words(words: list[str]) -> int:
    """Words that lie in a window of three words found twice or more, each counted once."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    seen, total, covered = Counter(windows), 0, 0
    for i, window in enumerate(windows):
        if seen[window] > 1:
            total += i + 3 - max(i, covered)
            covered = i + 3
    return total


def text_stats(text: str | None) -> tuple[int, ...]:
    """The figures named in STATS, of the whole text. A null text counts as an empty one."""
    if not text:
        return (0,) * 10
    words = [w.decode("utf-8", "surrogatepass") for w in text.encode("utf-8", "surrogatepass").split()]
    seen: set[str] = set()
    duplicates = lines = 0
    for line in text.split("\n"):
        if line.strip(SEPARATORS):
            lines += 1
            duplicates += line in seen
            seen.add(line)
    distinct = Counter(words)
    plain = sum(n for w, n in distinct.items() if WORD_IN_SENTENCE.match(w))
    letters = sum(n * sum(map(str.isalpha, w)) for w, n in distinct.items())
    upper = sum(n * sum(map(str.isupper, w)) for w, n in distinct.items())
    return (
        len(words), len(text) - sum(map(text.count, SEPARATORS)), sum(map(text.count, SYMBOLS)), duplicates,
        repeated_words(words), letters, upper, len(distinct), plain, lines,
    )


def vote(good: Column, bad: Column) -> Column:
    return F.when(good, F.lit(1)).when(bad, F.lit(0)).otherwise(F.lit(-1)).cast("int")


def rules() -> dict[str, Column]:
    """Rule name -> vote, over the columns of STATS; the shares are of at least one unit, so no rule divides by zero."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    letters = F.greatest(F.col("n_letters"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    lines = F.greatest(F.col("n_lines"), F.lit(1))
    share = lambda a, b: a * 100.0 / b
    repeats, symbols = share(F.col("n_repeat_words"), n), share(F.col("n_symbols"), n)
    upper, plain = share(F.col("n_upper"), letters), share(F.col("n_plain"), n)
    variety, copies = share(F.col("n_distinct"), F.sqrt(n)), share(F.col("n_dup_lines"), lines)
    alpha, mean = share(F.col("n_letters"), chars), F.col("word_chars") / n
    return {
        "repeated_windows": vote(repeats <= 30, repeats > 50),
        "symbols": vote(symbols <= 3, symbols > 15),
        "capitals": vote(upper <= 20, upper > 50),
        "plain_words": vote(plain >= 85, plain < 60),
        "variety": vote(variety >= 250, variety < 150),
        "copied_lines": vote(copies <= 10, copies > 40),
        "letters": vote(alpha >= 80, alpha < 70),
        "word_length": vote((mean >= 3) & (mean <= 12), (mean < 2) | (mean > 20)),
    }


#: Where the estimates start: good votes on a good text are usual; a bad text fails some rules, not all of them.
START = (0.98, 0.65)


def em(patterns: dict[tuple[int, ...], int], rounds: int = 200, smooth: float = 20.0) -> tuple[float, list[tuple[float, float]]]:
    """Prior of good, and for each rule its chances of voting good on a good and on a bad text, when it votes.

    ``smooth`` votes at the starting chances count with those of the texts, which keeps chances off 0 and 1; a rule is
    held to vote good on good texts at least as often as on bad ones, so that the two classes can't change places.
    """
    width = len(next(iter(patterns), ()))
    prior, chance = 0.9, [START] * width
    for _ in range(rounds):
        counts = [[smooth * START[0], smooth * (1 - START[0]), smooth * START[1], smooth * (1 - START[1])] for _ in range(width)]  # good|good, bad|good, good|bad, bad|bad
        good = total = 0.0
        for votes, n in patterns.items():
            p = posterior(votes, prior, chance)
            good, total = good + n * p, total + n
            for c, v in zip(counts, votes):
                if v >= 0:
                    c[1 - v] += n * p
                    c[3 - v] += n * (1 - p)
        new_prior = (good + 0.9) / (total + 1)
        new = [(a / (a + b), min(c / (c + d), a / (a + b))) for a, b, c, d in counts]
        done = abs(new_prior - prior) + sum(abs(a - c) + abs(b - d) for (a, b), (c, d) in zip(new, chance)) < 1e-9
        prior, chance = new_prior, new
        if done:
            break
    return prior, chance


def weights(prior: float, chance: list[tuple[float, float]]) -> tuple[float, list[tuple[float, float]]]:
    """Log odds of the prior, and what a good and a bad vote of each rule add to them."""
    clip = lambda x: min(max(x, 1e-6), 1 - 1e-6)
    odds = lambda a, b: math.log(clip(a) / clip(b))
    return odds(prior, 1 - prior), [(odds(g, b), odds(1 - g, 1 - b)) for g, b in chance]


def posterior(votes: tuple[int, ...], prior: float, chance: list[tuple[float, float]]) -> float:
    start, steps = weights(prior, chance)
    x = start + sum(s[1 - v] for s, v in zip(steps, votes) if v >= 0)
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, x))))


def score(docs: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statistics, votes and posterior quality of each text: (doc_id, the columns of STATS, votes, p_good, base_failed, kept).

    base_failed: under 50 words, or more than half of the words in repeated windows of three. kept: not base_failed and
    p_good at least the threshold. Null and empty texts have no words and so fail. Null ids, repeated rows and ties are
    kept as rows of their own; columns other than the two named are not read; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    stats = map_rows(rows, lambda: lambda row: (row[0], *text_stats(row[1])), f"doc_id {kind}, {STATS}", 4096)
    voted = written(stats.withColumn("votes", F.array(*rules().values())), "quality-votes")
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    # Vote patterns of texts that the base leaves open; a few hundred rows at most.
    open_patterns = voted.where(~failed).groupBy("votes").count().collect()
    patterns = {tuple(r["votes"]): r["count"] for r in open_patterns}
    prior, chance = em(patterns) if patterns else (0.9, [START] * len(rules()))
    start, steps = weights(prior, chance)
    odds = F.lit(start)
    for i, (good, bad) in enumerate(steps):
        v = F.col("votes")[i]
        odds = odds + F.when(v == 1, F.lit(good)).when(v == 0, F.lit(bad)).otherwise(F.lit(0.0))
    scored = voted.withColumn("p_good", 1 / (1 + F.exp(-odds))).withColumn("base_failed", failed)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))
