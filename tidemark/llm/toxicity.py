"""Toxicity by non-negative positive-unlabelled learning.

The classifier is linear over the set of a text's words (hashed) and is trained in numpy from confirmed toxic texts and
from texts of unknown label, with the risk estimator  pi * E_P[l(g)] + max(0, E_U[l(-g)] - pi * E_P[l(-g)]),  where pi
is the share of toxic texts. Where the part in max() turns negative, the step climbs back, as in the published method.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows, sample_below, stable_hash

BITS = 30
WORD = re.compile(r"[^\W\d_]+")


class _Ids(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= 400_000:
            self.clear()
        h = self[word] = stable_hash(word, BITS)
        return h


def word_ids(text: str | None, ids: _Ids) -> np.ndarray:
    """Sorted hashed words of the whole text, each once."""
    words = set(WORD.findall(text.lower())) if text else ()
    return np.unique(np.fromiter(map(ids.__getitem__, words), np.int32, len(words)))


@dataclass
class Model:
    """Sorted hashes of the words with a weight, their weights, and the offset."""

    known: np.ndarray
    w: np.ndarray
    b: float
    prior: float

    def score(self, ids: np.ndarray) -> float:
        z = self.b
        if len(self.known) and len(ids):
            at = np.minimum(np.searchsorted(self.known, ids), len(self.known) - 1)
            z += float(self.w[at[self.known[at] == ids]].sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _rows(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the ones of a sparse matrix."""
    return np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate([*sets, np.zeros(0, np.int64)])


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, rounds: int = 800, rate: float = 0.05, decay: float = 1e-5, least: int = 5, sigmas: float = 5.5) -> Model:
    """Minimise the non-negative risk over the whole samples with Adam; logistic loss.

    Words have a weight if ``least`` texts hold them and the share of toxic texts with the word is ``sigmas`` standard
    errors above that of unlabelled ones; more words would only let the classifier learn single texts by heart.
    """
    b = float(np.log(prior / (1 - prior)))
    none = np.zeros(0, np.int32)
    if not positive or not unlabelled:
        return Model(none, np.zeros(0), b if positive else -30.0, prior)
    words, of = np.unique(np.concatenate([*positive, *unlabelled]), return_inverse=True)
    split = sum(map(len, positive))
    in_p, in_u = np.bincount(of[:split], minlength=len(words)), np.bincount(of[split:], minlength=len(words))
    both = (in_p + in_u) / (len(positive) + len(unlabelled))
    error = np.sqrt(both * (1 - both) * (1 / len(positive) + 1 / len(unlabelled)))
    known = words[(in_p + in_u >= least) & (in_p / len(positive) - in_u / len(unlabelled) > sigmas * error)]

    def inside(sets: list[np.ndarray]) -> list[np.ndarray]:
        at = [np.minimum(np.searchsorted(known, s), max(len(known) - 1, 0)) for s in sets]
        return [a[known[a] == s] if len(known) else a[:0] for a, s in zip(at, sets)]

    (pr, pc), (ur, uc) = _rows(inside(positive)), _rows(inside(unlabelled))
    n_p, n_u = len(positive), len(unlabelled)
    v = np.zeros(len(known) + 1)
    v[-1] = b
    best, least_risk = v.copy(), np.inf
    m1, m2 = np.zeros_like(v), np.zeros_like(v)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    loss = lambda z: np.logaddexp(0, -z).mean()
    for t in range(1, rounds + 1):
        gp, gu = np.bincount(pr, v[pc], n_p) + v[-1], np.bincount(ur, v[uc], n_u) + v[-1]
        toxic, rest = prior * loss(gp), loss(-gu) - prior * loss(-gp)
        if (risk := toxic + max(0.0, rest) + decay * float(v @ v)) < least_risk:
            best, least_risk = v.copy(), risk
        # Slopes of the losses with regard to the outputs.
        up, uu, down = -sigmoid(-gp) / n_p, sigmoid(gu) / n_u, sigmoid(gp) / n_p
        dp, du = (prior * up - prior * down, uu) if rest >= 0 else (prior * down, -uu)
        grad = decay * v
        grad[:-1] += np.bincount(pc, dp[pr], len(known)) + np.bincount(uc, du[ur], len(known))
        grad[-1] += dp.sum() + du.sum()
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad * grad
        v = v - rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
    return Model(known, best[:-1], float(best[-1]), prior)


def train(docs: DataFrame, labels: DataFrame, usable: Column, positives: int = 3000, unlabelled: int = 12000, lean: float = 1.08, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on bounded samples: about ``positives`` toxic rows, and about ``unlabelled`` of all rows, whatever their label.

    The prior leans upwards a little (``lean``): where it is set too low, texts with one telling word stay undecided.

    The second sample has toxic texts in their natural share, as the risk estimator supposes. ``usable`` is a condition on a column doc_id. The class prior is the share of toxic rows among usable labelled ones.
    """
    marks = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("y")).where(usable).where("doc_id is not null and y is not null")
    n_all, n_pos = marks.agg(F.count("*"), F.coalesce(F.sum((F.col("y") == 1).cast("int")), F.lit(0))).first()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(usable).where("doc_id is not null and text is not null")
    prior = min(0.5, max(1e-3, lean * n_pos / n_all)) if n_all else 0.01
    toxic = sample_below(marks.where("y = 1"), positives, n_pos, F.col("doc_id"), F.lit(5)).select("doc_id").distinct()
    ids = sorted(r[0] for r in toxic.collect())  # bounded by ``positives``
    total = rows.count()
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(2**32)) < min(2**32, int(2**32 * unlabelled / max(total, 1)))
    picked = F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in ids], f"p_id {rows.schema['doc_id'].dataType.simpleString()}"))
    near = rows.join(picked, rows["doc_id"] == picked["p_id"], "left").where(F.col("p_id").isNotNull() | drawn)
    rest = near.select("doc_id", "text", F.col("p_id").isNotNull().alias("pos"), drawn.alias("drawn"))

    def make():
        held = _Ids()
        return lambda row: (row[0], row[2], row[3], word_ids(row[1], held).tobytes())

    rest = rest.withColumn("doc_id", F.col("doc_id").cast("string"))  # ids of any type, here only to put the rows in order
    made = sorted((r["doc_id"], r["pos"], r["drawn"], bytes(r["x"])) for r in map_rows(rest, make, "doc_id string, pos boolean, drawn boolean, x binary", 64).collect())
    arrays = [(pos, u, np.frombuffer(x, np.int32)) for _, pos, u, x in made]
    return fit([x for pos, _, x in arrays if pos], [x for _, u, x in arrays if u], prior)


def score(docs: DataFrame, model: Model, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) for each row, from its whole text.

    Null, empty and wordless texts get the score of no words. Null ids and repeated rows stay; other columns are not
    read; an empty table gives an empty result. Without confirmed toxic rows every score is near 0.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def make():
        held = _Ids()
        return lambda row: (row[0], model.score(word_ids(row[1], held)))

    scored = map_rows(rows, make, f"doc_id {kind}, score double", 4096)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
