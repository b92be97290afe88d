"""Language identification in two steps: the language family, then one-versus-one linear SVMs within it."""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows, small_batches

# Families of languages by ISO 639-1 code. A code that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy", "yi"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la"),
    "slavic": ("ru", "uk", "be", "bg", "mk", "sr", "hr", "bs", "sl", "cs", "sk", "pl"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz", "tk", "ky", "tt"),
    "iranian": ("fa", "ku", "ps", "tg"),
    "indic": ("hi", "ur", "bn", "pa", "gu", "mr", "ne", "si"),
    "semitic": ("ar", "he", "mt", "am"),
    "sinitic": ("zh", "yue"),
}
FAMILY_OF = {code: name for name, codes in FAMILIES.items() for code in codes}
BITS = 12


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def features(text: str) -> np.ndarray:
    """Counts of hashed character pairs and triples of the whole lower-cased text, square roots, at unit length."""
    a = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    a = np.where(a < 65, np.uint32(32), a)  # digits, marks and separators of ASCII are alike
    mask = np.uint32((1 << BITS) - 1)
    pair = a[:-1] * np.uint32(2654435761) ^ a[1:] * np.uint32(2246822519)
    triple = pair[:-1] * np.uint32(3266489917) ^ a[2:] * np.uint32(668265263)
    hashed = [((h ^ (h >> np.uint32(15))) * np.uint32(2654435761) >> np.uint32(7)) & mask for h in (pair, triple)]
    counts = np.bincount(hashed[0], minlength=1 << BITS) + np.bincount(hashed[1], minlength=1 << BITS)
    x = np.sqrt(counts.astype(np.float32))
    return x / max(float(np.linalg.norm(x)), 1e-9)


@dataclass
class Plane:
    """A linear SVM: its weights and offset, and the slope that turns its margin into a chance."""

    w: np.ndarray
    b: float
    slope: float

    def chance(self, x: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * (x @ self.w + self.b), -30, 30))))


@dataclass
class Model:
    families: dict[str, list[str]]
    family_planes: dict[str, Plane] = field(default_factory=dict)
    pairs: dict[tuple[str, str], Plane] = field(default_factory=dict)

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, chance); ('und', 0) for a text without letters or a model without languages."""
        if not self.families or not has_letter(text):
            return "und", 0.0
        x = features(text)
        family, p = next(iter(self.families)), 1.0
        if self.family_planes:
            chances = {f: plane.chance(x) for f, plane in self.family_planes.items()}
            total = sum(chances.values()) or 1.0
            family = max(sorted(chances), key=chances.get)
            p = chances[family] / total
        wins = dict.fromkeys(self.families[family], 0.0)
        for a, b in itertools.combinations(self.families[family], 2):
            q = self.pairs[a, b].chance(x)
            wins[a] += (q > 0.5) + q / 1000
            wins[b] += (q <= 0.5) + (1 - q) / 1000
        lang = max(sorted(wins), key=wins.get)
        for a, b in itertools.combinations(self.families[family], 2):
            if lang in (a, b):
                q = self.pairs[a, b].chance(x)
                p = min(p, q if lang == a else 1 - q)
        return lang, min(1.0, max(0.0, p))


def svms(x: np.ndarray, y: np.ndarray, cost: float = 50.0, rounds: int = 150) -> list[Plane]:
    """A linear SVM for each column of y (1 or -1) with squared hinge loss, by accelerated gradient; classes weigh the same whatever their sizes."""
    weight = np.where(y > 0, 0.5 / np.maximum((y > 0).sum(0), 1), 0.5 / np.maximum((y < 0).sum(0), 1)).astype(np.float32)
    w, b = np.zeros((x.shape[1], y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    v, vb, step, t = w.copy(), b.copy(), 1.0 / (2 * cost * 2 + 1), 1.0
    for _ in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ v + vb)) * weight * y
        w2, b2 = v - step * (v - 2 * cost * (x.T @ slack)), vb + step * 2 * cost * slack.sum(0)
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, vb = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    margins, slope = y * (x @ w + b), np.ones(y.shape[1])
    for _ in range(50):  # chances from margins, with one parameter
        p = 1 / (1 + np.exp(-np.clip(slope * margins, -30, 30)))
        slope = np.clip(slope + 0.5 * ((weight * margins * (1 - p)).sum(0) - 0.01 * slope), 1.0, 8.0)
    return [Plane(w[:, i].astype(np.float32), float(b[i]), float(slope[i])) for i in range(y.shape[1])]


def fit(texts: list[tuple[str, np.ndarray]]) -> Model:
    """A model from (language, features) rows; the order of the rows doesn't matter to it beyond rounding."""
    langs = sorted({lang for lang, _ in texts})
    families: dict[str, list[str]] = {}
    for lang in langs:
        families.setdefault(FAMILY_OF.get(lang.split("-")[0].lower(), lang), []).append(lang)
    model = Model(families)
    if not texts:
        return model
    x = np.stack([f for _, f in texts])
    y = np.array([lang for lang, _ in texts])
    if len(families) > 1:
        sides = np.stack([np.where(np.isin(y, members), 1, -1) for members in families.values()], 1).astype(np.float32)
        model.family_planes = dict(zip(families, svms(x, sides)))
    for members in families.values():
        for a, b in itertools.combinations(members, 2):
            of = (y == a) | (y == b)
            model.pairs[a, b] = svms(x[of], np.where(y[of] == a, 1, -1).astype(np.float32)[:, None])[0]
    return model


def train(docs: DataFrame, usable: Column, per_lang: int = 400, most_rows: int = 12_000, least: int = 20, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on a bounded sample: about per_lang rows of each language, of every language there is.

    Where that would be more than most_rows in all, fewer of each, but about ``least``. Rows are those where ``usable``
    holds, language, text and id are not null and the text has a letter. Ids may be of any type.
    """
    rows = docs.where(usable).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null and text is not null and doc_id is not null")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return Model({})
    each = max(least, min(per_lang, most_rows // len(counts)))
    shares = docs.sparkSession.createDataFrame([(lang, min(2**32, int(2**32 * each / n))) for lang, n in sorted(counts.items())], "_lang string, _share long")
    chosen = rows.join(F.broadcast(shares), F.col("lang") == F.col("_lang")).where(F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(2**32)) < F.col("_share"))
    made = map_rows(chosen.select(F.col("doc_id").cast("string"), "text", "lang"), lambda: lambda row: (row[2], row[0], features(row[1]).astype(np.float16).tobytes() if has_letter(row[1]) else None), "lang string, doc_id string, x binary", 64)
    found = sorted((r["lang"], r["doc_id"], bytes(r["x"])) for r in made.where("x is not null").collect())
    return fit([(lang, np.frombuffer(x, np.float16).astype(np.float32)) for lang, _, x in found])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for each row; whole texts.

    'und' with score 0 where the text is null or has no letter. Ties go to the language that sorts first. Null ids and
    repeated rows stay; other columns are not read; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_rows(rows, lambda: lambda row: (row[0], *model.predict(row[1])), f"doc_id {kind}, lang_pred string, score double", 4096)


def annotated(docs: DataFrame, model: Model, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "lang_score") -> DataFrame:
    """The rows of docs, all columns, with the predicted language and its score as two more; cases as for predict()."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("struct<lang string, score double>")
    def f(texts: pa.Array) -> pa.Array:
        found = [model.predict(t.as_py()) for t in texts]
        return pa.StructArray.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["lang", "score"])

    small_batches(docs.sparkSession)
    both = docs.withColumn("_lang_of_text", f.asNondeterministic()(F.col(text_col)))  # else a filter on it would have it computed twice
    return both.withColumn(lang_out, F.col("_lang_of_text.lang")).withColumn(score_out, F.col("_lang_of_text.score")).drop("_lang_of_text")
