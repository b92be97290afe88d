"""Secrets in text, with DataFrame functions only.

Fixed forms are found by regular expressions. Beyond them, tokens of 12 characters or more are compared under two first-order Markov models
of characters, one of random strings and one of ordinary identifiers, both trained from labelled samples; a token whose
log-likelihood ratio speaks for the random strings is reported too.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches

# The forms. Runs are matched whole, so a lower bound in the pattern drops just the matches that fall short.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: Tokens that the models judge: all of LEAST_SECRET characters or more with a letter (numbers, dates and rules have none).
TOKEN = r"(?<![A-Za-z0-9+/_=-])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{12,}"
#: Letters in lower case, the first perhaps not: the shape of words, which are far more common than secrets of that shape.
WORD_SHAPE = r"\A[A-Za-z][a-z]+\z"
KINDS = ("assign", "access", "hex", "markov")
LEAST_SECRET = 12

# Words that identifiers, paths and prose are made of, the labelled sample of ordinary strings.
WORDS = (
    "the and for with that this from have which their would about there other value index count total first last next state table column row file path name node user group order item list map set get put add remove delete update insert select where "
    "create build parse read write open close start stop begin end left right upper lower size length width height time date year month day hour minute second version number string integer float double boolean object array vector matrix function "
    "method class module package import export return config option default error warning message status request response server client http https www example com org net html json xml test data model train batch layer input output source target "
    "und der die das nicht eine mit auf werden zeit schicht haus les des une dans pour avec est pas temps maison los las una para como tiempo casa mente"
).split()
SMOOTH = 0.5
_ARRAY = "array<struct<start:int,rank:int,end:int>>"


def samples(spark: SparkSession, random_rows: int = 1500) -> DataFrame:
    """(label, s): 1 for random strings in the usual encodings, 0 for ordinary identifiers built from WORDS."""
    words = F.array(*[F.lit(w) for w in WORDS])
    n = len(WORDS)
    ids = spark.range(random_rows)
    digest = F.sha2(F.col("id").cast("string"), 256)
    raw = F.base64(F.unhex(F.concat(digest, F.sha2(F.concat(F.lit("x"), F.col("id").cast("string")), 256))))
    rand = ids.select(F.explode(F.array(F.substring(raw, 1, 40), F.translate(F.substring(raw, 3, 40), "+/=", "-_a"), F.regexp_replace(raw, "[^A-Za-z0-9]", ""), digest)).alias("s"))
    w = lambda k: F.element_at(words, (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(n)) + 1).cast("int"))
    number = F.pmod(F.xxhash64("id", F.lit(9)), F.lit(2100)).cast("string")
    plain = ids.select(F.explode(F.array(
        F.concat_ws("_", w(1), w(2), w(3)), F.concat(w(1), F.initcap(w(2)), F.initcap(w(3)), F.initcap(w(4))), F.concat_ws("/", w(2), w(4), w(1), w(3)),
        F.concat_ws("-", w(3), w(1), number, w(2)), F.upper(F.concat_ws("_", w(4), w(2), w(1))), F.concat(w(1), w(3), w(2), number), F.concat_ws("-", number, number, w(4), number),
    )).alias("s"))
    return rand.select(F.lit(1).alias("label"), "s").unionAll(plain.select(F.lit(0).alias("label"), "s"))


def train(spark: SparkSession) -> list[float]:
    """Log ratios of the two models' transition chances, at 128 * first character + second. Bounded: 128 x 128 numbers."""
    chars = F.split("s", "")
    pairs = samples(spark).select("label", F.explode(F.arrays_zip(F.slice(chars, 1, F.size(chars) - 1).alias("a"), F.slice(chars, 2, F.size(chars) - 1).alias("b"))).alias("p"))
    counts = pairs.groupBy("label", F.ascii("p.a").alias("a"), F.ascii("p.b").alias("b")).count().collect()
    n: dict[tuple[int, int], dict[int, float]] = {}
    for r in counts:
        n.setdefault((r["label"], r["a"]), {})[r["b"]] = r["count"]
    out = []
    alphabet = 66
    for a in range(128):
        rows = [n.get((label, a), {}) for label in (0, 1)]
        sums = [sum(r.values()) + SMOOTH * alphabet for r in rows]
        out += [math.log((rows[1].get(b, 0) + SMOOTH) / sums[1]) - math.log((rows[0].get(b, 0) + SMOOTH) / sums[0]) for b in range(128)]
    return out


def log_ratio(token: Column, table: Column) -> Column:
    """Sum of the log ratios of the token's transitions; tokens are ASCII."""
    codes = F.transform(F.split(token, ""), lambda c: F.ascii(c))
    pairs = F.zip_with(F.slice(codes, 1, F.size(codes) - 1), F.slice(codes, 2, F.size(codes) - 1), lambda a, b: F.element_at(table, a * 128 + b + 1))
    return F.aggregate(pairs, F.lit(0.0), lambda x, y: x + y)


def least_ratio(token: Column, threshold: float) -> Column:
    """The log ratio from which a token is reported: threshold from 20 characters on, more for shorter ones and for words.

    Short tokens are many and their ratio rests on few transitions.
    """
    short = F.greatest(F.lit(0), F.lit(20) - F.length(token)) * 1.6
    return F.lit(threshold) + short + F.when(token.rlike(WORD_SHAPE), 8.0).otherwise(0.0)


def _starts(gaps: Column, matches: Column, rank: int, block: int = 256) -> Column:
    """Spans of the matches, from the texts before each of them; lengths are in code points.

    Lengths are added up in blocks, and the blocks' own lengths after that, so that no step copies a long array.
    """
    pieces = F.zip_with(F.slice(gaps, 1, F.size(matches)), matches, lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("m")))
    zero = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {_ARRAY})").alias("out"))

    def within(some: Column) -> Column:
        return F.aggregate(
            some,
            zero,
            lambda acc, p: F.struct(
                (acc["at"] + p["g"] + p["m"]).alias("at"),
                F.concat(acc["out"], F.array(F.struct((acc["at"] + p["g"]).alias("start"), F.lit(rank).alias("rank"), (acc["at"] + p["g"] + p["m"]).alias("end")))).alias("out"),
            ),
        )

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(matches) - 1) / block).cast("int")), lambda i: within(F.slice(pieces, i * block + 1, block)))
    moved = lambda spans, by: F.transform(spans, lambda s: F.struct((s["start"] + by).alias("start"), s["rank"].alias("rank"), (s["end"] + by).alias("end")))

    def offsets(parts: Column) -> Column:
        """How much text comes before each block."""
        start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
        step = lambda acc, b: F.struct((acc["at"] + b["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(parts, start, step, lambda acc: acc["out"])

    whole = lambda parts: F.flatten(F.zip_with(parts, offsets(parts), lambda b, by: moved(b["out"], by)))
    return F.when(F.size(matches) <= block, within(pieces)["out"]).otherwise(whole(blocks))


def _found(df: DataFrame, name: str, pattern: str, rank: int) -> DataFrame:
    """Adds the matches of pattern in _text as _m_name and their spans as name."""
    none = F.expr(f"cast(array() as {_ARRAY})")
    df = df.withColumn(f"_m_{name}", F.regexp_extract_all("_text", F.lit(pattern), F.lit(0)))
    gaps = F.split(F.col("_text"), pattern, -1)
    return df.withColumn(name, F.when(F.size(f"_m_{name}") > 0, _starts(gaps, F.col(f"_m_{name}"), rank)).otherwise(none))


def _scanned(docs: DataFrame, threshold: float, text_col: str) -> DataFrame:
    """(_row, _spans): each row whole, as a struct, so that no column of its own meets one of the scan's; and its spans."""
    small_batches(docs.sparkSession)
    table = F.split(F.lit(",".join(map(repr, train(docs.sparkSession)))), ",").cast("array<double>")  # one literal, once folded
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"))
    df = _found(df, "_assign", ASSIGN, 0)
    secret = F.transform("_m__assign", lambda m: F.length(F.regexp_extract(m, ASSIGN, 1)))
    df = df.withColumn("_assign", F.transform(F.filter(F.arrays_zip(F.col("_assign").alias("s"), secret.alias("n")), lambda x: x["n"] >= LEAST_SECRET), lambda x: x["s"]))
    df = _found(df, "_access", ACCESS, 1)
    df = _found(df, "_hex", HEX, 2)
    df = df.withColumn("_base", F.concat("_assign", "_access", "_hex"))
    df = _found(df, "_markov", TOKEN, 3)
    judged = F.filter(
        F.arrays_zip(F.col("_markov").alias("s"), F.col("_m__markov").alias("m")),
        lambda x: ~F.exists("_base", lambda b: (b["start"] < x["s"]["end"]) & (x["s"]["start"] < b["end"])) & (log_ratio(x["m"], table) >= least_ratio(x["m"], threshold)),
    )
    df = df.withColumn("_markov", F.when(F.size("_markov") > 0, F.transform(judged, lambda x: x["s"])).otherwise(F.col("_markov")))
    return df.select("_row", F.array_sort(F.concat("_base", "_markov")).alias("_spans"))


def spans(docs: DataFrame, threshold: float = 12.0, text_col: str = "text", out: str = "secret_spans") -> DataFrame:
    """docs with one more column, named by ``out``: array of (start, rank, end) by start and rank; rank is the place in KINDS.

    start and end are code points, end exclusive. Null and empty texts have none. Matches of one kind never overlap;
    the models' spans are those that no fixed form overlaps. Other columns, of whatever name, are kept as they are.
    """
    return _scanned(docs, threshold, text_col).select("_row.*", F.col("_spans").alias(out))


def as_text(found: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"] + 1), s["start"], s["end"])), ",")


def report(docs: DataFrame, threshold: float = 12.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans) for each row; cases as for spans()."""
    df = spans(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), threshold)
    of = lambda k: F.size(F.filter("secret_spans", lambda s: s["rank"] == k)).cast("long")
    base = F.filter("secret_spans", lambda s: s["rank"] < 3)
    return df.select(
        "doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"), of(3).alias("n_markov"),
        F.sha2(as_text(base), 256).alias("base_sha256"), as_text(F.col("secret_spans")).alias("spans"),
    )


def redacted(docs: DataFrame, mark: str = "[SECRET]", threshold: float = 12.0, text_col: str = "text") -> DataFrame:
    """docs with each span of a secret replaced by mark in the text; overlapping spans become one; null texts stay null."""
    df = _scanned(docs, threshold, text_col)
    text = F.col(f"_row.`{text_col}`")
    one = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))
    # Spans that overlap made one, from which the texts between them follow.
    merged = F.aggregate(
        "_spans",
        F.struct(F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("done"), F.struct(F.lit(-1).alias("start"), F.lit(0).alias("end")).alias("last")),
        lambda acc, s: F.when(s["start"] < acc["last"]["end"], F.struct(acc["done"].alias("done"), F.struct(acc["last"]["start"].alias("start"), F.greatest(acc["last"]["end"], s["end"]).alias("end")).alias("last"))).otherwise(
            F.struct(F.concat(acc["done"], F.array(acc["last"])).alias("done"), one(s).alias("last"))
        ),
        lambda acc: F.concat(acc["done"], F.array(acc["last"])),
    )
    pieces = lambda m: F.zip_with(m, F.slice(m, 2, F.size(m)), lambda a, b: F.substring(text, a["end"] + 1, F.coalesce(b["start"] - a["end"], F.length(text))))
    changed = F.when(F.size("_spans") > 0, F.array_join(pieces(F.col("_merged")), mark)).otherwise(text)
    df = df.withColumn("_merged", merged)
    return df.select(*[changed.alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
