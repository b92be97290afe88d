"""Byte ranges and locks: overlap joins, unions, subtraction, merging of own claims.

A whole-file claim ends at EOF, which counts as greater than every other end.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Fixed value: the end of a range that goes on to the end of the file, the least 64-bit integer; ends compare unsigned.
EOF = -(1 << 63)
TOP = (1 << 63) - 1


def closed(df: DataFrame, *ends: str) -> DataFrame:
    """df with ends beyond the signed 64-bit numbers, EOF among them, put at the greatest one, so that they compare as they should."""
    for name in ends or ("end",):
        df = df.withColumn(name, F.when(F.col(name) < 0, F.lit(TOP)).otherwise(F.col(name)))
    return df


def opened(end: Column) -> Column:
    """The reverse of closed()."""
    return F.when(end == TOP, F.lit(EOF)).otherwise(end)


def overlap(a: str, b: str) -> Column:
    """Whether two ranges with closed() ends overlap."""
    return (F.col(f"{a}.start") < F.col(f"{b}.end")) & (F.col(f"{b}.start") < F.col(f"{a}.end"))


def live(claims: DataFrame, now_ms: int) -> DataFrame:
    return claims.where(F.col("expires_at_ms") > now_ms)


def overlapping(left: DataFrame, right: DataFrame) -> DataFrame:
    """(l, r): every two rows of the same file whose ranges overlap, each pair once, as structs; ends closed().

    A range has a level, the number of binary digits of its length, and touches two bins of that level's width at most.
    Of two ranges that overlap, the one of the higher level (l of equal ones) lies in its own bins and the other one in
    bins of that level; the first bin that both touch counts. So a range has at most two rows for each level that
    there is, however long it is, and the join hashes on file, level and bin.
    """
    digits = F.length(F.bin(F.greatest(F.col("end") - F.col("start") - 1, F.lit(0))))
    with_level = lambda df, name: closed(df).withColumn("level", digits).select("file", "level", F.greatest(F.col("end") - 1, "start").alias("last"), "start", F.struct(*df.columns).alias(name))
    l, r = with_level(left, "l"), with_level(right, "r")
    found = sorted(x[0] for x in l.select("level").unionAll(r.select("level")).distinct().collect())  # 64 at most
    bins = F.explode(F.expr("sequence(shiftright(start, at), shiftright(last, at))")).alias("bin")
    own = lambda df, name: df.withColumn("at", F.col("level")).select("file", "at", bins, name)
    levels = F.array(*[F.lit(x) for x in found]).cast("array<int>")
    every = lambda df, name, also: df.withColumn("at", F.explode(F.filter(levels, lambda x: (x >= F.col("level")) if also else (x > F.col("level"))))).select("file", "at", bins, name)
    pairs = own(l, "l").join(every(r, "r", True), ["file", "at", "bin"]).select("at", "bin", "l", "r")
    pairs = pairs.unionAll(own(r, "r").join(every(l, "l", False), ["file", "at", "bin"]).select("at", "bin", "l", "r"))
    first = F.greatest(F.expr("shiftright(l.start, at)"), F.expr("shiftright(r.start, at)"))
    return pairs.where(overlap("l", "r") & (F.col("bin") == first)).select("l", "r")


def conflicts(claims: DataFrame, now_ms: int) -> DataFrame:
    """(file, a, b) with a < b: overlapping unexpired claims of different holders, not both shared, none escalation-only."""
    rows = live(claims, now_ms).where("not escalation_only").select("file", "id", "holder", "start", "end", "shared")
    hit = (F.col("l.id") < F.col("r.id")) & (F.col("l.holder") != F.col("r.holder")) & ~(F.col("l.shared") & F.col("r.shared"))
    return overlapping(rows, rows).where(hit).select(F.col("l.file").alias("file"), F.col("l.id").alias("a"), F.col("r.id").alias("b"))


def blocked_writes(writes: DataFrame, claims: DataFrame, now_ms: int) -> DataFrame:
    """Writes (file, id, holder, start, end) that overlap an unexpired claim of another holder; shared claims block too."""
    c = live(claims, now_ms).where("not escalation_only").select("file", "holder", "start", "end")
    return overlapping(writes, c).where("l.holder <> r.holder").select("l.file", "l.id").distinct()


def acquired(requests: DataFrame, claims: DataFrame, now_ms: int) -> DataFrame:
    """(file, id, outcome) of requests for claims (file, id, holder, start, end, shared), each met with the claims that hold now.

    refused: an unexpired claim of another holder overlaps and they aren't both shared; renewed: the holder has that very
    range already; else granted. Expired claims count for nothing, escalation-only ones only against their like.
    """
    held = live(claims, now_ms).where("not escalation_only").select("file", "holder", "start", "end", "shared")
    met = overlapping(requests.select("file", "id", "holder", "start", "end", "shared"), held)
    other = (F.col("l.holder") != F.col("r.holder")) & ~(F.col("l.shared") & F.col("r.shared"))
    same = (F.col("l.holder") == F.col("r.holder")) & (F.col("l.start") == F.col("r.start")) & (F.col("l.end") == F.col("r.end")) & (F.col("l.shared") == F.col("r.shared"))
    found = met.groupBy(F.col("l.file").alias("file"), F.col("l.id").alias("id")).agg(F.max(other).alias("other"), F.max(same).alias("same"))
    outcome = F.when(F.col("other"), "refused").when(F.col("same"), "renewed").otherwise("granted")
    return requests.join(found, ["file", "id"], "left").select("file", "id", outcome.alias("outcome"))


def union(ranges: DataFrame, touching: bool = True) -> DataFrame:
    """(file, start, end): ranges that overlap, or touch, made one; a new island begins past the greatest end so far."""
    w = Window.partitionBy("file").orderBy("start", "end")
    top = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.col("start") > top if touching else F.col("start") >= top
    rows = ranges.withColumn("_new", F.coalesce(apart.cast("int"), F.lit(1))).withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("file", "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def span(ranges: DataFrame) -> DataFrame:
    return ranges.groupBy("file").agg(F.min("start").alias("lo"), F.max("end").alias("hi"))


def unlocked(claims: DataFrame, releases: DataFrame, now_ms: int) -> DataFrame:
    """Claims less a release (file, holder, r_start, r_end) of their holder; expired claims of anyone go too."""
    rows = closed(live(claims, now_ms)).join(closed(releases, "r_end"), ["file", "holder"], "left")
    hit = F.col("r_start").isNotNull() & ~F.col("escalation_only") & (F.col("start") < F.col("r_end")) & (F.col("r_start") < F.col("end"))
    piece = lambda a, b: F.struct(a.alias("s"), b.alias("e"))
    whole = F.array(piece(F.col("start"), F.col("end")))
    cut = F.filter(F.array(piece(F.col("start"), F.col("r_start")), piece(F.col("r_end"), F.col("end"))), lambda p: p["s"] < p["e"])
    return rows.withColumn("_p", F.explode(F.when(hit, cut).otherwise(whole))).select("file", "id", "holder", F.col("_p.s").alias("start"), opened(F.col("_p.e")).alias("end"))


Claim = tuple[int, int, bool]


def taken(held: list[Claim], start: int, end: int, shared: bool) -> list[Claim]:
    """One holder's claims, in order of place and apart from each other, after it takes [start, end).

    The claims that the new one overlaps lie side by side. Those of its kind become one with it; of the others what it
    leaves free stays. Claims that only touch it stay as they are. Ends are positive numbers.
    """
    first = bisect.bisect_right(held, start, key=lambda c: c[1])
    after = bisect.bisect_left(held, end, key=lambda c: c[0])
    met = held[first:after]
    alike = [c for c in met if c[2] == shared]
    left = [(a, start, kind) for a, _, kind in met[:1] if kind != shared and a < start]
    right = [(end, b, kind) for _, b, kind in met[-1:] if kind != shared and end < b]
    one = (min([start, *(c[0] for c in alike)]), max([end, *(c[1] for c in alike)]), shared)
    return [*held[:first], *left, one, *right, *held[after:]]


def merged_claims(claims: DataFrame) -> DataFrame:
    """(file, holder, start, end, shared): each holder's claims on a file, taken in the order of id.

    Rows pass sorted by file, holder and id; what is held is the claims that one holder has on one file, not all it made.
    """
    schema = pa.schema([("file", pa.int64()), ("holder", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("shared", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, [], []
        for batch in batches:
            for file, holder, _, start, end, shared in zip(*(c.to_pylist() for c in batch.columns)):
                if (file, holder) != key:
                    out += [(*key, *c) for c in held] if key else []
                    key, held = (file, holder), []
                held = taken(held, start, end, shared)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*((*key, *c) for c in held)), schema)], schema=schema)

    rows = closed(claims).select(*[F.col(c).cast("long") for c in ("file", "holder", "id", "start", "end")], "shared")
    rows = rows.repartition("file", "holder").sortWithinPartitions("file", "holder", "id")
    return rows.mapInArrow(run, "file long, holder long, start long, end long, shared boolean").withColumn("end", opened(F.col("end")))


def within_budget(spans: list[tuple[int, int]], most: int) -> list[tuple[int, int]]:
    """Ranges joined across their smallest gaps until at most ``most`` are left; the first of equal gaps goes first."""
    spans = sorted(spans)
    gaps = sorted(range(len(spans) - 1), key=lambda i: (spans[i + 1][0] - spans[i][1], i))[: max(0, len(spans) - most)]
    closed, out = set(gaps), []
    for i, (a, b) in enumerate(spans):
        if i and i - 1 in closed:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def budgeted(ranges: DataFrame, most: int) -> DataFrame:
    """(file, start, end): at most ``most`` ranges for each file. Native: the gaps are ranked and the least ones closed."""
    w = Window.partitionBy("file")
    rows = union(ranges).withColumn("gap", F.col("start") - F.lag("end").over(w.orderBy("start"))).withColumn("n", F.count("*").over(w))
    rows = rows.withColumn("r", F.when(F.col("gap").isNotNull(), F.row_number().over(w.orderBy(F.col("gap").asc_nulls_last(), "start"))))
    rows = rows.withColumn("_new", F.when(F.col("r") <= F.col("n") - most, 0).otherwise(1)).withColumn("_i", F.sum("_new").over(w.orderBy("start").rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("file", "_i").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_i")
