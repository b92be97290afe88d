"""Bitemporal version history: effective dates, as-of states, intervals, folder states and lifetimes.

``versions`` has a key, a store order ``seq`` (greater is newer), a store time and a deletion mark; ``dates`` declares
other times for single versions. The effective date is the declared one, else the store time cut to the second.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.adapters import NTZ, store_second

from .dedupe import line_number
from .shared import saved


def effective(versions: DataFrame, dates: DataFrame | None = None) -> DataFrame:
    """versions with eff. Without dates, store time alone counts (bulk listings ignore declared times)."""
    stored = store_second(F.col("last_modified"))
    if dates is None:
        return versions.withColumn("eff", stored)
    return versions.join(dates, ["key", "seq"], "left").withColumn("eff", F.coalesce("at", stored)).drop("at")


def newest(rows: DataFrame, keys: list[str], order: list[Column], keep: list[str]) -> DataFrame:
    """Per key the row that is greatest by order: one shuffle, of one partial maximum for each key and task."""
    top = F.max(F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], *[F.col(c) for c in keep if c not in keys])).alias("_top")
    return rows.groupBy(*keys).agg(top).select(*keys, *[F.col(f"_top.{c}").alias(c) for c in keep if c not in keys])


def as_of(dated: DataFrame, at: str | Column) -> DataFrame:
    """The version of each key at a moment: greatest eff up to it, the newest stored of ties; a deletion means none."""
    at = F.lit(at).cast(NTZ) if isinstance(at, str) else at
    keep = [c for c in dated.columns]
    return newest(dated.where(F.col("eff") <= at), ["key"], [F.col("eff"), F.col("seq")], keep).where("not deleted")


def as_of_many(dated: DataFrame, moments: list[str]) -> DataFrame:
    """(at, ...) for several moments: each version is repeated for the moments from its date on; then as as_of()."""
    times = F.array(*[F.lit(m).cast(NTZ) for m in moments])
    rows = dated.withColumn("at", F.explode(F.filter(times, lambda t: t >= F.col("eff"))))
    return newest(rows, ["at", "key"], [F.col("eff"), F.col("seq")], rows.columns).where("not deleted")


def as_of_join(left: DataFrame, dated: DataFrame) -> DataFrame:
    """Rows of left (id, key, at) with the key's version at each row's own moment; rows without one are kept.

    Both sides are merged in one ordered stream for each key and the newest version so far is carried along: a window
    over the union, where an inequality join would pair each row with all earlier versions.
    """
    cols = [F.col("seq"), F.col("size"), F.col("deleted"), F.col("eff")]
    both = left.select("id", "key", F.col("at").alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast("long").alias("_seq"), F.lit(None).cast(dated.select(F.struct(*cols)).schema[0].dataType).alias("_v")).unionAll(
        dated.select(F.lit(None).cast(left.schema["id"].dataType), "key", "eff", F.lit(0), "seq", F.struct(*cols))
    )
    w = Window.partitionBy("key").orderBy("_t", "_side", "_seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    got = both.withColumn("_v", F.last("_v", True).over(w)).where("_side = 1")
    live = ~F.coalesce(F.col("_v.deleted"), F.lit(True))
    return got.select("id", "key", F.col("_t").alias("at"), F.when(live, F.col("_v.seq")).alias("seq"), F.when(live, F.col("_v.size")).alias("size"))


def version_list(dated: DataFrame) -> DataFrame:
    """Live versions with their rank (newest effective first, then newest stored) and the mark of the current one.

    Current is the newest stored entry, if that isn't a deletion, whatever its date.
    """
    w = Window.partitionBy("key")
    rows = dated.withColumn("current", (F.col("seq") == F.max("seq").over(w)) & ~F.col("deleted")).where("not deleted")
    return rows.withColumn("rank", F.row_number().over(w.orderBy(F.desc("eff"), F.desc("seq"))))


def intervals(dated: DataFrame) -> DataFrame:
    """[eff, until) of each entry: until is the date of the next one by (eff, seq); null for the last."""
    w = Window.partitionBy("key").orderBy("eff", "seq")
    return dated.withColumn("until", F.lead("eff").over(w))


def named_versions(dated: DataFrame, names: list[tuple[str, str]], now: str) -> DataFrame:
    """(key, seq, names): the named moments within each live version's interval; the last interval ends an hour after now.

    Names are few and known when the query is planned, so they are matched in place, without a join.
    """
    moments = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(t).cast(NTZ).alias("at")) for n, t in names])
    end = F.coalesce("until", F.lit(now).cast(NTZ) + F.expr("interval 1 hour"))
    rows = intervals(dated).where("not deleted").withColumn("_end", end.cast(NTZ))
    inside = F.filter(moments, lambda m: (m["at"] >= F.col("eff")) & (m["at"] < F.col("_end")))
    return rows.withColumn("names", F.array_sort(F.transform(inside, lambda m: m["name"]))).where(F.size("names") > 0)


def not_states(dated: DataFrame) -> DataFrame:
    """(key, seq, state): 'shadowed' or 'late' for live versions that are no states of their key.

    Shadowed: a version stored later, which isn't late, has the same date. Late: not shadowed, and dated before a version
    stored earlier that isn't shadowed. Starting from none late, each round can only find more late ones, so the rounds
    end: when one finds no more. All keys go through a round together, in two windows over the same partitions.
    """
    rows = dated.where("not deleted").select("key", "seq", "eff", F.lit(False).alias("late"))
    after = Window.partitionBy("key", "eff").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    while True:
        seen = rows.repartition("key").withColumn("shadowed", F.coalesce(F.max((~F.col("late")).cast("int")).over(after) == 1, F.lit(False)))
        top = F.max(F.when(~F.col("shadowed"), F.col("eff"))).over(before)
        found = seen.withColumn("now", ~F.col("shadowed") & F.coalesce(F.col("eff") < top, F.lit(False)))
        found = saved(found, "not-states")
        if found.where("now <> late").isEmpty():
            break
        rows = found.select("key", "seq", "eff", F.col("now").alias("late"))
    return found.where("shadowed or late").select("key", "seq", F.when(F.col("shadowed"), "shadowed").otherwise("late").alias("state"))


def written_behind(dated: DataFrame) -> DataFrame:
    """(key): keys with a late version."""
    return not_states(dated).where("state = 'late'").select("key").distinct()


def lifetimes(changes: DataFrame) -> DataFrame:
    """(dir, name, item, from_at, to_at) from entry changes (dir, name, item, at, present, seq).

    A name holds its newest item until the next change of that name; the same item again goes on with the lifetime.
    """
    w = Window.partitionBy("dir", "name").orderBy("at", "seq")
    last_of_moment = F.row_number().over(Window.partitionBy("dir", "name", "at").orderBy(F.desc("seq"))) == 1
    rows = changes.withColumn("_last", last_of_moment).where("_last")
    held = F.when(F.col("present"), F.col("item"))
    rows = rows.withColumn("_held", held).withColumn("_was", F.lag("_held").over(w))
    starts = rows.where(~F.col("_held").eqNullSafe(F.col("_was"))).withColumn("to_at", F.lead("at").over(w))
    return starts.where("_held is not null").select("dir", "name", F.col("_held").alias("item"), F.col("at").alias("from_at"), "to_at")


def entries_at(spans: DataFrame, at: str) -> DataFrame:
    """Lifetimes that cover a moment."""
    t = F.lit(at).cast(NTZ)
    return spans.where((F.col("from_at") <= t) & (F.col("to_at").isNull() | (F.col("to_at") > t)))


FAR = "9999-12-31 00:00:00"


def _far() -> Column:
    return F.lit(FAR).cast(NTZ)


def _free(taken: DataFrame, keys: list[str], low: str, high: str) -> DataFrame:
    """(keys, low, high, f, t): what spans [f, t) leave free of [low, high); keys name one such range each.

    taken has a row for each span that meets its range, clipped or not, and one with f = t = high for each range. The
    gaps lie between the running ends of the spans.
    """
    w = Window.partitionBy(*keys).orderBy("f", "t").rowsBetween(Window.unboundedPreceding, -1)
    rows = taken.withColumn("_start", F.greatest(F.coalesce(F.max("t").over(w), F.col(low)), F.col(low))).withColumn("_end", F.least("f", high))
    return rows.where(F.col("_start") < F.col("_end")).select(*keys, F.col("_start").alias("f"), F.col("_end").alias("t"))


def cut_out(spans: DataFrame, removals: DataFrame) -> DataFrame:
    """Lifetimes less removals [at, until), any number for a (dir, name, item): what lies beside them stays."""
    keys = ["dir", "name", "item", "from_at", "high"]
    rows = spans.select("dir", "name", "item", "from_at", F.coalesce("to_at", _far()).alias("high"))
    cuts = removals.where("at < until").select("dir", "name", "item", F.col("at").alias("f"), F.col("until").alias("t"))
    met = rows.join(cuts, ["dir", "name", "item"]).where((F.col("f") < F.col("high")) & (F.col("from_at") < F.col("t")))
    ends = rows.withColumn("f", F.col("high")).withColumn("t", F.col("high"))
    left = _free(met.unionByName(ends), keys, "from_at", "high")
    return left.select("dir", "name", "item", F.col("f").alias("from_at"), F.when(F.col("t") < _far(), F.col("t")).alias("to_at"))


def fill_in(spans: DataFrame, additions: DataFrame) -> DataFrame:
    """Lifetimes with additions (dir, name, item, at, until), any number for a name, where no lifetime covers them.

    An occupant keeps its place; adding again what is there adds nothing. Additions come in the order of (at, seq), seq
    being a column of theirs or else the item; the first takes what is free, so each gets what lies past the ends of all
    before it. Then the lifetimes' parts go. One that doesn't end after it begins is none.
    """
    order = F.col("seq") if "seq" in additions.columns else F.col("item")
    w = Window.partitionBy("dir", "name").orderBy("at", order).rowsBetween(Window.unboundedPreceding, -1)
    own = additions.where("at < until").withColumn("low", F.greatest("at", F.coalesce(F.max("until").over(w), F.col("at"))))
    own = own.where("low < until").select("dir", "name", F.col("item").alias("new_item"), "low", F.col("until").alias("high"))
    met = spans.select("dir", "name", F.col("from_at").alias("f"), F.coalesce("to_at", _far()).alias("t")).join(own, ["dir", "name"])
    met = met.where((F.col("f") < F.col("high")) & (F.col("low") < F.col("t")))
    ends = own.withColumn("f", F.col("high")).withColumn("t", F.col("high"))
    added = _free(met.unionByName(ends), ["dir", "name", "new_item", "low", "high"], "low", "high")
    return spans.select("dir", "name", "item", "from_at", "to_at").unionAll(added.select("dir", "name", F.col("new_item").alias("item"), F.col("f").alias("from_at"), F.col("t").alias("to_at")))


def settle(spans: DataFrame, changes: DataFrame) -> DataFrame:
    """Lifetimes after late changes (dir, name, item, at, until, add, seq) of any kinds, in the order of (at, seq).

    Where a name has additions and removals both, each acts on what those before it left, so the name's changes are
    numbered and played in rounds, the n-th of every name together. Names with changes of one kind take one round.
    """
    mixed = changes.groupBy("dir", "name").agg((F.count_distinct("add") > 1).alias("mixed"))
    w = Window.partitionBy("dir", "name").orderBy("at", "seq")
    numbered = changes.join(mixed, ["dir", "name"]).withColumn("round", F.when(F.col("mixed"), F.row_number().over(w)).otherwise(1))
    numbered = saved(numbered, "settle")
    last = numbered.agg(F.max("round")).first()[0] or 0
    now = spans.select("dir", "name", "item", "from_at", "to_at")
    for n in range(1, last + 1):
        some = numbered.where(F.col("round") == n)
        now = saved(fill_in(cut_out(now, some.where("not add")), some.where("add")), "settle")
    return now


def folder_states(spans: DataFrame) -> DataFrame:
    """(dir, at, n, total): a state at each moment when a folder's entries change.

    Lifetimes become marks, +1 and -1, summed up by moment first; a state is their running sum: how many entries there
    are, and the sum of the entries' numbers, the same for any order of them. States like the one before are none. No
    folder is gathered: its marks pass one by one.
    """
    mark = lambda t, d: F.struct(F.col(t).alias("at"), F.lit(d).alias("d"))
    number = line_number(F.concat_ws("/", F.col("name").cast("string"), F.col("item").cast("string")))
    marks = spans.select("dir", number.alias("x"), F.explode(F.filter(F.array(mark("from_at", 1), mark("to_at", -1)), lambda m: m["at"].isNotNull())).alias("m"))
    steps = marks.groupBy("dir", F.col("m.at").alias("at")).agg(F.sum("m.d").alias("d"), F.sum(F.col("m.d") * F.col("x")).cast("decimal(38,0)").alias("x"))
    w = Window.partitionBy("dir").orderBy("at")
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    states = steps.select("dir", "at", F.sum("d").over(so_far).alias("n"), F.sum("x").over(so_far).cast("decimal(38,0)").cast("string").alias("total"))
    was = F.lag(F.struct("n", "total")).over(w)
    return states.withColumn("_was", was).where(~F.col("_was").eqNullSafe(F.struct("n", "total"))).drop("_was")


def settle_proof(before: DataFrame, after: DataFrame, additions: DataFrame) -> DataFrame:
    """(dir, states, holds): whether every state after a settle is the one before with the covering additions replayed.

    before and after are lifetimes, additions (dir, name, item, at, until, seq). An addition takes a name that is free at
    that moment; of several the first in order of (at, seq). Each folder is an ordered fold of its own, so one folder has
    to fit a task. The last state is the present one: it holds all that is open and, where none covers it, nothing else.
    """

    def held(rows, t):
        return {r.name: r.item for r in rows if r.from_at <= t and (r.to_at is None or r.to_at > t)}

    def prove(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        clean = pdf.astype(object).where(pdf.notna(), None)
        part = {side: list(rows.itertuples(index=False)) for side, rows in clean.groupby("side")}
        old, new, adds = (part.get(k, []) for k in (0, 1, 2))
        adds.sort(key=lambda r: (r.from_at, r.seq))
        moments = sorted({t for r in [*old, *new, *adds] for t in (r.from_at, r.to_at) if t is not None})
        holds = True
        for t in moments:
            want = held(old, t)
            for a in adds:
                if a.from_at <= t < a.to_at:
                    want.setdefault(a.name, a.item)
            holds = holds and held(new, t) == want
        return pd.DataFrame({"dir": [key[0]], "states": [len(moments)], "holds": [holds]})

    side = lambda df, n, f, t, seq: df.select("dir", "name", "item", F.col(f).alias("from_at"), F.col(t).alias("to_at"), F.lit(n).alias("side"), seq.alias("seq"))
    zero = F.lit(0).cast("long")
    rows = side(before, 0, "from_at", "to_at", zero).unionAll(side(after, 1, "from_at", "to_at", zero)).unionAll(side(additions, 2, "at", "until", F.col("seq")))
    kind = rows.schema["dir"].dataType.simpleString()
    return rows.groupBy("dir").applyInPandas(prove, f"dir {kind}, states long, holds boolean")
