"""Duplicate content: groups, canonical copies, reports, ranking and content maps.

Records: (idx, item, path, version, date, sha256, size, stub, referrers, current); idx is the listing order.
Same content means equal (sha256, size); stubs are no candidates.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONTENT = ["sha256", "size"]


def best_first() -> list[Column]:
    """Most referrers, then oldest; of equals the smaller path, the later listed of one item, the smaller version."""
    return [F.desc("referrers"), F.asc("date"), F.asc("path"), F.asc("item"), F.desc("idx"), F.asc("version")]


def _key() -> Column:
    """A struct that is smallest for the canonical record, so that partial minima find it."""
    return F.struct((-F.col("referrers")).alias("a"), F.col("date").alias("b"), F.col("path").alias("c"), F.col("item").alias("d"), (-F.col("idx")).alias("e"), F.col("version").alias("f"))


def groups(records: DataFrame) -> DataFrame:
    """(sha256, size, canonical, copies, reclaimable) of each content with two copies or more."""
    real = records.where("not stub")
    g = real.groupBy(*CONTENT).agg(F.count("*").alias("copies"), F.min_by("idx", _key()).alias("canonical")).where("copies > 1")
    return g.select(*CONTENT, "canonical", "copies", ((F.col("copies") - 1) * F.col("size")).alias("reclaimable"))


def duplicates(records: DataFrame) -> DataFrame:
    """(idx, canonical) of each record that its group's canonical copy can stand in for."""
    return records.where("not stub").join(groups(records), CONTENT).where("idx <> canonical").select("idx", "canonical")


def report(records: DataFrame, least_size: int = 0) -> DataFrame:
    """(mode, versions, stubs, groups, duplicates, reclaimable, below_min), for current versions and for all history."""
    modes = records.withColumn("mode", F.explode(F.when(F.col("current"), F.array(F.lit("current"), F.lit("history"))).otherwise(F.array(F.lit("history")))))
    tally = modes.groupBy("mode").agg(
        F.sum(F.when(~F.col("stub"), 1).otherwise(0)).alias("versions"), F.sum(F.when(F.col("stub"), 1).otherwise(0)).alias("stubs"),
        F.sum(F.when(~F.col("stub") & (F.col("size") < least_size), 1).otherwise(0)).alias("below_min"),
    )
    per = modes.where((~F.col("stub")) & (F.col("size") >= least_size)).groupBy("mode", *CONTENT).agg(F.count("*").alias("n")).where("n > 1")
    sums = per.groupBy("mode").agg(F.count("*").alias("groups"), F.sum(F.col("n") - 1).alias("duplicates"), F.sum((F.col("n") - 1) * F.col("size")).alias("reclaimable"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return tally.join(sums, "mode", "left").select("mode", "versions", "stubs", zero("groups"), zero("duplicates"), zero("reclaimable"), "below_min")


def rank_items(records: DataFrame) -> DataFrame:
    """(item, path, dirty, referrers, oldest, rank): clean items first, then most referrers, oldest, path.

    An item is dirty if it holds the same content twice itself. The rank is by a range-partitioned sort with the
    partitions' sizes added up, so no single task gets all items.
    """
    inside = records.where("not stub").groupBy("item", *CONTENT).agg(F.count("*").alias("n")).groupBy("item").agg(F.max(F.col("n") > 1).alias("dirty"))
    items = records.groupBy("item").agg(F.min_by("path", "idx").alias("path"), F.sum("referrers").alias("referrers"), F.min("date").alias("oldest"))
    items = items.join(inside, "item", "left").withColumn("dirty", F.coalesce("dirty", F.lit(False)))
    return ranked(items, [F.asc("dirty"), F.desc("referrers"), F.asc("oldest"), F.asc("path"), F.asc("item")], "rank")


def ranked(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with their place (from 1) in a total order, without one task for all: sort by range, count each partition."""
    from .shared import saved

    parts = saved(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()), "ranked")
    part, within = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted((r["p"], r["n"]) for r in parts.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())  # one row for each partition
    starts, total = [], 0
    for p, n in sizes:
        starts.append((p, total))
        total += n
    offsets = F.broadcast(rows.sparkSession.createDataFrame(starts or [(0, 0)], "p long, start long"))
    placed = parts.withColumn("p", part.cast("long")).join(offsets, "p")
    return placed.withColumn(name, F.col("start") + within + 1).select(*rows.columns, name)


def referrer_counts(refs: DataFrame) -> DataFrame:
    """(target, target_version, n, pending): referrers of each version, pending ones counted, and how many of them pend."""
    return refs.groupBy("target", "target_version").agg(F.count("*").alias("n"), F.sum(F.col("pending").cast("int")).alias("pending"))


def content_map(records: DataFrame) -> DataFrame:
    """(sha256, item, version): per content hash the entry least by (item, version)."""
    return records.groupBy("sha256").agg(F.min(F.struct("item", "version")).alias("m")).select("sha256", "m.item", "m.version")


def looked_up(records: DataFrame, content: DataFrame | Callable[[DataFrame], DataFrame]) -> DataFrame:
    """records with the item that a map of content (sha256, item) names for them, as canonical; the map may be a function of the records."""
    found = content(records) if callable(content) else content
    return records.join(found.select("sha256", F.col("item").alias("canonical")), "sha256")


def repointed(references: DataFrame, moved: DataFrame) -> DataFrame:
    """(holder, target, outcome) of references (holder, target, pending) after targets moved (target, to).

    A reference to what moved goes to its new place: repointed. A pending one that stays is finished, the others are kept.
    """
    both = references.join(moved, "target", "left")
    outcome = F.when(F.col("to").isNotNull(), "repointed").when(F.col("pending"), "finished").otherwise("kept")
    return both.select("holder", F.coalesce("to", "target").alias("target"), outcome.alias("outcome"))


def replaced(records: DataFrame, least_size: int = 1) -> DataFrame:
    """What a replacement run would make of each current duplicate: (idx, canonical, outcome).

    outcome: stub, or why not: small, referrers (it is referred to itself), or same-item.
    """
    d = duplicates(records).join(records.select("idx", "item", "size", "referrers", "current"), "idx")
    canon = records.select(F.col("idx").alias("canonical"), F.col("item").alias("c_item"))
    why = F.when(F.col("size") < least_size, "small").when(F.col("referrers") > 0, "referrers").when(F.col("item") == F.col("c_item"), "same-item").otherwise("stub")
    return d.where("current").join(canon, "canonical").select("idx", "canonical", why.alias("outcome"))


def followed(records: DataFrame, refs: DataFrame) -> DataFrame:
    """(idx, size, state): stubs take their target's size; one hop only. state: ok, dangling, or chained (target is a stub)."""
    target = records.select(F.col("idx").alias("target"), F.col("size").alias("t_size"), F.col("stub").alias("t_stub"))
    rows = records.join(refs, "idx", "left").join(target, "target", "left")
    state = F.when(F.col("target").isNull(), "ok").when(F.col("t_stub").isNull(), "dangling").when(F.col("t_stub"), "chained").otherwise("ok")
    return rows.select("idx", F.coalesce("t_size", "size").alias("size"), state.alias("state"))


def matched_renames(gone: DataFrame, new: DataFrame) -> DataFrame:
    """(new_key, old_key): new files paired one to one with gone ones of the same content, in key order on both sides."""
    w = Window.partitionBy("size", "sha256").orderBy("key")
    a = gone.withColumn("_n", F.row_number().over(w)).select("size", "sha256", F.col("key").alias("old_key"), "_n")
    b = new.withColumn("_n", F.row_number().over(w)).select("size", "sha256", F.col("key").alias("new_key"), "_n")
    return b.join(a, ["size", "sha256", "_n"]).select("new_key", "old_key")


def line_number(line: Column) -> Column:
    """60 bits of a line's MD5 as a number that can be summed up."""
    return F.conv(F.substring(F.md5(line), 1, 15), 16, 10).cast("decimal(38,0)")


def state_sums(rows: DataFrame, keys: list[str], line: Column) -> DataFrame:
    """(keys, n, total): each state as the count of its lines and the sum of their numbers.

    The same for any order of the lines, and added up in each task first: no state is gathered in one place.
    """
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(line_number(line)).cast("decimal(38,0)").cast("string").alias("total"))
