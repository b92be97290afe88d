"""Deletion log: pages, filters, batches; origins (lineage) and what a mirror would do."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.names import trash_key

from .dedupe import ranked
from .tree import under


def listed(trash: DataFrame, live_items: DataFrame | None = None, prefix: str = "", batch: str | None = None, pass_: str | None = None, origin_drive: str | None = None, keep=None) -> DataFrame:
    """Entries that meet every filter given and whose item isn't live again; keep is a Column to hold too."""
    rows = trash.where(under(F.col("path"), prefix))
    for name, value in (("batch", batch), ("pass", pass_), ("origin_drive", origin_drive)):
        if value is not None:
            rows = rows.where(F.col(name) == value)
    if keep is not None:
        rows = rows.where(keep)
    return rows if live_items is None else rows.join(live_items.select("item"), "item", "left_anti")


def page(trash: DataFrame, live_items: DataFrame, after: str, limit: int) -> DataFrame:
    """(key, entry_id, item, next): the limit entries after a cursor, newest first; next is set on the last if more follow."""
    rows = trash.withColumn("key", trash_key(F.col("deleted_at"), F.col("entry_id"))).where(F.col("key") > after)
    rows = rows.join(live_items.select("item"), "item", "left_anti").orderBy("key").limit(limit + 1)
    # A page is bounded, so one ordered array of it tells whether more follow.
    got = rows.agg(F.array_sort(F.collect_list(F.struct("key", "entry_id", "item"))).alias("a"))
    more = F.size("a") > limit
    return got.select(F.posexplode(F.slice("a", 1, limit)).alias("i", "e"), more.alias("more")).select("e.*", F.when(F.col("more") & (F.col("i") == limit - 1), F.col("e.key")).alias("next"))


def undo_roots(trash: DataFrame, pass_: str) -> DataFrame:
    """(entry_id, item, pos): the entries that undoing a pass restores, oldest first: roots of a batch, named by them, or in none.

    What else is in a batch comes back with its root.
    """
    roots = trash.where((F.col("pass") == pass_) & (F.col("batch").isNull() | (F.col("batch") == F.col("entry_id"))))
    return ranked(roots, [F.asc("deleted_at"), F.asc("entry_id")], "pos").select("entry_id", "item", "pos")


def undone(trash: DataFrame, pass_: str, taken: DataFrame) -> DataFrame:
    """(entry_id, item, path, outcome) of undoing a pass: its roots and all of their batches, each to its place as restored()."""
    roots = undo_roots(trash, pass_).select(F.col("entry_id").alias("root"))
    rows = trash.join(roots, F.coalesce("batch", "entry_id") == F.col("root"), "left_semi")
    return _placed(rows, taken).select("entry_id", "item", "path", "outcome")


def _placed(rows: DataFrame, taken: DataFrame) -> DataFrame:
    """rows with the outcome of putting each to its path: taken, older if another row has that path and is newer, or restored."""
    first = rows.groupBy("path").agg(F.max(F.struct("deleted_at", "entry_id")).alias("m")).select("path", F.col("m.entry_id").alias("winner"))
    both = rows.join(first, "path").join(taken.select(F.col("path"), F.lit(True).alias("taken")).distinct(), "path", "left")
    return both.withColumn("outcome", F.when(F.col("taken"), "taken").when(F.col("entry_id") != F.col("winner"), "older").otherwise("restored"))


def restored(trash: DataFrame, batch: str, taken: DataFrame) -> DataFrame:
    """(item, path, outcome) of restoring a batch: to its place, unless the path is taken; the newest of equal paths wins."""
    return _placed(trash.where(F.col("batch") == batch), taken).select("item", "path", "outcome")


def by_origin(wanted: DataFrame, origins: DataFrame, trash: DataFrame) -> DataFrame:
    """(drive, id, item, entry_id): the live item of each origin, else its newest trash entry, else neither.

    origins: (drive, id, item, alias, live); an alias counts only while it is listed and live.
    """
    live = origins.where("live").groupBy("drive", "id").agg(F.min_by("item", F.struct("alias", "item")).alias("item"))
    gone = trash.groupBy("drive", "id").agg(F.max_by("entry_id", F.struct("deleted_at", "entry_id")).alias("entry"))
    return wanted.join(live, ["drive", "id"], "left").join(gone, ["drive", "id"], "left").select("drive", "id", "item", F.when(F.col("item").isNull(), F.col("entry")).alias("entry_id"))


def mirror_actions(source: DataFrame, mirror: DataFrame, trash: DataFrame) -> DataFrame:
    """(id, actions): what applying a source listing to its mirror does to each row.

    source: (id, path, version, mtime); mirror: (id, path, version, mtime) of items with that origin; trash: (id).
    """
    m = mirror.select("id", F.struct("path", "version", "mtime").alias("m"))
    t = trash.select("id").distinct().withColumn("t", F.lit(True))
    both = source.join(m, "id", "full_outer").join(t, "id", "left")
    has, s = F.col("m").isNotNull(), F.col("version").isNotNull()
    some = F.filter(
        F.array(
            F.when(F.col("path") != F.col("m.path"), "moved"), F.when(F.col("version") != F.col("m.version"), "updated").when(F.col("mtime") != F.col("m.mtime"), "retimed"),
        ),
        lambda x: x.isNotNull(),
    )
    acts = F.when(~s, F.array(F.lit("removed"))).when(~has & F.col("t"), F.array(F.lit("restored"))).when(~has, F.array(F.lit("created"))).when(F.size(some) == 0, F.array(F.lit("unchanged"))).otherwise(some)
    return both.select("id", acts.alias("actions"))


def first_blank_slot(filesystems: DataFrame) -> DataFrame:
    """(slot): the first position without a name, else the one after the last."""
    return filesystems.agg(F.coalesce(F.min(F.when(F.col("name") == "", F.col("pos"))), F.max("pos") + 1, F.lit(0)).alias("slot"))
