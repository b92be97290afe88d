"""Changes as functions from a snapshot and a log to a new snapshot; nothing is written in place."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tree import walk


def conditional_writes(log: DataFrame) -> DataFrame:
    """(key, seq, accepted): writes of a key in order, each accepted if what it expects is the key's current version.

    log: (key, seq, expect, version); a null expect takes anything, '' demands that there is none yet. Rows pass sorted
    by key and seq, with the current key's version carried along: no key's writes are gathered, however many they are.
    """
    kind = log.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now = object(), ""
        for batch in batches:
            keys, expects, versions = (batch.column(i).to_pylist() for i in (0, 2, 3))
            out = []
            for k, expect, version in zip(keys, expects, versions):
                if k != key:
                    key, now = k, ""
                out.append(expect is None or expect == now)
                now = version if out[-1] else now
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.bool_())], names=["key", "seq", "accepted"])

    rows = log.select("key", F.col("seq").cast("long").alias("seq"), "expect", "version").repartition("key").sortWithinPartitions("key", "seq")
    return rows.mapInArrow(run, f"key {kind}, seq long, accepted boolean")


def with_parents(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """(path): directories to make so that each wanted path has all its parents."""
    parts = F.split("path", "/")
    every = wanted.select(F.explode(F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("path")).distinct()
    return every.join(existing.select("path"), "path", "left_anti")


def moved(entries: DataFrame, moves: DataFrame, descendants: DataFrame) -> DataFrame:
    """entries after moves (id, to_parent, to_name), ids kept; one into the item itself or below it is refused.

    descendants: (ancestor, id).
    """
    bad = moves.join(descendants, (F.col("to_parent") == descendants["id"]) & (moves["id"] == F.col("ancestor")), "left_semi").select("id").unionAll(moves.where("id = to_parent").select("id"))
    good = moves.join(bad.distinct(), "id", "left_anti")
    both = entries.join(good, "id", "left")
    return both.select(F.coalesce("to_parent", "parent").alias("parent"), "id", F.coalesce("to_name", "name").alias("name"), "type")


def deleted(entries: DataFrame, root: str, at: Column) -> DataFrame:
    """Trash rows of deleting a directory with all below it: one batch, named by the root's own entry."""
    below = walk(entries, root=root).select("id", "name", "path")
    top = entries.where(F.col("id") == root).select("id", "name", F.lit("").alias("path"))
    return top.unionAll(below).select(F.concat(F.lit("e-"), "id").alias("entry_id"), F.col("id").alias("item"), "name", "path", F.lit(f"e-{root}").alias("batch"), at.alias("deleted_at"))


def purged(versions: DataFrame, gone: DataFrame, referred: DataFrame) -> DataFrame:
    """versions after erasing items: of those with live referrers the versions referred to stay."""
    kept = versions.join(gone, "key", "left_anti")
    needed = versions.join(gone, "key", "left_semi").join(referred, ["key", "seq"], "left_semi")
    return kept.unionByName(needed)


def edited(attributes: Column, changes: Column) -> Column:
    """A map with changes applied; a key set to null is removed."""
    kept = F.map_filter(attributes, lambda k, v: ~F.map_contains_key(changes, k))
    return F.map_filter(F.map_concat(kept, changes), lambda k, v: v.isNotNull())


def named(names: DataFrame, wanted: DataFrame, created: Column, now: Column, valid: Column) -> DataFrame:
    """(name, outcome) of naming moments: created, taken, invalid, early or future."""
    both = wanted.join(names.select("name", F.lit(True).alias("taken")), "name", "left")
    outcome = F.when(~valid, "invalid").when(F.col("taken"), "taken").when(F.col("time") > now, "future").when(F.col("time") < created, "early").otherwise("created")
    return both.select("name", outcome.alias("outcome"))


def stub_writes(writes: DataFrame, records: DataFrame) -> DataFrame:
    """(idx, outcome) of reference writes (idx, target, sha256): written, missing, stub or different."""
    t = records.select(F.col("idx").alias("target"), F.col("stub").alias("t_stub"), F.col("sha256").alias("t_sha"))
    rows = writes.join(t, "target", "left")
    return rows.select("idx", F.when(F.col("t_stub").isNull(), "missing").when(F.col("t_stub"), "stub").when(F.col("t_sha") != F.col("sha256"), "different").otherwise("written").alias("outcome"))


def unnamed(names: DataFrame, wanted: DataFrame) -> DataFrame:
    """(name, outcome) of deleting named moments: removed or missing."""
    both = wanted.select("name").distinct().join(names.select("name", F.lit(True).alias("there")).distinct(), "name", "left")
    return both.select("name", F.when(F.col("there"), "removed").otherwise("missing").alias("outcome"))


def link_counts(entries: DataFrame, links: DataFrame, unlinks: DataFrame) -> DataFrame:
    """(item, nlink, gone): items after names (dir, name, item) were added and others (dir, name) taken away; without a name an item is gone."""
    left = entries.join(unlinks, ["dir", "name"], "left_anti").select("item").unionAll(links.select("item")).groupBy("item").agg(F.count("*").alias("n"))
    every = entries.select("item").unionAll(links.select("item")).distinct()
    return every.join(left, "item", "left").select("item", F.coalesce("n", F.lit(0)).alias("nlink"), F.col("n").isNull().alias("gone"))


def master_changes(filesystems: DataFrame, changes: DataFrame) -> DataFrame:
    """(name, kind, outcome) of changes (name, kind, size) to a table of filesystems (name, size, used, archived).

    create: created, or exists as it is. resize: resized, or refused below what is used. archive: archived. prune: pruned
    if archived, else refused. What isn't there is missing. Each change is judged by the table as it is.
    """
    both = changes.join(filesystems.select("name", F.col("size").alias("now"), "used", "archived"), "name", "left")
    there = F.col("now").isNotNull()
    outcome = (
        F.when(F.col("kind") == "create", F.when(there, "exists").otherwise("created")).when(~there, "missing")
        .when(F.col("kind") == "resize", F.when(F.col("size") < F.col("used"), "refused").otherwise("resized"))
        .when(F.col("kind") == "archive", "archived").when(F.col("kind") == "prune", F.when(F.col("archived"), "pruned").otherwise("refused"))
    )
    return both.select("name", "kind", outcome.alias("outcome"))
