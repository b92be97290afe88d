"""Hierarchies of entries (parent, id, name, type): walks, paths, searches and closures."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import saved

VISIBLE = ("file", "dir", "symlink")


def walk(entries: DataFrame, root: str = "", depth: int = 0) -> DataFrame:
    """(parent, id, name, type, path, depth) of all below root; depth 0 means all of it, else that many levels.

    Goes level by level: each is one join of the last level's directories with the entries. The levels are written to
    the shared folder, so a deep tree neither grows the plan nor is computed twice. A directory that lies below itself
    raises an error.
    """
    columns = ["parent", "id", "name", "type", "path", "depth"]
    below = entries.where(F.col("parent") == root).select("parent", "id", "name", "type", F.concat(F.lit("/"), "name").alias("path"), F.lit(1).alias("depth"), F.array("id").alias("above"))
    levels = [saved(below, "walk")]
    while not depth or len(levels) < depth:
        dirs = levels[-1].where("type = 'dir'").select(F.col("id").alias("_dir"), F.col("path").alias("_path"), F.col("above").alias("_above"))
        if dirs.isEmpty():
            break
        once = F.when(F.array_contains("_above", F.col("id")), F.raise_error(F.concat(F.lit("a directory lies below itself: "), "id"))).otherwise(F.col("id"))
        below = entries.join(dirs, F.col("parent") == F.col("_dir")).select("parent", once.alias("id"), "name", "type", F.concat("_path", F.lit("/"), "name").alias("path"), F.lit(len(levels) + 1).alias("depth"), F.when(F.col("type") == "dir", F.concat("_above", F.array("id"))).alias("above"))
        levels.append(saved(below, "walk"))
    return reduce(DataFrame.unionAll, [level.select(*columns) for level in levels])


def found_by_id(entries: DataFrame, wanted: DataFrame, depth: int) -> DataFrame:
    """(id, path, state) of wanted ids after a search of so many levels: found, not-searched if folders are left, else not-found."""
    seen = walk(entries, depth=depth)
    rest = seen.where(f"depth = {depth} and type = 'dir'").isEmpty()
    both = wanted.select("id").join(seen.groupBy("id").agg(F.min("path").alias("path")), "id", "left")
    return both.select("id", "path", F.when(F.col("path").isNotNull(), "found").otherwise("not-found" if rest else "not-searched").alias("state"))


def each_folder(entries: DataFrame, call: Callable[[str, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """What a callback makes of each folder and its items (id, name, type), by name. An error that it raises ends the walk."""

    def run(key: tuple, items: pd.DataFrame) -> pd.DataFrame:
        return call(key[0], items.drop(columns="parent").sort_values("name"))

    return entries.select("parent", "id", "name", "type").groupBy("parent").applyInPandas(run, schema)


def page(items: DataFrame, after: str | None, limit: int, *order: Column) -> DataFrame:
    """The limit rows after the one whose path is ``after``, with their position; an unknown cursor starts at the top."""
    keys = order or (F.lower("path"), F.col("path"))
    if after is not None:
        cut = items.where(F.col("path") == after).select(F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)]).alias("k")).first()
        if cut is not None:
            items = items.where(F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)]) > F.struct(*[F.lit(v).alias(f"k{i}") for i, v in enumerate(cut["k"])]))
    return numbered(items.orderBy(*keys).limit(limit), *keys)


def numbered(rows: DataFrame, *order: Column, name: str = "pos") -> DataFrame:
    """A bounded result with its position; only for rows already cut by a limit or a directory."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)).cast("long"))


def paths_of_items(walked: DataFrame) -> DataFrame:
    """(id, paths, names): every path that names an item, sorted."""
    return walked.groupBy("id").agg(F.sort_array(F.collect_list("path")).alias("paths"), F.count("*").alias("names"))


def under(path: Column, prefix: str) -> Column:
    """Whether a path is prefix or below it; '' holds all. Never LIKE: names may hold wildcards."""
    prefix = prefix.rstrip("/")
    return F.lit(True) if not prefix else (path == prefix) | path.startswith(prefix + "/")


def ancestors(walked: DataFrame) -> DataFrame:
    """(ancestor, id) for each item and each directory above it, by path prefixes joined on equality."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(2), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    up = walked.where("depth > 1").select("id", F.explode(above).alias("_p"))
    dirs = walked.where("type = 'dir'").select(F.col("id").alias("ancestor"), F.col("path").alias("_dp"))
    return up.join(dirs, F.col("_p") == F.col("_dp")).select("ancestor", "id")


def search(live: DataFrame, trash: DataFrame, text: str, limit: int = 1000) -> DataFrame:
    """Case-insensitive name search over trash (first, newest deletions first) and the live tree (by depth, then path).

    live: (id, name, path, depth); trash: (item, name, path, deleted_at). see is a second before the deletion.
    """
    hit = F.lower("name").contains(text.lower())
    t = trash.where(hit).select(F.col("item").alias("id"), "name", "path", F.lit(0).alias("live"), (-F.unix_micros(F.col("deleted_at").cast("timestamp"))).alias("_k"), (F.col("deleted_at") - F.expr("interval 1 second")).cast("timestamp_ntz").alias("see"))
    found = live.where(hit).select("id", "name", "path", F.lit(1).alias("live"), F.col("depth").cast("long").alias("_k"), F.lit(None).cast("timestamp_ntz").alias("see"))
    order = [F.col("live"), F.col("_k"), F.col("path"), F.col("id")]
    return numbered(t.unionAll(found).orderBy(*order).limit(limit), *order).drop("_k")
