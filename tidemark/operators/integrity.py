"""Integrity of a catalogue: one query for each kind of problem, joined up, and what would repair each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: What is done about a problem; what isn't listed is only reported.
REPAIRS = {"link-count": "set-count", "deleted-but-listed": "remove-entry", "duplicate-name": "rename-entry", "missing-object": "remove-entry", "ref-target-missing": "drop-reference", "ref-entry-dead": "drop-reference", "ref-entry-pending": "finish-reference", "out-of-order": "sort-block"}


def block_problems(blocks: DataFrame, links: DataFrame, entries: DataFrame) -> DataFrame:
    """(kind, subject) of directory blocks: missing-block, unreadable-block, block-reached-twice, out-of-order, outside-range.

    blocks: (block, low, high, readable); links: (parent, block); entries: (block, pos, name). An entry's name is at
    least its block's low and below its high; null bounds are open.
    """
    there = blocks.select("block")
    met = links.groupBy("block").agg(F.count("*").alias("n"))
    kind = lambda df, name, subject="block": df.select(F.lit(name).alias("kind"), F.col(subject).cast("string").alias("subject")).distinct()
    was = F.lag("name").over(Window.partitionBy("block").orderBy("pos", "name"))
    ranged = entries.join(blocks, "block").where((F.col("name") < F.col("low")) | (F.col("name") >= F.col("high")))
    return reduce(DataFrame.unionAll, [
        kind(met.join(there, "block", "left_anti"), "missing-block"),
        kind(blocks.where("not readable").join(met, "block", "left_semi"), "unreadable-block"),
        kind(met.where("n > 1"), "block-reached-twice"),
        kind(entries.withColumn("was", was).where("was >= name"), "out-of-order"),
        kind(ranged, "outside-range"),
    ])


def reference_problems(references: DataFrame, records: DataFrame) -> DataFrame:
    """(kind, subject) of references (holder, target, pending) between records (key, stub, live).

    ref-target-missing, ref-to-ref (the target is a reference itself), ref-entry-dead (the target isn't live),
    ref-entry-pending, ref-holder-dead (the holder isn't there or not live).
    """
    target = records.select(F.col("key").alias("target"), F.col("stub").alias("t_stub"), F.col("live").alias("t_live"))
    holder = records.select(F.col("key").alias("holder"), F.col("live").alias("h_live"))
    both = references.join(target, "target", "left").join(holder, "holder", "left")
    problems = F.array(
        F.when(F.col("t_stub").isNull(), "ref-target-missing"), F.when(F.col("t_stub"), "ref-to-ref"), F.when(~F.col("t_live"), "ref-entry-dead"),
        F.when(F.col("pending"), "ref-entry-pending"), F.when(~F.coalesce("h_live", F.lit(False)), "ref-holder-dead"),
    )
    return both.select(F.explode(F.filter(problems, lambda x: x.isNotNull())).alias("kind"), F.concat_ws(">", F.col("holder").cast("string"), F.col("target").cast("string")).alias("subject"))


def repairs(problems: DataFrame) -> DataFrame:
    """(kind, subject, action): what a repair does about each problem; report where nothing can be done."""
    action = F.lit("report")
    for kind, what in REPAIRS.items():
        action = F.when(F.col("kind") == kind, what).otherwise(action)
    return problems.select("kind", "subject", action.alias("action"))
