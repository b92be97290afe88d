"""Connected components of an edge table: by union-find in one task where edges are few, else by alternating star steps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


class Forest:
    """Union-find over 0..n-1; a root is the least member of its set."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def _in_one_task(table: pa.Table) -> pa.Table:
    every, at = np.unique(np.concatenate([table["a"].to_numpy(), table["b"].to_numpy()]), return_inverse=True)
    forest = Forest(len(every))
    for i, j in zip(at[: table.num_rows].tolist(), at[table.num_rows :].tolist()):
        forest.join(i, j)
    roots = np.array([forest.root(i) for i in range(len(every))], np.int64)
    return pa.table({"v": pa.array(every), "root": pa.array(every[roots])})


def components(edges: DataFrame, most_rounds: int = 60, most_in_task: int = 300_000) -> DataFrame:
    """(v, root) for each vertex of edges (a, b): root is the smallest vertex that links reach. Self-loops count as vertices.

    Up to most_in_task distinct edges (a few MB) go to one executor task. Beyond, each round writes its edges to the shared folder. A vertex with very many neighbours is met by grouped minima and
    joins only, never as a list.
    """
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    if now.count() <= most_in_task:
        return now.groupBy(F.lit(0).alias("all")).applyInArrow(_in_one_task, "v long, root long")
    mark = None
    for _ in range(most_rounds):
        # Large star: each vertex's larger neighbours are linked to its least neighbour (or itself).
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.unionAll(now.where("a = b")).distinct()
        # Small star: a vertex and its smaller neighbours are linked to the least of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(low.select("a", F.col("m").alias("b")))
        then = written(small.distinct(), "edges")
        n, total = then.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        dropped(now)
        now = then
        if (n, total) == mark:
            break
        mark = (n, total)
    else:
        raise RuntimeError(f"components haven't settled after {most_rounds} rounds")
    return now.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("root"))
