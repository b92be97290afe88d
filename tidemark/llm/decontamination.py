"""Benchmark decontamination: short test items found inside long documents by containment.

Items are partitioned by the size of their n-gram set. Each partition has MinHash sketches of a size of its own, the
least hashes of an item, a quarter of them or more: so many that a document that holds enough of the item must hold one of them, and how many of
them it must hold is known too. Documents smaller than a partition's items can't contain any. Every candidate is then
verified by exact containment of the n-grams. Documents are only streamed past the items; nothing is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import WordHashes, flat_map_rows, small_batches, written
from .shingles import ngrams, words_of

N = 5
#: An item is in a document when LEAST[1] * shared >= LEAST[0] * the item's n-grams.
LEAST = (75, 100)


def item_set(text: str | None, hashes: WordHashes, n: int = N) -> tuple[int, np.ndarray]:
    """(length of the n-grams, sorted distinct n-grams); an item of fewer than n words is one n-gram of all of them."""
    words = words_of(text)
    width = min(n, len(words))
    return width, np.unique(ngrams(words, width, hashes)) if width else np.zeros(0, np.uint64)


@dataclass
class Partition:
    """Items of one n-gram length and of sizes from low to high."""

    width: int
    low: int
    items: list[int]
    keys: np.ndarray  # sketch hashes, sorted
    owners: np.ndarray  # the item of each
    needed: np.ndarray  # sketch hashes that a document with the item holds at least


def allowed_missing(n: int, least: tuple[int, int]) -> int:
    return n - -(-least[0] * n // least[1])


class Index:
    """Size-partitioned sketches of the items, and their whole sets for verification."""

    def __init__(self, items: list[tuple[int, str | None]], least: tuple[int, int] = LEAST, n: int = N):
        hashes = WordHashes()
        self.ids, self.sets, self.least, widths = [], [], least, []
        for item_id, text in items:
            width, grams = item_set(text, hashes, n)
            if width:
                self.ids.append(item_id)
                self.sets.append(grams)
                widths.append(width)
        by: dict[tuple[int, int], list[int]] = {}
        for i, (width, grams) in enumerate(zip(widths, self.sets)):
            by.setdefault((width, len(grams).bit_length()), []).append(i)
        self.partitions = []
        for (width, bits), members in sorted(by.items()):
            sketch = allowed_missing((1 << bits) - 1, least) + 1  # enough for the largest size in the partition
            keys = np.concatenate([self.sets[i][:sketch] for i in members])
            owners = np.repeat(members, [min(sketch, len(self.sets[i])) for i in members])
            needed = np.zeros(len(self.sets), np.int64)
            for i in members:
                needed[i] = max(1, min(sketch, len(self.sets[i])) - allowed_missing(len(self.sets[i]), least))
            order = np.argsort(keys, kind="stable")
            low = min(-(-least[0] * len(self.sets[i]) // least[1]) for i in members)
            self.partitions.append(Partition(width, low, members, keys[order], owners[order], needed))

    def found_in(self, text: str | None, hashes: WordHashes) -> list[tuple[int, int, int]]:
        """(item id, its n-grams, those of them that the whole text holds) of each item that the text contains."""
        words = words_of(text)
        sets: dict[int, np.ndarray] = {}
        out = []
        for p in self.partitions:
            if len(words) - p.width + 1 < p.low:
                continue
            grams = sets.get(p.width)
            if grams is None:
                grams = sets[p.width] = np.unique(ngrams(words, p.width, hashes))
            if len(grams) < p.low:
                continue
            low, high = np.searchsorted(p.keys, grams, "left"), np.searchsorted(p.keys, grams, "right")
            hit = np.flatnonzero(high > low)
            if not len(hit):
                continue
            owners = np.concatenate([p.owners[low[h] : high[h]] for h in hit])
            hits = np.bincount(owners, minlength=len(self.sets))
            for i in np.flatnonzero((hits > 0) & (hits >= p.needed)):
                own = self.sets[i]
                at = np.minimum(np.searchsorted(grams, own), len(grams) - 1)
                shared = int(np.count_nonzero(grams[at] == own))
                if self.least[1] * shared >= self.least[0] * len(own):
                    out.append((self.ids[i], len(own), shared))
        return out


def search(docs: DataFrame, items: DataFrame, least: tuple[int, int] = LEAST, n: int = N, block_bytes: int = 16_000_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, item_shingles, shared, containment) for each item that a row of docs contains.

    Whole texts on both sides. Items go to the tasks in blocks of about ``block_bytes`` of text, one pass over docs for
    each block, so that what the driver holds and what is sent along is bounded however many items there are. Null and wordless items match
    nothing; null and empty texts contain nothing; null ids, repeated rows and repeated items give rows of their own.
    Other columns are not read; empty tables give an empty result.
    """
    spark = docs.sparkSession
    own = items.select(F.col(item_col).alias("item_id"), F.col(item_text).alias("text")).where("text is not null")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kinds = [x.schema[c].dataType.simpleString() for x, c in ((rows, "doc_id"), (own, "item_id"))]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, item_shingles long, shared long, containment double"
    size = own.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    result = spark.createDataFrame([], schema)
    for block in range(blocks):
        part = own.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block) if blocks > 1 else own
        index = Index(sorted(((r[0], r[1]) for r in part.collect()), key=lambda x: (x[0] is None, str(x[0]), x[1])), least, n)
        if not index.ids:
            continue

        def make(index=index):
            hashes = WordHashes()
            return lambda row: [(row[0], i, k, s, s / k) for i, k, s in index.found_in(row[1], hashes)]

        found = flat_map_rows(rows, make, schema)
        if blocks == 1:
            return found
        result = result.unionAll(written(found, "decontamination"))  # run now, so that the driver holds one block's index at a time
    return result


def _holder(index: Index):
    """A function on text columns: whether the text contains one of the index's items."""

    @arrow_udf("boolean")
    def holds(texts: pa.Array) -> pa.Array:
        hashes = WordHashes()
        return pa.array([bool(index.found_in(t.as_py(), hashes)) for t in texts], pa.bool_())

    return holds


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_items_bytes: int = 16_000_000) -> DataFrame:
    """The rows of docs that contain none of the items, all columns kept; cases as for search().

    Rows are judged by their own text in place, so nothing is joined back.
    """
    small_batches(docs.sparkSession)
    own = items.select("item_id", "text").where("text is not null")
    size = own.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    blocks = max(1, -(-size // most_items_bytes))
    for block in range(blocks):
        part = own.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block) if blocks > 1 else own
        index = Index([(r[0], r[1]) for r in part.collect()])

        docs = docs.where(~_holder(index)(F.col(text_col)))
        docs = docs if blocks == 1 else written(docs, "decontamination")
    return docs
