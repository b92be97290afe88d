"""Read access to a table of versions: what a store answers, as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.shared import saved
from tidemark.operators.temporal import as_of, effective, newest


class VersionStore:
    """Key histories (key, seq, last_modified, deleted, size, ...), perhaps with declared dates."""

    def __init__(self, versions: DataFrame, dates: DataFrame | None = None):
        self.versions, self.dates = versions, dates

    def history(self, key: Column | str | int) -> DataFrame:
        """All versions and deletions of a key, newest stored first."""
        return self.versions.where(F.col("key") == key).orderBy(F.desc("seq"))

    def history_under(self, prefix: str) -> DataFrame:
        return self.versions.where(F.col("key").cast("string").startswith(prefix))

    def heads(self) -> DataFrame:
        """The newest stored version of each key, if it isn't a deletion."""
        return newest(self.versions, ["key"], [F.col("seq")], self.versions.columns).where("not deleted")

    def listed_after(self, after: str | int, limit: int) -> DataFrame:
        return self.heads().where(F.col("key") > after).orderBy("key").limit(limit)

    def at(self, moment: str) -> DataFrame:
        """Each key's version at a moment, declared dates counted."""
        return as_of(effective(self.versions, self.dates), moment)


class HistoryCache:
    """Key histories written to the shared folder, complete up to a mark; newer versions are read from the store itself."""

    def __init__(self, versions: DataFrame, upto: int):
        self.store, self.upto = versions, upto
        self.held = saved(versions.where(F.col("seq") <= upto), "history")

    def read(self) -> DataFrame:
        """All versions: those up to the mark from the cache, the others from the store."""
        return self.held.unionByName(self.store.where(F.col("seq") > self.upto))

    def advanced(self, upto: int) -> HistoryCache:
        """A cache complete up to a later mark, of which only the part in between is read from the store."""
        later = object.__new__(HistoryCache)
        later.store, later.upto = self.store, upto
        later.held = self.held.unionByName(saved(self.store.where((F.col("seq") > self.upto) & (F.col("seq") <= upto)), "history"))
        return later
