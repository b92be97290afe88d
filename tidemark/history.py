"""The history of a set of keys as an object: what there was when, which versions, and what changed behind a moment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import temporal as T
from tidemark.sources.adapters import NTZ


class History:
    """Versions (key, seq, last_modified, deleted, size, ...) with declared dates (key, seq, at)."""

    def __init__(self, versions: DataFrame, dates: DataFrame | None = None):
        self.dated = T.effective(versions, dates)

    def span(self) -> DataFrame:
        """(first, latest): the dates between which there is anything."""
        return self.dated.where("not deleted").agg(F.min("eff").alias("first"), F.max("eff").alias("latest"))

    def listed(self, at: str, prefix: str = "") -> DataFrame:
        """Each key's version at a moment, of the keys that begin with prefix."""
        return T.as_of(self.dated.where(F.col("key").cast("string").startswith(prefix)), at)

    def versions(self, key) -> DataFrame:
        """A key's versions, newest effective first."""
        return T.version_list(self.dated.where(F.col("key") == key)).orderBy("rank")

    def search(self, text: str, at: str) -> DataFrame:
        """Keys that hold a text, at a moment."""
        return self.listed(at).where(F.lower(F.col("key").cast("string")).contains(text.lower()))

    def past_changes(self, since: str) -> DataFrame:
        """(key, seq, eff): versions stored after a moment and dated before it."""
        moment = F.lit(since).cast(NTZ)
        return self.dated.where((F.col("last_modified") > moment) & (F.col("eff") < moment)).select("key", "seq", "eff")
