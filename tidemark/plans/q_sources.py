"""Queries on sources, sinks and identifiers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from tidemark.functions import values as V
from tidemark.operators.shared import saved, shared_folder
from tidemark.sources.adapters import C_SQL, V_SQL, contents, table, versions
from tidemark.sources.folder import listing
from tidemark.sources.store import HistoryCache, VersionStore

from .catalog import Catalog

catalog = Catalog()
QUERIES, ORACLE, query = catalog.queries, catalog.oracle, catalog.query


@query("s01_store_reads", f"SELECT key, seq, size FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM ({V_SQL})) WHERE rn = 1 AND NOT deleted")
def s01(spark, sf):
    """The read side of the store: the current version of each key."""
    return VersionStore(versions(spark, sf)).heads().select("key", "seq", "size")


@query("s18_history_cache", f"SELECT key, count(*) AS n, max(seq) AS newest, count(*) FILTER (seq <= 600) AS cached FROM ({V_SQL}) GROUP BY key")
def s18(spark, sf):
    """A cache complete up to a mark that then moves on; what is newer comes from the store."""
    cache = HistoryCache(versions(spark, sf).select("key", "seq"), 400).advanced(600)
    held = cache.held.groupBy("key").agg(F.count("*").alias("cached"))
    every = cache.read().groupBy("key").agg(F.count("*").alias("n"), F.max("seq").alias("newest"))
    return every.join(held, "key", "left").select("key", "n", "newest", F.coalesce("cached", F.lit(0)).alias("cached"))


@query("s21_content_map_store", f"SELECT sha256, arg_min(item, (item, version)) AS item FROM ({C_SQL}) GROUP BY sha256")
def s21(spark, sf):
    """The content map written as JSON lines and read back with its schema."""
    import uuid

    from tidemark.operators.dedupe import content_map

    m = content_map(contents(spark, sf))
    path = f"{shared_folder(spark)}/content-map-{uuid.uuid4().hex}"
    m.write.json(path)
    return spark.read.schema(m.schema).json(path).select("sha256", "item")


@query("s22_folder_listing")
def s22(spark, sf):
    """A folder as entries: path, size and second of change; the files' bytes aren't read."""
    return listing(spark, sf)


@query("f12_minted_ids", "SELECT event_id, lpad(lower(to_hex(epoch_us(ts) // 1000)), 12, '0') AS head, true AS valid FROM events")
def f12(spark, sf):
    """Identifiers minted for a declared time: its milliseconds, then what the row's own hash gives."""
    ms = F.lpad(F.lower(F.hex(F.unix_millis(F.col("ts").cast("timestamp")))), 12, "0")
    rest = F.sha2(F.col("event_id").cast("string"), 256)
    uuid = F.concat(F.substring(ms, 1, 8), F.lit("-"), F.substring(ms, 9, 4), F.lit("-7"), F.substring(rest, 1, 3), F.lit("-8"), F.substring(rest, 4, 3), F.lit("-"), F.substring(rest, 8, 12))
    return table(spark, sf, "events").select("event_id", ms.alias("head"), uuid.rlike(r"\A[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-8[0-9a-f]{3}-[0-9a-f]{12}\z").alias("valid"))


@query("f13_inodes")
def f13(spark, sf):
    """xxHash64 with seed 0 of the key; Spark's own function has another seed."""
    return table(spark, sf, "documents").select("doc_id", V.inode()(F.col("source")).alias("inode"))


@query("f24_posix_acls", "SELECT p_partkey, 4 + 8 * 3 AS bytes, p_size % 8 AS owner_bits FROM part")
def f24(spark, sf):
    @F.pandas_udf("bytes int, owner_bits int")
    def there_and_back(perm: pd.Series) -> pd.DataFrame:
        out = []
        for p in perm:
            body = V.encode_posix_acl([(1, int(p), 0xFFFFFFFF), (4, 5, 0xFFFFFFFF), (32, 4, 0xFFFFFFFF)])
            out.append((len(body), next(e[1] for e in V.decode_posix_acl(body) if e[0] == 1)))
        return pd.DataFrame(out, columns=["bytes", "owner_bits"])

    return table(spark, sf, "part").select("p_partkey", there_and_back(F.col("p_size") % 8).alias("r")).select("p_partkey", "r.*")


@query("x07_pluggable_map", f"""WITH m AS (SELECT sha256, max(item) AS item FROM ({C_SQL}) GROUP BY sha256), s AS (SELECT sha256, min(item) AS item FROM ({C_SQL}) WHERE idx % 2 = 0 GROUP BY sha256)
SELECT c.idx, 'own' AS map, m.item AS canonical FROM ({C_SQL}) c JOIN m ON c.sha256 = m.sha256 UNION ALL SELECT c.idx, 'even', s.item FROM ({C_SQL}) c JOIN s ON c.sha256 = s.sha256""")
def x07(spark, sf):
    """Whatever maps content to items is the caller's: here two maps, one given as a table and one as a function."""
    from tidemark.operators.dedupe import looked_up

    c = contents(spark, sf)
    own = c.groupBy("sha256").agg(F.max("item").alias("item"))
    even = lambda records: records.where("idx % 2 = 0").groupBy("sha256").agg(F.min("item").alias("item"))
    pick = lambda df, name: df.select("idx", F.lit(name).alias("map"), "canonical")
    return pick(looked_up(c, own), "own").unionAll(pick(looked_up(c, even), "even"))
