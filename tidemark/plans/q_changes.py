"""Queries on change feeds, records and changes to snapshots."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from tidemark.functions.names import version_name_ok
from tidemark.operators import mutations as M
from tidemark.operators import ranges as G
from tidemark.operators import temporal as T
from tidemark.operators import tree
from tidemark.sources import records
from tidemark.sources.adapters import C_SQL, E_SQL, EFF_SQL, K_SQL, V_SQL, W_SQL, claims, contents, dates, entries, locks, table, trash, versions
from tidemark.streaming import feed

from . import q_catalog, q_temporal
from .catalog import Catalog
from .q_tree import WALK_SQL, walked

catalog = Catalog()
QUERIES, ORACLE, query = catalog.queries, catalog.oracle, catalog.query
NTZ = "timestamp_ntz"


def ts(x):
    return F.lit(x).cast(NTZ)


@query("s09_store_clock", f"SELECT key, count(*) AS n FROM ({V_SQL}) WHERE last_modified <= TIMESTAMP '2024-01-10 00:00:00' GROUP BY key")
def s09(spark, sf):
    """The clock is a parameter: what there was at the second given."""
    return versions(spark, sf).where(F.col("last_modified") <= ts("2024-01-10 00:00:00")).groupBy("key").agg(F.count("*").alias("n"))


@query("s13_block_codec", "SELECT l_orderkey AS block, count(*) AS entries, min(l_linenumber || ':' || l_partkey) AS first FROM lineitem GROUP BY l_orderkey")
def s13(spark, sf):
    """Directory blocks encoded and decoded again, their entries exploded."""
    s = lambda c: F.col(c).cast("string")
    e = F.struct(s("l_linenumber").alias("name"), s("l_partkey").alias("uuid"), F.lit(1).cast("long").alias("type"))
    b = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(e).alias("entries"))
    b = b.select("l_orderkey", records.encoder("block")(F.struct("entries", F.lit(1).cast("long").alias("layout"))).alias("body"))
    rows = b.select("l_orderkey", F.explode(records.decoder("block")(F.col("body"))["entries"]).alias("e"))
    return rows.groupBy(F.col("l_orderkey").alias("block")).agg(F.count("*").alias("entries"), F.min(F.concat_ws(":", "e.name", "e.uuid")).alias("first"))


@query("s15_dates_codec", "SELECT user_id AS key, count(*) AS n, max(date_trunc('second', ts)) AS latest FROM events GROUP BY user_id")
def s15(spark, sf):
    e = F.struct(F.col("event_id").cast("string").alias("version_id"), F.date_trunc("second", F.col("ts").cast("timestamp")).alias("at"))
    d = table(spark, sf, "events").groupBy("user_id").agg(F.collect_list(e).alias("dates"))
    d = d.select("user_id", records.encoder("dates")(F.struct("dates", F.lit(1).cast("long").alias("layout"))).alias("body"))
    rows = d.select("user_id", F.explode(records.decoder("dates")(F.col("body"))["dates"]).alias("d"))
    return rows.groupBy(F.col("user_id").alias("key")).agg(F.count("*").alias("n"), F.max("d.at").cast(NTZ).alias("latest"))


@query("s16_trash_codec", "SELECT 'e' || o_orderkey AS entry_id, '/c' || o_custkey || '/order-' || o_orderkey AS path, o_orderkey AS size FROM orders")
def s16(spark, sf):
    t = trash(spark, sf)
    body = records.encoder("trash")(F.struct("entry_id", "path", F.substring("entry_id", 2, 20).cast("long").alias("size"), F.lit(1).cast("long").alias("layout")))
    return t.select(records.decoder("trash")(body).alias("r")).select("r.entry_id", "r.path", "r.size")


@query("s14_metadata_codec", """SELECT p_partkey, p_size * 11 % 512 AS mode, p_partkey % 20 AS uid, p_partkey % 3 + 1 AS nlink, 'user.brand' AS xattr, p_brand AS value, 'O:BA' AS sddl, p_size AS stream, p_partkey % 2 = 0 AS dated,
TIMESTAMP '2024-01-01 00:00:00' + to_seconds(p_partkey) AS atime FROM part""")
def s14(spark, sf):
    """Attribute records with maps and a record within, encoded and decoded again."""
    k, i = F.col("p_partkey"), lambda c: c.cast("long")
    pair = lambda a, b: F.array(F.struct(F.lit(a).alias("key"), b.alias("value")))
    record = F.struct(
        i(F.col("p_size") * 11 % 512).alias("mode"), (k % 20).alias("uid"), (k % 3 + 1).alias("nlink"), pair("user.brand", F.col("p_brand").cast("binary")).alias("xattrs"), pair("main", i(F.col("p_size"))).alias("streams"),
        F.timestamp_seconds(F.lit(1704067200) + k).alias("atime"), F.struct(F.lit("O:BA").alias("sddl")).alias("windows"), (k % 2 == 0).alias("dated"), F.lit(1).cast("long").alias("layout"),
    )
    r = table(spark, sf, "part").select("p_partkey", records.encoder("metadata")(record).alias("body")).select("p_partkey", records.decoder("metadata")(F.col("body")).alias("r"))
    return r.select(
        "p_partkey", F.col("r.mode").cast("int").alias("mode"), "r.uid", "r.nlink", F.col("r.xattrs")[0]["key"].alias("xattr"), F.col("r.xattrs")[0]["value"].cast("string").alias("value"), F.col("r.windows.sddl").alias("sddl"),
        F.col("r.streams")[0]["value"].cast("int").alias("stream"), "r.dated", F.col("r.atime").cast(NTZ).alias("atime"),
    )


@query("s16_name_codec", "SELECT event_id, event_type || '-' || event_id AS name, date_trunc('second', ts) AS time FROM events")
def s16_names(spark, sf):
    record = F.struct(F.concat_ws("-", "event_type", F.col("event_id").cast("string")).alias("name"), F.date_trunc("second", F.col("ts").cast("timestamp")).alias("time"), F.lit(1).cast("long").alias("layout"))
    body = records.encoder("name")(record)
    return table(spark, sf, "events").select("event_id", records.decoder("name")(body).alias("r")).select("event_id", "r.name", F.col("r.time").cast(NTZ).alias("time"))


@query("s16_origin_codec", "SELECT l_orderkey, l_linenumber, 'd' || (l_partkey % 3) AS drive, 'i' || l_orderkey AS item_id, l_linenumber > 3 AS alias, count(*) AS n FROM lineitem GROUP BY ALL")
def s16_origins(spark, sf):
    s = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    record = F.struct(s("d", F.col("l_partkey") % 3).alias("drive"), s("i", F.col("l_orderkey")).alias("item_id"), (F.col("l_linenumber") > 3).alias("alias"), F.lit(1).cast("long").alias("layout"))
    r = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", records.decoder("origin")(records.encoder("origin")(record)).alias("r"))
    return r.groupBy("l_orderkey", "l_linenumber", "r.drive", "r.item_id", "r.alias").agg(F.count("*").alias("n"))


@query("s16_refs_codec", "SELECT l_orderkey AS target, count(*) AS referrers, count(*) FILTER (l_returnflag = 'R') AS pending FROM lineitem GROUP BY l_orderkey")
def s16_refs(spark, sf):
    one = F.struct(F.col("l_partkey").cast("string").alias("referrer_key"), F.col("l_linenumber").cast("string").alias("referrer_version"), (F.col("l_returnflag") == "R").alias("pending"))
    b = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(one).alias("referrers"))
    b = b.select("l_orderkey", records.encoder("refs")(F.struct("referrers", F.lit(1).cast("long").alias("layout"))).alias("body"))
    rows = b.select("l_orderkey", F.explode(records.decoder("refs")(F.col("body"))["referrers"]).alias("r"))
    return rows.groupBy(F.col("l_orderkey").alias("target")).agg(F.count("*").alias("referrers"), F.count_if("r.pending").alias("pending"))


@query("s17_stub_codec", f"SELECT idx, version AS version_id, size FROM ({C_SQL}) WHERE stub")
def s17(spark, sf):
    c = contents(spark, sf).where("stub")
    body = records.encoder("stub")(F.struct(F.lit(1).cast("long").alias("layout"), F.col("item").alias("key"), F.col("version").alias("version_id"), "size"))
    return c.select("idx", records.decoder("stub")(body).alias("r")).select("idx", "r.version_id", "r.size")


@query("l04_notifications", "SELECT 'drive/' || user_id || '/' || event_type AS key, count(*) AS n FROM events WHERE event_id % 5 <> 0 GROUP BY 1")
def l04(spark, sf):
    """Signals out of landed notifications; a fifth of the bodies is no JSON and is dropped."""
    key = F.concat_ws("/", F.lit("drive"), F.col("user_id").cast("string"), "event_type")
    body = F.when(F.col("event_id") % 5 == 0, "{not json").otherwise(F.format_string('{"Records":[{"s3":{"object":{"key":"%s"}}},{"s3":{"object":{"key":"other/x"}}}]}', key))
    return feed.signals(table(spark, sf, "events").select(body.alias("body")), "drive/").groupBy("key").agg(F.count("*").alias("n"))


@query("l07_change_feed_coalesced", "SELECT DISTINCT user_id AS key FROM events")
def l07(spark, sf):
    """The tables are one burst: one wake-up for each key."""
    stream = feed.read(spark, f"{sf}/events.parquet").select(F.col("user_id").alias("key"))
    return feed.coalesced(stream, "coalesced").select("key")


@query("l06_change_events", "SELECT event_id, user_id AS id, '/' || user_id || '/' || event_type AS path FROM events WHERE event_type <> 'error'")
def l06(spark, sf):
    e = feed.read(spark, f"{sf}/events.parquet").where("event_type <> 'error'")
    return feed.drained(e.select("event_id", F.col("user_id").alias("id"), F.concat(F.lit("/"), F.col("user_id").cast("string"), F.lit("/"), "event_type").alias("path")), "changes")


@query("l08_debounced_marks", """WITH RECURSIVE m AS (SELECT user_id AS key, epoch_us(ts) // 36000 AS t FROM events), s(key, sent) AS (SELECT key, min(t) FROM m GROUP BY key
UNION ALL SELECT key, greatest(sent + 1000000, next) FROM (SELECT s.key, s.sent, (SELECT min(m.t) FROM m WHERE m.key = s.key AND m.t > s.sent) AS next FROM s) WHERE next IS NOT NULL) SELECT key, sent FROM s""")
def l08(spark, sf):
    """Marks of keys, ten hours of the events taken as a second: a mark is sent at once, then at most one a second."""
    e = feed.read(spark, f"{sf}/events.parquet")
    marks = e.select(F.col("user_id").alias("key"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 36000).alias("at"))
    return feed.drained(feed.debounced(marks), "debounced")


@query("l01_signal_source", "SELECT 'drive/' || user_id || '/' || event_id AS key FROM events WHERE user_id % 10 = 3")
def l01(spark, sf):
    """Signals of a source: a stream of keys below a prefix, out of a landed log of changes."""
    return feed.drained(feed.source(_feed_log(spark, sf), "drive/", F.col("user") % 10 == 3), "signals")


def _feed_log(spark, sf):
    e = feed.read(spark, f"{sf}/events.parquet")
    return e.select(F.concat_ws("/", F.lit("drive"), F.col("user_id").cast("string"), F.col("event_id").cast("string")).alias("key"), F.col("event_type").alias("kind"), F.col("user_id").alias("user"), F.col("event_id").alias("cursor"))


@query("l02_fan_out", """SELECT reader, count(*) AS got FROM (SELECT 'drive/' || user_id AS key, event_id, row_number() OVER (ORDER BY event_id) AS n FROM events WHERE user_id % 2 = 0), (VALUES ('all', 9223372036854775807), ('slow', 32)) r(reader, most) WHERE n <= most GROUP BY reader""")
def l02(spark, sf):
    """One source for several readers: one that keeps up, and one whose buffer of 32 holds the first of a burst."""
    keys = _feed_log(spark, sf).where("user % 2 = 0").select("key", "cursor")
    return feed.fanned_out(keys, {"all": None, "slow": 32}, "fan-out").groupBy("reader").agg(F.count("*").alias("got"))


@query("l03_bucket_notifications", "SELECT 'drive/' || user_id || '/' || event_id AS key FROM events WHERE event_type IN ('click', 'error') AND starts_with('drive/' || user_id || '/' || event_id, 'drive/1')")
def l03(spark, sf):
    """Notifications of a bucket: those of the kinds subscribed to, below a prefix, filtered where they are read."""
    return feed.drained(feed.source(_feed_log(spark, sf), "drive/1", F.col("kind").isin("click", "error")), "notices")


@query("l05_change_feed_cursor", "SELECT 'drive/' || user_id || '/' || event_id AS key, event_id > (SELECT max(event_id) // 2 FROM events) AS second FROM events")
def l05(spark, sf):
    """A change feed read from a stored cursor: two runs, each from where the last one stopped; none is lost or read twice."""
    top = table(spark, sf, "events").agg(F.max("event_id")).first()[0] or 0
    log = table(spark, sf, "events").select(F.concat_ws("/", F.lit("drive"), F.col("user_id").cast("string"), F.col("event_id").cast("string")).alias("key"), F.col("event_id").alias("cursor"))
    state = feed.Cursor(spark, "feed")
    runs = [feed.since(log.where(F.col("cursor") <= upto), state) for upto in (top // 2, top)]
    return runs[0].select("key", F.lit(False).alias("second")).unionAll(runs[1].select("key", F.lit(True).alias("second")))


@query("l09_past_change_check", f"SELECT key, max(seq) AS mark, max(seq) <> max(CASE WHEN last_modified <= TIMESTAMP '2024-01-20 00:00:00' THEN seq END) AS moved FROM ({V_SQL}) GROUP BY key")
def l09(spark, sf):
    seen = F.max(F.when(F.col("last_modified") <= ts("2024-01-20 00:00:00"), F.col("seq")))
    return versions(spark, sf).groupBy("key").agg(F.max("seq").alias("mark"), (F.max("seq") != seen).alias("moved"))


@query("l10_declared_time", f"SELECT key, seq, eff AS event_time, last_modified AS stored_time FROM ({EFF_SQL})")
def l10(spark, sf):
    return T.effective(versions(spark, sf), dates(spark, sf)).select("key", "seq", F.col("eff").alias("event_time"), F.col("last_modified").alias("stored_time"))


_LATE = f"""SELECT * FROM (SELECT key AS folder, seq, epoch_us(eff) AS "at", max(epoch_us(eff)) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS until FROM ({EFF_SQL})) WHERE "at" < until"""


def _changes(spark, sf):
    """Changes with their declared times, as a stream; the declared time is computed in the stream itself."""
    e = feed.read(spark, f"{sf}/events.parquet").withColumn("k", F.regexp_extract("props", "([0-9]+)", 1).cast("int"))
    second = F.unix_seconds(F.date_trunc("second", F.col("ts").cast("timestamp")))
    at = F.when(F.col("k") % 10 == 0, second - F.col("k") * 3600).otherwise(second) * 1_000_000
    return e.select(F.col("user_id").alias("folder"), F.col("event_id").alias("seq"), at.alias("at"))


@query("l11_late_changes", _LATE)
def l11(spark, sf):
    return feed.drained(feed.late_changes(_changes(spark, sf)), "late")


@query("l12_late_refusal", f"SELECT e.key AS folder, count(*) AS accepted FROM ({EFF_SQL}) e WHERE e.seq NOT IN (SELECT seq FROM ({_LATE})) GROUP BY e.key")
def l12(spark, sf):
    all_ = T.effective(versions(spark, sf), dates(spark, sf)).select(F.col("key").alias("folder"), "seq")
    return feed.refused(all_, l11(spark, sf))[0].groupBy("folder").agg(F.count("*").alias("accepted"))


@query("l13_late_settle", q_temporal.SETTLED_SQL)
def l13(spark, sf):
    """The late changes applied to the past states they belong to: all at once, which equals any batches in their order."""
    return q_temporal.settled(spark, sf)


@query("l14_leftover_dating", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN ts WHEN event_id % 3 = 1 THEN date_trunc('hour', ts) END AS \"at\", event_id % 3 = 2 AS undatable FROM events")
def l14(spark, sf):
    k = F.col("event_id") % 3
    rows = table(spark, sf, "events").select("event_id", "ts", F.when(k == 0, F.col("ts")).alias("at"))
    return feed.dated(rows, F.when(k == 1, F.date_trunc("hour", "ts").cast(NTZ))).select("event_id", "at", "undatable")


@query("l15_unfinished_sweep", f"""SELECT key, seq FROM ({V_SQL}) v WHERE last_modified < TIMESTAMP '2024-01-09 23:55:00' AND seq % 4 = 0 AND (SELECT count(*) FROM ({V_SQL}) o WHERE o.key = v.key) > 1""")
def l15(spark, sf):
    v = versions(spark, sf)
    return feed.unfinished(v, v.where("seq % 4 <> 0").select("key", "seq"), ts("2024-01-10 00:00:00")).select("key", "seq")


@query("l16_sync_pass_loop", "SELECT event_type AS kind, count(*) AS n FROM events GROUP BY 1")
def l16(spark, sf):
    """Passes over micro-batches: each adds its own report to the shared folder; the reports add up."""
    import uuid

    from tidemark.operators.shared import shared_folder

    out = f"{shared_folder(spark)}/passes-{uuid.uuid4().hex}"
    stream = feed.read(spark, f"{sf}/events.parquet").select(F.col("event_type").alias("kind"))
    feed.drained(stream, "passes", each=lambda df, n: df.groupBy("kind").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{out}/pass={n}"))
    return spark.read.parquet(f"{out}/pass=*").groupBy("kind").agg(F.sum("n").alias("n"))


_LOG_SQL = "SELECT user_id AS key, event_id AS seq, CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'v' || (event_id % 5) ELSE '' END AS expect, 'v' || (event_id % 4) AS version FROM events"


def accepted_sql(log: str) -> str:
    """Each write of a key met with what the ones before it left, one after the other."""
    return f"""WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) AS n FROM ({log})), s(key, seq, n, cur, accepted) AS (
SELECT key, seq, n, CASE WHEN coalesce(expect, '') = '' THEN version ELSE '' END, coalesce(expect, '') = '' FROM o WHERE n = 1
UNION ALL SELECT o.key, o.seq, o.n, CASE WHEN o.expect IS NULL OR o.expect = s.cur THEN o.version ELSE s.cur END, o.expect IS NULL OR o.expect = s.cur FROM s JOIN o ON o.key = s.key AND o.n = s.n + 1)
SELECT key, seq, accepted FROM s"""


def _log(spark, sf):
    e, k = table(spark, sf, "events"), F.col("event_id")
    expect = F.when(k % 3 == 0, None).when(k % 3 == 1, F.concat(F.lit("v"), (k % 5).cast("string"))).otherwise("")
    return e.select(F.col("user_id").alias("key"), k.alias("seq"), expect.alias("expect"), F.concat(F.lit("v"), (k % 4).cast("string")).alias("version"))


@query("m01_conditional_writes", accepted_sql(_LOG_SQL))
def m01(spark, sf):
    return M.conditional_writes(_log(spark, sf))


@query("m02_mkdir_parents", "SELECT DISTINCT p AS path FROM (SELECT unnest(['/new', '/new/' || o_orderstatus, '/new/' || o_orderstatus || '/' || (o_orderkey % 50)]) AS p FROM orders) WHERE p <> '/new/F'")
def m02(spark, sf):
    want = table(spark, sf, "orders").select(F.concat(F.lit("/new/"), "o_orderstatus", F.lit("/"), (F.col("o_orderkey") % 50).cast("string")).alias("path"))
    return M.with_parents(want, spark.sql("SELECT '/new/F' AS path"))


@query("m03_moves", f"SELECT CASE WHEN id = 'n2' THEN 'r0' WHEN id LIKE 'c1%' AND length(id) = 3 THEN 'n0' ELSE parent END AS parent, id, CASE WHEN id = 'n2' THEN 'moved' WHEN id LIKE 'c1%' AND length(id) = 3 THEN 'moved-' || id ELSE name END AS name, type FROM ({E_SQL}) WHERE type = 'dir'")
def m03(spark, sf):
    e = entries(spark, sf)
    some = e.where(F.col("id").startswith("c1") & (F.length("id") == 3)).select("id", F.lit("n0").alias("to_parent"), F.concat(F.lit("moved-"), "id").alias("to_name"))
    moves = some.unionAll(spark.sql("SELECT * FROM VALUES ('n2', 'r0', 'moved'), ('r1', 'r1', 'self'), ('r0', 'n0', 'below') AS t(id, to_parent, to_name)"))
    below = tree.ancestors(walked(spark, sf, 3)).unionAll(spark.sql("SELECT 'r0' AS ancestor, 'n0' AS id"))
    return M.moved(e, moves, below).where("type = 'dir'")


@query("m04_recursive_delete", f"{WALK_SQL} SELECT 'e-' || id AS entry_id, id AS item, 'e-n4' AS batch FROM w WHERE id = 'n4' OR starts_with(path, (SELECT path FROM w WHERE id = 'n4') || '/')")
def m04(spark, sf):
    return M.deleted(entries(spark, sf), "n4", ts("2024-02-01 00:00:00")).select("entry_id", "item", "batch")


@query("m06_purge", f"SELECT key, seq FROM ({V_SQL}) WHERE key % 5 <> 0 OR seq % 6 = 0")
def m06(spark, sf):
    v = versions(spark, sf).select("key", "seq")
    return M.purged(v, v.where("key % 5 = 0").select("key").distinct(), v.where("seq % 6 = 0"))


@query("m07_named_versions", "SELECT source || '-' || doc_id AS name, CASE WHEN doc_id % 9 = 0 THEN 'taken' WHEN doc_id % 50 > 40 THEN 'future' WHEN doc_id % 50 < 5 THEN 'early' ELSE 'created' END AS outcome FROM documents")
def m07(spark, sf):
    name = F.concat_ws("-", "source", F.col("doc_id").cast("string")).alias("name")
    d = table(spark, sf, "documents")
    want = d.select(name, (F.col("doc_id") % 50).alias("time"))
    return M.named(d.where("doc_id % 9 = 0").select(name), want, F.lit(5), F.lit(40), version_name_ok(F.col("name")))


@query("m08_link_count", "SELECT l_partkey AS item, count(*) AS nlink FROM lineitem GROUP BY l_partkey")
def m08(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("item")).agg(F.count("*").alias("nlink"))


_LINKS = "SELECT l_orderkey AS dir, CAST(l_linenumber AS VARCHAR) AS name, min(l_partkey) AS item FROM lineitem GROUP BY 1, 2"


@query("m08_link_unlink", f"""WITH e AS ({_LINKS}), k AS (SELECT * FROM e WHERE NOT (dir % 3 = 0 OR item % 7 = 0)), n AS (SELECT dir, 'link' AS name, min(item) AS item FROM e WHERE dir % 5 = 0 GROUP BY dir), a AS (SELECT * FROM k UNION ALL SELECT * FROM n)
SELECT i.item, count(a.item) AS nlink, count(a.item) = 0 AS gone FROM (SELECT DISTINCT item FROM e) i LEFT JOIN a ON a.item = i.item GROUP BY i.item""")
def m08_links(spark, sf):
    """Names added to items and taken away: the links that are left, and the items that have none."""
    e = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("dir"), F.col("l_linenumber").cast("string").alias("name")).agg(F.min("l_partkey").alias("item"))
    new = e.where("dir % 5 = 0").groupBy("dir").agg(F.min("item").alias("item")).select("dir", F.lit("link").alias("name"), "item")
    return M.link_counts(e, new, e.where("dir % 3 = 0 or item % 7 = 0").select("dir", "name"))


@query("m07_name_removal", "SELECT source || '-' || doc_id AS name, CASE WHEN doc_id % 9 = 0 THEN 'removed' ELSE 'missing' END AS outcome FROM documents WHERE doc_id % 2 = 0")
def m07_removal(spark, sf):
    name = F.concat_ws("-", "source", F.col("doc_id").cast("string")).alias("name")
    d = table(spark, sf, "documents")
    return M.unnamed(d.where("doc_id % 9 = 0").select(name), d.where("doc_id % 2 = 0").select(name))


@query("m10_set_info", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'new' ELSE event_type END AS type, CASE WHEN event_id % 4 <> 0 THEN 'x' END AS note FROM events")
def m10(spark, sf):
    k = F.col("event_id")
    old = F.create_map(F.lit("type"), F.col("event_type"), F.lit("note"), F.lit("x"))
    empty = F.expr("cast(map() as map<string,string>)")
    change = F.map_concat(F.when(k % 3 == 0, F.create_map(F.lit("type"), F.lit("new"))).otherwise(empty), F.when(k % 4 == 0, F.create_map(F.lit("note"), F.lit(None).cast("string"))).otherwise(empty))
    new = M.edited(old, change)
    return table(spark, sf, "events").select("event_id", F.element_at(new, "type").alias("type"), F.try_element_at(new, F.lit("note")).alias("note"))


@query("m11_reference_writes", f"""SELECT c.idx, CASE WHEN t.idx IS NULL THEN 'missing' WHEN t.stub THEN 'stub' WHEN t.sha256 <> c.sha256 THEN 'different' ELSE 'written' END AS outcome
FROM ({C_SQL}) c LEFT JOIN ({C_SQL}) t ON t.idx = CASE WHEN c.idx % 3 = 0 THEN c.idx ELSE c.idx * 3 END""")
def m11(spark, sf):
    c = contents(spark, sf)
    return M.stub_writes(c.select("idx", "sha256", F.when(F.col("idx") % 3 == 0, F.col("idx")).otherwise(F.col("idx") * 3).alias("target")), c)


@query("m15_copy_at", f"SELECT key + 100000 AS key, seq AS origin_version, key AS origin, size FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY eff DESC, seq DESC) AS rn FROM ({EFF_SQL}) WHERE eff <= TIMESTAMP '2024-01-12 00:00:00') WHERE rn = 1 AND NOT deleted")
def m15(spark, sf):
    now = T.as_of(T.effective(versions(spark, sf), dates(spark, sf)), "2024-01-12 00:00:00")
    return now.select((F.col("key") + 100000).alias("key"), F.col("seq").alias("origin_version"), F.col("key").alias("origin"), "size")


@query("m16_drafts", "SELECT item, string_agg(u, ',' ORDER BY u) AS users FROM (SELECT event_id % 100 AS item, user_id AS u, arg_max(event_type, event_id) AS last FROM events GROUP BY 1, 2) WHERE last <> 'error' GROUP BY item")
def m16(spark, sf):
    last = T.newest(table(spark, sf, "events").select((F.col("event_id") % 100).alias("item"), F.col("user_id").alias("u"), "event_id", "event_type"), ["item", "u"], [F.col("event_id")], ["item", "u", "event_type"])
    return last.where("event_type <> 'error'").groupBy("item").agg(F.array_join(F.array_sort(F.collect_list("u")), ",").alias("users"))


_DRAFTS_SQL = "SELECT event_id % 100 AS key, event_id AS seq, CASE WHEN event_id % 7 = 0 THEN '' ELSE 'd' || (event_id % 3) END AS expect, 'd' || (event_id % 4) AS version FROM events WHERE event_type <> 'error'"


@query("m16_draft_publish", accepted_sql(_DRAFTS_SQL))
def m16_publish(spark, sf):
    """Drafts published in order, each if the version that it was begun from still is the item's."""
    e, k = table(spark, sf, "events").where("event_type <> 'error'"), F.col("event_id")
    base = F.when(k % 7 == 0, "").otherwise(F.concat(F.lit("d"), (k % 3).cast("string")))
    return M.conditional_writes(e.select((k % 100).alias("key"), k.alias("seq"), base.alias("expect"), F.concat(F.lit("d"), (k % 4).cast("string")).alias("version")))


@query("m17_range_locks", q_catalog.merged_sql(50, 700, 90, "NOT escalation_only"))
def m17(spark, sf):
    k = claims(spark, sf).where("not escalation_only")
    end = F.when(F.col("end") < 0, F.col("end")).otherwise(F.col("start") % 700 + 90)
    return G.merged_claims(k.withColumn("file", F.col("id") % 50).withColumn("end", end).withColumn("start", F.col("start") % 700))


@query("m17_acquire", f"""WITH c AS (SELECT * FROM ({W_SQL}) WHERE NOT escalation_only AND expires_at_ms > {q_catalog.NOW_MS}), q AS (SELECT file, id, holder + id % 2 AS holder, start, "end", shared FROM ({W_SQL}))
SELECT file, id, CASE WHEN EXISTS (SELECT 1 FROM c WHERE c.file = q.file AND c.start < q."end" AND q.start < c."end" AND c.holder <> q.holder AND NOT (c.shared AND q.shared)) THEN 'refused'
WHEN EXISTS (SELECT 1 FROM c WHERE c.file = q.file AND c.start = q.start AND c."end" = q."end" AND c.holder = q.holder AND c.shared = q.shared) THEN 'renewed' ELSE 'granted' END AS outcome FROM q""")
def m17_acquire(spark, sf):
    """Every claim asked for again, half of them by another holder, whole files among them."""
    k = claims(spark, sf)
    return G.acquired(k.withColumn("holder", F.col("holder") + F.col("id") % 2).select("file", "id", "holder", "start", "end", "shared"), k, q_catalog.NOW_MS)


@query("m17_lock_ranges_held", f'SELECT file, holder, CAST(sum("end" - start) AS BIGINT) AS bytes, count(*) AS claims FROM ({K_SQL}) GROUP BY 1, 2')
def m17_held(spark, sf):
    return locks(spark, sf).groupBy("file", "holder").agg(F.sum(F.col("end") - F.col("start")).alias("bytes"), F.count("*").alias("claims"))


@query("m20_map_edits", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 2 END AS n FROM events")
def m20(spark, sf):
    two = F.create_map(F.lit("user.a"), F.lit("1"), F.lit("user.b"), F.lit("2"))
    drop = F.create_map(F.lit("user.b"), F.lit(None).cast("string"))
    return table(spark, sf, "events").select("event_id", F.size(F.when(F.col("event_id") % 2 == 0, M.edited(two, drop)).otherwise(two)).alias("n"))


@query("m21_app_objects", f"SELECT key, count(*) AS versions, max(seq) AS newest FROM ({V_SQL}) WHERE NOT deleted GROUP BY key")
def m21(spark, sf):
    return versions(spark, sf).where("not deleted").groupBy("key").agg(F.count("*").alias("versions"), F.max("seq").alias("newest"))


@query("m21_conditional_put", f"SELECT key, count(*) AS puts, count(*) FILTER (accepted) AS accepted, max(seq) FILTER (accepted) AS newest FROM ({accepted_sql(_LOG_SQL)}) GROUP BY key")
def m21_put(spark, sf):
    """Small objects put if absent, if unchanged, or whatever there is: what of each key's puts was taken."""
    got = M.conditional_writes(_log(spark, sf))
    return got.groupBy("key").agg(F.count("*").alias("puts"), F.count_if("accepted").alias("accepted"), F.max(F.when(F.col("accepted"), F.col("seq"))).alias("newest"))


@query("m22_current_after_late", f"SELECT key, arg_max(seq, (eff, seq)) AS seq FROM ({EFF_SQL}) GROUP BY key")
def m22(spark, sf):
    return T.newest(T.effective(versions(spark, sf), dates(spark, sf)), ["key"], [F.col("eff"), F.col("seq")], ["key", "seq"])


@query("w15_settle_proof", f"""SELECT dir AS folder, count(DISTINCT t) AS states, true AS holds FROM (SELECT dir, unnest([from_at, to_at]) AS t FROM ({q_temporal.SETTLED_SQL}) UNION ALL
SELECT dir, unnest([from_at, to_at]) FROM ({q_temporal.ORACLE['w08_lifetimes']}) UNION ALL SELECT dir, unnest(["at", until]) FROM ({q_temporal.LATE_SQL})) WHERE t IS NOT NULL GROUP BY dir""")
def w15(spark, sf):
    """The late changes proved: each state of each folder rebuilt from the one before and the changes replayed."""
    before, late = q_temporal.QUERIES["w08_lifetimes"](spark, sf), q_temporal.late_entries(spark, sf)
    return T.settle_proof(before, T.fill_in(before, late), late).select(F.col("dir").alias("folder"), "states", "holds")


@query("w16_settled_states", q_temporal.states_sql(q_temporal.SETTLED_SQL))
def w16(spark, sf):
    """A settle as a whole: late changes played in at their own dates, and the states of every folder after it."""
    return T.folder_states(q_temporal.settled(spark, sf))


@query("w21_version_resolution", f"SELECT key, seq, size FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY eff DESC, seq DESC) AS rn FROM ({EFF_SQL}) WHERE eff <= TIMESTAMP '2024-01-11 00:00:00' - INTERVAL 1 MICROSECOND) WHERE rn = 1 AND NOT deleted")
def w21(spark, sf):
    """A moment given as text, here a bare day, is resolved when the query is planned."""
    from tidemark.functions.values import as_of_moment

    at = as_of_moment(F.lit("2024-01-10"))
    return T.as_of(T.effective(versions(spark, sf), dates(spark, sf)), at).select("key", "seq", "size")


@query("x04_registered_hash", "SELECT doc_id, md5(source) AS h FROM documents")
def x04(spark, sf):
    """A hash registered by the caller, as a pandas function over a column."""
    import hashlib

    def digest(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: hashlib.md5(t.encode()).hexdigest())

    spark.udf.register("caller_hash", F.pandas_udf(digest, "string"))
    table(spark, sf, "documents").createOrReplaceTempView("documents_to_hash")
    return spark.sql("SELECT doc_id, caller_hash(source) AS h FROM documents_to_hash")


@query("x05_row_predicate", "SELECT 'e' || o_orderkey AS entry_id FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 100 = 1")
def x05(spark, sf):
    from tidemark.operators.trash import listed

    t = trash(spark, sf)
    return listed(t, t.where("live").select("item"), keep=F.substring("entry_id", 2, 20).cast("long") % 100 == 1).select("entry_id")


@query("j02_item_attributes", "SELECT o.o_orderkey AS id, greatest(o.o_orderdate, max(l.l_shipdate)) AS changed, CAST(sum(floor(l.l_extendedprice)) AS BIGINT) AS size FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY o.o_orderkey, o.o_orderdate")
def j02(spark, sf):
    """Metadata joined with the content's head: sums by key first, so the join meets one row for each item."""
    content = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.max("l_shipdate").alias("written"), F.sum(F.floor("l_extendedprice")).alias("size"))
    meta = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("stored"))
    return meta.join(content, "id").select("id", F.greatest("stored", "written").alias("changed"), F.col("size").cast("long").alias("size"))
