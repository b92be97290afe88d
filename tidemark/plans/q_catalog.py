"""Queries on trash, origins, usage, filesystems, integrity and locks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import integrity as I
from tidemark.operators import ranges as G
from tidemark.operators import trash as X
from tidemark.operators.temporal import as_of, effective, newest
from tidemark.sources.adapters import E_SQL, EFF_SQL, K_SQL, T_SQL, V_SQL, W_SQL, claims, dates, entries, locks, table, trash, versions

from .catalog import Catalog
from .q_tree import WALK_SQL, walked

catalog = Catalog()
QUERIES, ORACLE, query = catalog.queries, catalog.oracle, catalog.query

NOW_MS = 1704067200000 + 5 * 86400000
_LIVE_SQL = f"SELECT item FROM ({T_SQL}) WHERE live"
_KEY_SQL = "lpad(CAST(9223372036854775807 - epoch_us(deleted_at) * 1000 AS VARCHAR), 19, '0') || '-' || entry_id"


def live_items(spark, sf):
    return trash(spark, sf).where("live").select("item")


@query("p04_trash_filters", f"SELECT entry_id, item FROM ({T_SQL}) WHERE starts_with(path, '/c1') AND (path = '/c11' OR starts_with(path, '/c11/')) AND pass = 'p2' AND item NOT IN ({_LIVE_SQL})")
def p04(spark, sf):
    return X.listed(trash(spark, sf), live_items(spark, sf), prefix="/c11", pass_="p2").select("entry_id", "item")


@query("p05_trash_scope", f"SELECT entry_id, CASE WHEN starts_with(path, '/c2/') THEN substr(path, 4) END AS path, starts_with(path, '/c2/') AS visible FROM ({T_SQL})")
def p05(spark, sf):
    inside = F.col("path").startswith("/c2/")
    return trash(spark, sf).select("entry_id", F.when(inside, F.expr("substr(path, 4)")).alias("path"), inside.alias("visible"))


@query("p06_name_scope", "SELECT page_id, url = 'https:/' OR starts_with(url, 'https:/' || '/') OR starts_with('https:/', url || '/') AS visible FROM pages")
def p06(spark, sf):
    u, root = F.col("url"), F.lit("https:/")
    return table(spark, sf, "pages").select("page_id", ((u == root) | u.startswith("https://") | root.startswith(F.concat(u, F.lit("/")))).alias("visible"))


@query("p10_item_liveness", f"SELECT DISTINCT t.item FROM ({T_SQL}) t JOIN ({E_SQL}) e ON e.id = t.item AND (e.type = 'dir' OR CAST(substr(e.id, 2) AS BIGINT) % 7 <> 0)")
def p10(spark, sf):
    alive = entries(spark, sf).where((F.col("type") == "dir") | (F.substring("id", 2, 20).cast("long") % 7 != 0)).select(F.col("id").alias("item"))
    return trash(spark, sf).join(alive, "item", "left_semi").select("item").distinct()


@query("o04_trash_page", f"""WITH k AS (SELECT {_KEY_SQL} AS key, entry_id, item FROM ({T_SQL}) WHERE NOT live), p AS (SELECT *, row_number() OVER (ORDER BY key) AS rn FROM k)
SELECT key, entry_id, item, CASE WHEN rn = 25 THEN key END AS next FROM p WHERE rn <= 25""")
def o04(spark, sf):
    return X.page(trash(spark, sf), live_items(spark, sf), "", 25)


_ROOTS = f"SELECT entry_id, item, row_number() OVER (ORDER BY deleted_at, entry_id) AS pos FROM ({T_SQL}) WHERE pass = 'p1' AND (batch IS NULL OR batch = entry_id)"


@query("m14_trash_undo_roots", _ROOTS)
def m14(spark, sf):
    return X.undo_roots(trash(spark, sf), "p1")


@query("m14_undo_pass", f"""WITH r AS (SELECT * FROM ({T_SQL}) WHERE coalesce(batch, entry_id) IN (SELECT entry_id FROM ({_ROOTS})))
SELECT entry_id, item, path, CASE WHEN CAST(substr(item, 2) AS BIGINT) % 5 = 0 THEN 'taken' WHEN row_number() OVER (PARTITION BY path ORDER BY deleted_at DESC, entry_id DESC) > 1 THEN 'older' ELSE 'restored' END AS outcome FROM r""")
def m14_undo(spark, sf):
    """A pass undone: the roots with all of their batches, whichever pass removed those."""
    t = trash(spark, sf)
    return X.undone(t, "p1", t.where(F.substring("item", 2, 20).cast("long") % 5 == 0).select("path"))


@query("m05_restore_batch", f"SELECT item, path, CASE WHEN CAST(substr(item, 2) AS BIGINT) % 2 = 0 THEN 'taken' ELSE 'restored' END AS outcome FROM ({T_SQL}) WHERE batch = 'e16'")
def m05(spark, sf):
    t = trash(spark, sf)
    return X.restored(t, "e16", t.where(F.substring("item", 2, 20).cast("long") % 2 == 0).select("path"))


_ORIGINS = "SELECT 'd' || (l_partkey % 3) AS drive, l_partkey AS id, 'i' || l_orderkey AS item, l_linenumber > 3 AS alias, l_returnflag <> 'R' AS live FROM lineitem WHERE l_linenumber <= 5"
_OTRASH = "SELECT 'd' || (l_partkey % 3) AS drive, l_partkey AS id, 'e' || l_orderkey AS entry_id, l_shipdate AS deleted_at FROM lineitem WHERE l_linenumber > 5"


@query("j15_origin_lookup", f"""WITH w AS (SELECT 'd' || (p_partkey % 3) AS drive, p_partkey AS id FROM part), l AS (SELECT drive, id, arg_min(item, (alias, item)) AS item FROM ({_ORIGINS}) WHERE live GROUP BY 1, 2),
t AS (SELECT drive, id, arg_max(entry_id, (deleted_at, entry_id)) AS entry FROM ({_OTRASH}) GROUP BY 1, 2)
SELECT w.drive, w.id, l.item, CASE WHEN l.item IS NULL THEN t.entry END AS entry_id FROM w LEFT JOIN l ON w.drive = l.drive AND w.id = l.id LEFT JOIN t ON w.drive = t.drive AND w.id = t.id""")
def j15(spark, sf):
    li, p = table(spark, sf, "lineitem"), table(spark, sf, "part")
    s = lambda c: F.col(c).cast("string")
    drive = lambda c: F.concat(F.lit("d"), (F.col(c) % 3).cast("string")).alias("drive")
    origins = li.where("l_linenumber <= 5").select(drive("l_partkey"), F.col("l_partkey").alias("id"), F.concat(F.lit("i"), s("l_orderkey")).alias("item"), (F.col("l_linenumber") > 3).alias("alias"), (F.col("l_returnflag") != "R").alias("live"))
    gone = li.where("l_linenumber > 5").select(drive("l_partkey"), F.col("l_partkey").alias("id"), F.concat(F.lit("e"), s("l_orderkey")).alias("entry_id"), F.col("l_shipdate").alias("deleted_at"))
    return X.by_origin(p.select(drive("p_partkey"), F.col("p_partkey").alias("id")), origins, gone)


_MIRROR = """WITH s AS (SELECT p_partkey AS id, '/' || p_brand AS path, p_size AS version, p_partkey % 50 AS mtime FROM part WHERE p_partkey % 7 <> 0),
m AS (SELECT p_partkey AS id, '/' || CASE WHEN p_partkey % 5 = 0 THEN 'old' ELSE p_brand END AS path, p_size + CASE WHEN p_partkey % 4 = 0 THEN 1 ELSE 0 END AS version, p_partkey % 50 + CASE WHEN p_partkey % 6 = 0 THEN 1 ELSE 0 END AS mtime FROM part WHERE p_partkey % 3 <> 0),
b AS (SELECT coalesce(s.id, m.id) AS id, s.id AS si, m.id AS mi, s.path <> m.path AS moved, s.version <> m.version AS updated, s.mtime <> m.mtime AS retimed FROM s FULL OUTER JOIN m ON s.id = m.id)
SELECT id, CASE WHEN si IS NULL THEN 'removed' WHEN mi IS NULL THEN CASE WHEN id % 2 = 0 THEN 'restored' ELSE 'created' END
WHEN NOT moved AND NOT updated AND NOT retimed THEN 'unchanged' ELSE concat_ws(',', CASE WHEN moved THEN 'moved' END, CASE WHEN updated THEN 'updated' WHEN retimed THEN 'retimed' END) END AS actions FROM b"""


@query("m13_mirror_apply", _MIRROR)
def m13(spark, sf):
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    source = p.where("p_partkey % 7 <> 0").select(k.alias("id"), F.concat(F.lit("/"), "p_brand").alias("path"), F.col("p_size").alias("version"), (k % 50).alias("mtime"))
    mirror = p.where("p_partkey % 3 <> 0").select(k.alias("id"), F.concat(F.lit("/"), F.when(k % 5 == 0, "old").otherwise(F.col("p_brand"))).alias("path"), (F.col("p_size") + F.when(k % 4 == 0, 1).otherwise(0)).alias("version"), (k % 50 + F.when(k % 6 == 0, 1).otherwise(0)).alias("mtime"))
    return X.mirror_actions(source, mirror, p.where("p_partkey % 2 = 0").select(k.alias("id"))).select("id", F.array_join("actions", ",").alias("actions"))


@query("a17_alias_promotion", f"SELECT drive, id, arg_min(item, (NOT live, item)) AS item, count(*) AS aliases FROM ({_ORIGINS}) WHERE alias GROUP BY drive, id")
def a17(spark, sf):
    li = table(spark, sf, "lineitem").where("l_linenumber <= 5 and l_linenumber > 3")
    rows = li.select(F.concat(F.lit("d"), (F.col("l_partkey") % 3).cast("string")).alias("drive"), F.col("l_partkey").alias("id"), F.concat(F.lit("i"), F.col("l_orderkey").cast("string")).alias("item"), (F.col("l_returnflag") == "R").alias("dead"))
    return rows.groupBy("drive", "id").agg(F.min_by("item", F.struct("dead", "item")).alias("item"), F.count("*").alias("aliases"))


_CUR = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM ({V_SQL})) WHERE rn = 1 AND NOT deleted"


@query("a05_disk_usage", f"SELECT key % 4 AS fs, CAST(sum(size) AS BIGINT) AS used, count(*) AS objects FROM ({_CUR}) GROUP BY 1")
def a05(spark, sf):
    cur = newest(versions(spark, sf), ["key"], [F.col("seq")], ["key", "size", "deleted"]).where("not deleted")
    return cur.groupBy((F.col("key") % 4).alias("fs")).agg(F.sum("size").alias("used"), F.count("*").alias("objects"))


@query("a05_disk_usage_as_of", f"""SELECT key % 4 AS fs, CAST(sum(size) AS BIGINT) AS used FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY eff DESC, seq DESC) AS rn
FROM (SELECT *, date_trunc('second', last_modified) AS eff FROM ({V_SQL})) WHERE eff <= TIMESTAMP '2024-01-15 00:00:00') WHERE rn = 1 AND NOT deleted GROUP BY 1""")
def a05_asof(spark, sf):
    return as_of(effective(versions(spark, sf)), "2024-01-15 00:00:00").groupBy((F.col("key") % 4).alias("fs")).agg(F.sum("size").alias("used"))


_FS = "SELECT r_regionkey AS pos, CASE WHEN r_regionkey = 2 THEN '' ELSE r_name END AS name, r_regionkey % 4 AS fs FROM region"


def filesystems(spark, sf):
    r = table(spark, sf, "region")
    return r.select(F.col("r_regionkey").alias("pos"), F.when(F.col("r_regionkey") == 2, "").otherwise(F.col("r_name")).alias("name"), (F.col("r_regionkey") % 4).cast("long").alias("fs"))


@query("a06_statfs", f"SELECT f.pos, f.name, 1000000 AS total, coalesce(u.used, 0) AS used FROM ({_FS}) f LEFT JOIN ({ORACLE['a05_disk_usage']}) u ON u.fs = f.fs WHERE f.name <> ''")
def a06(spark, sf):
    return filesystems(spark, sf).where("name <> ''").join(a05(spark, sf), "fs", "left").select("pos", "name", F.lit(1000000).alias("total"), F.coalesce("used", F.lit(0)).alias("used"))


@query("x01_list_filesystems", f"SELECT pos, lpad(lower(to_hex(pos)), 4, '0') AS id, name FROM ({_FS}) WHERE name <> ''")
def x01(spark, sf):
    from tidemark.functions.names import filesystem_id

    return filesystems(spark, sf).where("name <> ''").select("pos", filesystem_id(F.col("pos")).alias("id"), "name")


@query("x02_create_slot", f"SELECT coalesce(min(CASE WHEN name = '' THEN pos END), max(pos) + 1) AS slot FROM ({_FS})")
def x02(spark, sf):
    return X.first_blank_slot(filesystems(spark, sf))


@query("x10_history_api", f"SELECT key, count(*) AS versions, min(eff) AS first, max(eff) AS latest, count(*) FILTER (eff > TIMESTAMP '2024-01-20 00:00:00') AS past_changes FROM ({EFF_SQL}) WHERE NOT deleted GROUP BY key")
def x10(spark, sf):
    late = F.sum((F.col("eff") > F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")).cast("long"))
    return effective(versions(spark, sf), dates(spark, sf)).where("not deleted").groupBy("key").agg(F.count("*").alias("versions"), F.min("eff").alias("first"), F.max("eff").alias("latest"), late.alias("past_changes"))


_SINCE = "2024-01-20 00:00:00"


@query("x10_history_calls", f"""SELECT 'listed' AS call, key, max_by(seq, (eff, seq)) AS seq FROM ({EFF_SQL}) e WHERE eff <= TIMESTAMP '{_SINCE}' AND starts_with(CAST(key AS VARCHAR), '1') GROUP BY key HAVING NOT max_by(deleted, (eff, seq))
UNION ALL SELECT 'search', key, max_by(seq, (eff, seq)) FROM ({EFF_SQL}) WHERE eff <= TIMESTAMP '{_SINCE}' AND contains(CAST(key AS VARCHAR), '7') GROUP BY key HAVING NOT max_by(deleted, (eff, seq))
UNION ALL SELECT 'past-changes', key, seq FROM ({EFF_SQL}) WHERE last_modified > TIMESTAMP '{_SINCE}' AND eff < TIMESTAMP '{_SINCE}' UNION ALL SELECT 'versions', key, seq FROM ({EFF_SQL}) WHERE key = 5 AND NOT deleted""")
def x10_calls(spark, sf):
    """The history as an object, several of its calls in one table."""
    from tidemark.history import History

    h = History(versions(spark, sf), dates(spark, sf))
    call = lambda df, name: df.select(F.lit(name).alias("call"), "key", "seq")
    return call(h.listed(_SINCE, "1"), "listed").unionAll(call(h.search("7", _SINCE), "search")).unionAll(call(h.past_changes(_SINCE), "past-changes")).unionAll(call(h.versions(5), "versions"))


# Integrity.


def lines(spark, sf):
    """Order lines as entries with faults of their own: names twice in a directory, items with two types."""
    li = table(spark, sf, "lineitem")
    return li.select(F.col("l_orderkey").alias("dir"), F.col("l_linenumber").cast("string").alias("name"), F.col("l_partkey").alias("item"), F.when(F.col("l_returnflag") == "R", "dir").otherwise("file").alias("type"))


_LINES = "SELECT l_orderkey AS dir, CAST(l_linenumber AS VARCHAR) AS name, l_partkey AS item, CASE WHEN l_returnflag = 'R' THEN 'dir' ELSE 'file' END AS type FROM lineitem"
_DUP = f"SELECT dir, name, count(*) AS n FROM ({_LINES}) GROUP BY dir, name HAVING count(*) > 1"
_MIS = f"SELECT item, count(DISTINCT type) AS types FROM ({_LINES}) GROUP BY item HAVING count(DISTINCT type) > 1"
_DIRS = f"SELECT item, count(*) AS names FROM ({_LINES}) WHERE type = 'dir' GROUP BY item HAVING count(*) > 1"


@query("a10_duplicate_names", _DUP)
def a10(spark, sf):
    return lines(spark, sf).groupBy("dir", "name").agg(F.count("*").alias("n")).where("n > 1")


@query("a10_type_mismatch", _MIS)
def a10_types(spark, sf):
    return lines(spark, sf).groupBy("item").agg(F.count_distinct("type").alias("types")).where("types > 1")


@query("a10_directory_linked", _DIRS)
def a10_dirs(spark, sf):
    return lines(spark, sf).where("type = 'dir'").groupBy("item").agg(F.count("*").alias("names")).where("names > 1")


@query("a08_link_counts", f"SELECT l.item, l.names, p.p_size AS recorded, CASE WHEN p.p_size % 10 = 0 THEN 'deleted-but-listed' ELSE 'link-count' END AS problem FROM (SELECT item, count(*) AS names FROM ({_LINES}) GROUP BY item) l JOIN part p ON p.p_partkey = l.item WHERE l.names <> p.p_size")
def a08(spark, sf):
    names = lines(spark, sf).groupBy("item").agg(F.count("*").alias("names"))
    meta = table(spark, sf, "part").select(F.col("p_partkey").alias("item"), F.col("p_size").alias("recorded"))
    return names.join(meta, "item").where("names <> recorded").withColumn("problem", F.when(F.col("recorded") % 10 == 0, "deleted-but-listed").otherwise("link-count"))


_UNREACHED = f"{WALK_SQL} SELECT 'o' || o_orderkey || '.metadata' AS key FROM orders WHERE 'o' || o_orderkey NOT IN (SELECT id FROM w) OR o_orderkey % 37 = 0"


@query("j18_unreachable", f"{WALK_SQL}, k AS (SELECT 'o' || l_orderkey || CASE WHEN l_linenumber % 2 = 0 THEN '.metadata' ELSE '' END AS key FROM lineitem) SELECT DISTINCT key FROM k WHERE replace(key, '.metadata', '') || 'x' NOT IN (SELECT id || 'x' FROM w WHERE CAST(substr(id, 2) AS BIGINT) % 3 <> 0)")
def j18(spark, sf):
    from tidemark.functions.names import base_key

    key = F.concat(F.lit("o"), F.col("l_orderkey").cast("string"), F.when(F.col("l_linenumber") % 2 == 0, ".metadata").otherwise(""))
    keys = table(spark, sf, "lineitem").select(key.alias("key")).distinct().withColumn("id", base_key(F.col("key")))
    reached = walked(spark, sf).where(F.substring("id", 2, 20).cast("long") % 3 != 0).select("id")
    return keys.join(reached, "id", "left_anti").select("key")


@query("x03_fsck", f"""SELECT 'duplicate-name' AS kind, dir || '/' || name AS subject FROM ({_DUP}) UNION ALL SELECT 'type-mismatch', CAST(item AS VARCHAR) FROM ({_MIS}) UNION ALL SELECT 'directory-linked', CAST(item AS VARCHAR) FROM ({_DIRS})
UNION ALL SELECT problem, CAST(item AS VARCHAR) FROM ({ORACLE['a08_link_counts']})
UNION ALL SELECT 'missing-object', CAST(item AS VARCHAR) FROM (SELECT DISTINCT item FROM ({_LINES}) WHERE item NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 50 <> 0))""")
def x03(spark, sf):
    s = lambda df, kind, subject: df.select(kind.alias("kind"), subject.cast("string").alias("subject"))
    li, item = lines(spark, sf), F.col("item")
    there = table(spark, sf, "part").where("p_partkey % 50 <> 0").select(F.col("p_partkey").alias("item"))
    return (
        s(a10(spark, sf), F.lit("duplicate-name"), F.concat_ws("/", F.col("dir").cast("string"), "name"))
        .unionAll(s(a10_types(spark, sf), F.lit("type-mismatch"), item))
        .unionAll(s(a10_dirs(spark, sf), F.lit("directory-linked"), item))
        .unionAll(s(a08(spark, sf), F.col("problem"), item))
        .unionAll(s(li.select("item").join(there, "item", "left_anti").distinct(), F.lit("missing-object"), item))
    )


_BLOCKS = "SELECT p_partkey AS block, CASE WHEN p_partkey % 4 = 0 THEN '3' END AS low, CASE WHEN p_partkey % 5 = 0 THEN '6' END AS high, p_partkey % 97 <> 0 AS readable FROM part WHERE p_partkey % 50 <> 0"
_BLOCK_LINKS = "SELECT o_custkey AS parent, o_orderkey AS block FROM orders WHERE o_orderkey % 6 = 0 UNION ALL SELECT o_custkey + 1, o_orderkey FROM orders WHERE o_orderkey % 60 = 0"
_BLOCK_ENTRIES = "SELECT l_partkey AS block, l_linenumber AS pos, CAST(l_suppkey % 10 AS VARCHAR) AS name FROM lineitem"
_REFS = "SELECT doc_id AS holder, doc_id * 2 AS target, doc_id % 11 = 0 AS pending FROM documents"
_RECORDS = "SELECT doc_id AS key, doc_id % 13 = 5 AS stub, doc_id % 17 <> 0 AS live FROM documents"


@query("x03_block_problems", f"""WITH b AS ({_BLOCKS}), l AS ({_BLOCK_LINKS}), e AS ({_BLOCK_ENTRIES})
SELECT DISTINCT 'missing-block' AS kind, CAST(block AS VARCHAR) AS subject FROM l WHERE block NOT IN (SELECT block FROM b) UNION ALL SELECT 'unreadable-block', CAST(block AS VARCHAR) FROM b WHERE NOT readable AND block IN (SELECT block FROM l)
UNION ALL SELECT 'block-reached-twice', CAST(block AS VARCHAR) FROM l GROUP BY block HAVING count(*) > 1 UNION ALL SELECT DISTINCT 'out-of-order', CAST(block AS VARCHAR) FROM (SELECT *, lag(name) OVER (PARTITION BY block ORDER BY pos, name) AS was FROM e) WHERE was >= name
UNION ALL SELECT DISTINCT 'outside-range', CAST(e.block AS VARCHAR) FROM e JOIN b ON e.block = b.block WHERE e.name < b.low OR e.name >= b.high""")
def x03_blocks(spark, sf):
    k = F.col("p_partkey")
    blocks = table(spark, sf, "part").where("p_partkey % 50 <> 0").select(k.alias("block"), F.when(k % 4 == 0, "3").alias("low"), F.when(k % 5 == 0, "6").alias("high"), (k % 97 != 0).alias("readable"))
    o = table(spark, sf, "orders")
    links = o.where("o_orderkey % 6 = 0").select(F.col("o_custkey").alias("parent"), F.col("o_orderkey").alias("block")).unionAll(o.where("o_orderkey % 60 = 0").select(F.col("o_custkey") + 1, "o_orderkey"))
    entries_ = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("block"), F.col("l_linenumber").alias("pos"), (F.col("l_suppkey") % 10).cast("string").alias("name"))
    return I.block_problems(blocks, links, entries_)


@query("x03_reference_problems", f"""WITH f AS ({_REFS}), r AS ({_RECORDS}), j AS (SELECT f.*, t.key AS t_key, t.stub AS t_stub, t.live AS t_live, h.live AS h_live, holder || '>' || target AS subject FROM f LEFT JOIN r t ON t.key = f.target LEFT JOIN r h ON h.key = f.holder)
SELECT 'ref-target-missing' AS kind, subject FROM j WHERE t_key IS NULL UNION ALL SELECT 'ref-to-ref', subject FROM j WHERE t_stub UNION ALL SELECT 'ref-entry-dead', subject FROM j WHERE NOT t_live
UNION ALL SELECT 'ref-entry-pending', subject FROM j WHERE pending UNION ALL SELECT 'ref-holder-dead', subject FROM j WHERE NOT h_live""")
def x03_references(spark, sf):
    d, k = table(spark, sf, "documents"), F.col("doc_id")
    return I.reference_problems(d.select(k.alias("holder"), (k * 2).alias("target"), (k % 11 == 0).alias("pending")), d.select(k.alias("key"), (k % 13 == 5).alias("stub"), (k % 17 != 0).alias("live")))


_REPAIR = "CASE kind WHEN 'link-count' THEN 'set-count' WHEN 'deleted-but-listed' THEN 'remove-entry' WHEN 'duplicate-name' THEN 'rename-entry' WHEN 'missing-object' THEN 'remove-entry' WHEN 'ref-target-missing' THEN 'drop-reference' WHEN 'ref-entry-dead' THEN 'drop-reference' WHEN 'ref-entry-pending' THEN 'finish-reference' WHEN 'out-of-order' THEN 'sort-block' ELSE 'report' END"


@query("x03_repairs", f"SELECT kind, {_REPAIR} AS action, count(*) AS problems FROM (SELECT * FROM ({ORACLE['x03_fsck']}) UNION ALL SELECT * FROM ({ORACLE['x03_block_problems']}) UNION ALL SELECT * FROM ({ORACLE['x03_reference_problems']})) GROUP BY kind")
def x03_repairs(spark, sf):
    every = x03(spark, sf).unionAll(x03_blocks(spark, sf)).unionAll(x03_references(spark, sf))
    return I.repairs(every).groupBy("kind", "action").agg(F.count("*").alias("problems"))


_MASTER = "SELECT n_name AS name, 1000 + n_nationkey * 10 AS size, n_nationkey * 60 AS used, n_nationkey % 3 = 0 AS archived FROM nation WHERE n_nationkey % 4 <> 1"
_MASTER_CHANGES = "SELECT n_name AS name, k AS kind, n_nationkey * 50 AS size FROM nation, (VALUES ('create'), ('resize'), ('archive'), ('prune')) v(k)"


@query("x02_master_changes", f"""SELECT c.name, c.kind, CASE WHEN c.kind = 'create' THEN CASE WHEN m.name IS NULL THEN 'created' ELSE 'exists' END WHEN m.name IS NULL THEN 'missing' WHEN c.kind = 'resize' THEN CASE WHEN c.size < m.used THEN 'refused' ELSE 'resized' END
WHEN c.kind = 'archive' THEN 'archived' WHEN m.archived THEN 'pruned' ELSE 'refused' END AS outcome FROM ({_MASTER_CHANGES}) c LEFT JOIN ({_MASTER}) m ON m.name = c.name""")
def x02_changes(spark, sf):
    from tidemark.operators.mutations import master_changes

    n, k = table(spark, sf, "nation"), F.col("n_nationkey")
    master = n.where("n_nationkey % 4 <> 1").select(F.col("n_name").alias("name"), (1000 + k * 10).alias("size"), (k * 60).alias("used"), (k % 3 == 0).alias("archived"))
    kinds = F.explode(F.array(*[F.lit(x) for x in ("create", "resize", "archive", "prune")])).alias("kind")
    return master_changes(master, n.select(F.col("n_name").alias("name"), (k * 50).alias("size"), kinds))


@query("a09_fsck_summary", f"SELECT kind, count(*) AS problems FROM ({ORACLE['x03_fsck']}) GROUP BY kind")
def a09(spark, sf):
    return x03(spark, sf).groupBy("kind").agg(F.count("*").alias("problems"))


# Locks and ranges.


@query("j16_lock_conflicts", f"""WITH k AS (SELECT * FROM ({W_SQL}) WHERE expires_at_ms > {NOW_MS} AND NOT escalation_only)
SELECT a.file, a.id AS a, b.id AS b FROM k a JOIN k b ON a.file = b.file AND a.id < b.id AND a.start < b."end" AND b.start < a."end" AND a.holder <> b.holder AND NOT (a.shared AND b.shared)""")
def j16(spark, sf):
    return G.conflicts(claims(spark, sf), NOW_MS)


@query("j17_write_conflicts", f"""SELECT file, id FROM ({W_SQL}) w WHERE EXISTS (SELECT 1 FROM ({W_SQL}) c
WHERE c.file = w.file AND c.holder <> w.holder AND NOT c.escalation_only AND c.expires_at_ms > {NOW_MS} AND c.start < w."end" AND w.start < c."end")""")
def j17(spark, sf):
    """Every claim as a write; a holder's own claims don't stop it."""
    k = claims(spark, sf)
    return G.blocked_writes(k.select("file", "id", "holder", "start", "end"), k, NOW_MS)


@query("p11_lock_expiry", f"SELECT id FROM ({K_SQL}) WHERE {NOW_MS} >= expires_at_ms")
def p11(spark, sf):
    return locks(spark, sf).where(F.lit(NOW_MS) >= F.col("expires_at_ms")).select("id")


def pieces(spark, sf):
    k = locks(spark, sf)
    return k.select((F.col("id") % 20).alias("file"), F.col("id"), F.col("start"), F.col("end"))


_PIECES = f'SELECT id % 20 AS file, id, start, "end" FROM ({K_SQL})'


def _union_sql(op: str = ">") -> str:
    return f"""SELECT file, min(start) AS start, max("end") AS "end" FROM (SELECT *, sum(new) OVER (PARTITION BY file ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM (
SELECT *, CASE WHEN start {op} max("end") OVER (PARTITION BY file ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) IS NOT FALSE THEN 1 ELSE 0 END AS new FROM ({_PIECES}))) GROUP BY file, island"""


@query("u03_range_union", _union_sql())
def u03(spark, sf):
    return G.union(pieces(spark, sf))


@query("u03_range_union_overlapping", _union_sql(">="))
def u03_overlapping(spark, sf):
    return G.union(pieces(spark, sf), touching=False)


@query("u04_range_budget", f"""WITH u AS ({_union_sql()}), g AS (SELECT *, start - lag("end") OVER (PARTITION BY file ORDER BY start) AS gap, count(*) OVER (PARTITION BY file) AS n FROM u),
r AS (SELECT *, CASE WHEN gap IS NOT NULL THEN row_number() OVER (PARTITION BY file ORDER BY gap NULLS LAST, start) END AS r FROM g),
i AS (SELECT *, sum(CASE WHEN r <= n - 16 THEN 0 ELSE 1 END) OVER (PARTITION BY file ORDER BY start ROWS UNBOUNDED PRECEDING) AS i FROM r)
SELECT file, min(start) AS start, max("end") AS "end" FROM i GROUP BY file, i""")
def u04(spark, sf):
    return G.budgeted(pieces(spark, sf), 16)


@query("u05_range_span", f'SELECT file, min(start) AS lo, max("end") AS hi FROM ({_PIECES}) GROUP BY file')
def u05(spark, sf):
    return G.span(pieces(spark, sf))


def merged_sql(files: int, width: int, length: int, where: str = "true", top: int = 3000) -> str:
    """What each holder has after all its claims in order, from single bytes: a byte is of the kind of its last claim.

    Two neighbouring bytes are of one claim if one covers both and no later one of the other kind begins or ends between
    them. A whole-file claim goes to ``top``, past all others.
    """
    return f"""WITH k AS (SELECT id % {files} AS file, holder, id, start % {width} AS s, CASE WHEN "end" = 9223372036854775807 THEN {top} ELSE start % {width} + {length} END AS e, shared FROM ({W_SQL}) WHERE {where}),
b AS (SELECT file, holder, id, shared, s, unnest(range(s, e)) AS x FROM k), t AS (SELECT file, holder, x, arg_max(shared, id) AS shared FROM b GROUP BY ALL),
j AS (SELECT file, holder, x, max(id) AS id, arg_max(shared, id) AS shared FROM b WHERE x > s GROUP BY ALL),
o AS (SELECT file, holder, x FROM j WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.file = j.file AND k.holder = j.holder AND k.id > j.id AND k.shared <> j.shared AND (k.s = j.x OR k.e = j.x))),
r AS (SELECT t.*, sum(CASE WHEN o.x IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY t.file, t.holder ORDER BY t.x) AS run FROM t LEFT JOIN o ON o.file = t.file AND o.holder = t.holder AND o.x = t.x)
SELECT file, holder, min(x) AS start, CASE WHEN max(x) + 1 = {top} THEN -9223372036854775808 ELSE max(x) + 1 END AS "end", any_value(shared) AS shared FROM r GROUP BY file, holder, run"""


@query("u06_fcntl_merge", merged_sql(20, 900, 60))
def u06(spark, sf):
    k = claims(spark, sf).withColumn("file", F.col("id") % 20).withColumn("start", F.col("start") % 900)
    return G.merged_claims(k.withColumn("end", F.when(F.col("end") < 0, F.col("end")).otherwise(F.col("start") + 60)))


@query("u07_range_unlock", f"""WITH k AS (SELECT *, holder % 2 = 0 AND NOT escalation_only AND start < 25000 AND 8000 < "end" AS hit FROM ({W_SQL}) WHERE expires_at_ms > {NOW_MS}),
p AS (SELECT file, id, holder, start, "end" FROM k WHERE NOT hit UNION ALL SELECT file, id, holder, start, 8000 FROM k WHERE hit AND start < 8000 UNION ALL SELECT file, id, holder, 25000, "end" FROM k WHERE hit AND "end" > 25000)
SELECT file, id, holder, start, CASE WHEN "end" = 9223372036854775807 THEN -9223372036854775808 ELSE "end" END AS "end" FROM p""")
def u07(spark, sf):
    k = claims(spark, sf)
    release = k.where("holder % 2 = 0").select("file", "holder").distinct().withColumn("r_start", F.lit(8000)).withColumn("r_end", F.lit(25000).cast("long"))
    return G.unlocked(k, release, NOW_MS)


@query("u08_alias_list", "SELECT o_custkey, string_agg(o_orderkey, ',' ORDER BY o_orderkey) AS aliases FROM orders WHERE o_orderkey % 5 <> 0 GROUP BY o_custkey")
def u08(spark, sf):
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderkey")).alias("a"))
    kept = F.filter("a", lambda x: x % 5 != 0)
    return o.where(F.size(kept) > 0).select("o_custkey", F.array_join(kept, ",").alias("aliases"))


@query("o07_names_order", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS pos FROM orders")
def o07(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf, "orders").select("o_orderkey", F.row_number().over(w).cast("long").alias("pos"))
