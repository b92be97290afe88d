"""Queries on the tree of entries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import tree as T
from tidemark.sources.adapters import E_SQL, I_SQL, T_SQL, entries, items, table, trash

from .catalog import Catalog

catalog = Catalog()
QUERIES, ORACLE, query = catalog.queries, catalog.oracle, catalog.query

WALK_SQL = f"""WITH RECURSIVE e AS ({E_SQL}), w(parent, id, name, type, path, depth) AS (
SELECT parent, id, name, type, '/' || name, 1 FROM e WHERE parent = ''
UNION ALL SELECT e.parent, e.id, e.name, e.type, w.path || '/' || e.name, w.depth + 1 FROM e JOIN w ON e.parent = w.id AND w.type = 'dir')"""


def walked(spark, sf, depth=0):
    return T.walk(entries(spark, sf), depth=depth)


@query("t01_walk_tree", f"{WALK_SQL} SELECT id, type, path, depth FROM w")
def t01(spark, sf):
    return walked(spark, sf).select("id", "type", "path", "depth")


@query("t02_list_page", f"""{WALK_SQL}, l AS (SELECT id, path, lower(path) AS k FROM w), c AS (SELECT k, path FROM l WHERE id = 'c5')
SELECT id, path, row_number() OVER (ORDER BY k, path) AS pos FROM (SELECT l.* FROM l, c WHERE (l.k, l.path) > (c.k, c.path) ORDER BY l.k, l.path LIMIT 40)""")
def t02(spark, sf):
    rows = walked(spark, sf).select("id", "path")
    return T.page(rows, rows.where("id = 'c5'").first()["path"], 40)


@query("t03_read_directory", f"SELECT id, name, type, row_number() OVER (ORDER BY upper(name), name) AS pos FROM ({E_SQL}) WHERE parent = 'n3'")
def t03(spark, sf):
    return T.numbered(entries(spark, sf).where("parent = 'n3'").select("id", "name", "type"), F.upper("name"), F.col("name"))


@query("t04_resolve_path", f"{WALK_SQL} SELECT id, path FROM w WHERE path = (SELECT '/' || r_name || '/' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey = 4)")
def t04(spark, sf):
    n, r = table(spark, sf, "nation").where("n_nationkey = 4"), table(spark, sf, "region")
    wanted = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.concat(F.lit("/"), "r_name", F.lit("/"), "n_name").alias("path"))
    return walked(spark, sf, 2).join(wanted, "path", "left_semi").select("id", "path")


@query("t05_resolve_by_id", f"SELECT parent, id, name FROM ({E_SQL}) WHERE id = 'c12'")
def t05(spark, sf):
    return entries(spark, sf).where("id = 'c12'").select("parent", "id", "name")


@query("t06_exact_lookup", f"SELECT id, type FROM ({E_SQL}) WHERE parent = 'c7' AND name = (SELECT min(name) FROM ({E_SQL}) WHERE parent = 'c7')")
def t06(spark, sf):
    d = entries(spark, sf).where("parent = 'c7'")
    return d.join(d.agg(F.min("name").alias("name")), "name", "left_semi").select("id", "type")


@query("t07_search_by_id", f"{WALK_SQL} SELECT id, path, depth FROM w WHERE id = 'o77'")
def t07(spark, sf):
    return walked(spark, sf).where("id = 'o77'").select("id", "path", "depth")


@query("t07_budgeted_search", f"""{WALK_SQL}, q AS (SELECT DISTINCT CASE WHEN l_partkey % 2 = 0 THEN 'o' || l_orderkey ELSE 'n' || (l_partkey % 40) END AS id FROM lineitem)
SELECT q.id, p.path, CASE WHEN p.path IS NULL THEN 'not-searched' ELSE 'found' END AS state FROM q LEFT JOIN (SELECT id, min(path) AS path FROM w WHERE depth <= 3 GROUP BY id) p ON p.id = q.id""")
def t07_budgeted(spark, sf):
    """A search that stops after three levels: what lies deeper isn't searched, rather than not there."""
    k = F.col("l_partkey")
    wanted = table(spark, sf, "lineitem").select(F.when(k % 2 == 0, F.concat(F.lit("o"), F.col("l_orderkey").cast("string"))).otherwise(F.concat(F.lit("n"), (k % 40).cast("string"))).alias("id")).distinct()
    return T.found_by_id(entries(spark, sf), wanted, 3)


def linked(spark, sf):
    """Parts as files with a name in each order that lists them: hard links."""
    li = table(spark, sf, "lineitem")
    s = lambda c: F.col(c).cast("string")
    return li.select(F.concat(F.lit("p"), s("l_partkey")).alias("id"), F.concat(F.lit("/o"), s("l_orderkey"), F.lit("/"), s("l_linenumber"), F.lit("-"), s("l_partkey")).alias("path"))


_LINK_SQL = "SELECT 'p' || l_partkey AS id, '/o' || l_orderkey || '/' || l_linenumber || '-' || l_partkey AS path FROM lineitem"


@query("t08_item_paths", f"SELECT id, string_agg(path, ' ' ORDER BY path) AS paths, count(*) AS names FROM ({_LINK_SQL}) GROUP BY id")
def t08(spark, sf):
    return T.paths_of_items(linked(spark, sf)).select("id", F.array_join("paths", " ").alias("paths"), "names")


@query("t09_name_search", f"""{WALK_SQL}, t AS ({T_SQL}), f AS (
SELECT item AS id, name, path, 0 AS live, -epoch_us(deleted_at) AS k, deleted_at - INTERVAL 1 SECOND AS see FROM t WHERE NOT live AND contains(lower(name), '99')
UNION ALL SELECT id, name, path, 1, depth, NULL FROM w WHERE contains(lower(name), '99'))
SELECT id, name, path, live, see, row_number() OVER (ORDER BY live, k, path, id) AS pos FROM (SELECT * FROM f ORDER BY live, k, path, id LIMIT 200)""")
def t09(spark, sf):
    return T.search(walked(spark, sf), trash(spark, sf).where("not live"), "99", 200)


@query("t10_scope_walk", f"SELECT id, min(path) AS path FROM ({_LINK_SQL}) WHERE path = '/o20' OR starts_with(path, '/o20/') OR starts_with(path, '/o40/') GROUP BY id")
def t10(spark, sf):
    p = F.col("path")
    return linked(spark, sf).where(T.under(p, "/o20") | T.under(p, "/o40/")).groupBy("id").agg(F.min("path").alias("path"))


@query("t11_descendant_test", f"""{WALK_SQL}, a AS (SELECT id AS ancestor, path FROM w WHERE type = 'dir')
SELECT a.ancestor, count(*) AS below FROM a JOIN w ON starts_with(w.path, a.path || '/') GROUP BY a.ancestor""")
def t11(spark, sf):
    return T.ancestors(walked(spark, sf)).groupBy("ancestor").agg(F.count("*").alias("below"))


@query("t12_walk_below", f"{WALK_SQL} SELECT id, depth - 2 AS depth FROM w WHERE starts_with(path, (SELECT path FROM w WHERE id = 'n2') || '/')")
def t12(spark, sf):
    return T.walk(entries(spark, sf), root="n2").select("id", "depth")


@query("t13_block_order", """WITH b AS (SELECT l_orderkey AS block, l_linenumber AS pos, CAST(l_partkey AS VARCHAR) AS name FROM lineitem),
o AS (SELECT *, lag(name) OVER (PARTITION BY block ORDER BY pos, name) AS was FROM b)
SELECT block, count(*) AS out_of_order FROM o WHERE was >= name GROUP BY block""")
def t13(spark, sf):
    b = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("block"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").cast("string").alias("name"))
    was = F.lag("name").over(Window.partitionBy("block").orderBy("pos", "name"))
    return b.withColumn("was", was).where("was >= name").groupBy("block").agg(F.count("*").alias("out_of_order"))


@query("t14_purge_collect", f"{WALK_SQL} SELECT id, type, depth, type = 'file' AND CAST(substr(id, 2) AS BIGINT) % 9 = 0 AS linked FROM w WHERE starts_with(path, (SELECT path FROM w WHERE id = 'n1') || '/')")
def t14(spark, sf):
    below = T.walk(entries(spark, sf), root="n1").withColumn("depth", F.col("depth") + 2)
    nlink = F.when((F.col("type") == "file") & (F.substring("id", 2, 20).cast("long") % 9 == 0), 2).otherwise(1)
    return below.select("id", "type", "depth", ((nlink > 1) & (F.col("type") != "symlink")).alias("linked"))


@query("t15_block_closure", """WITH RECURSIVE e AS (SELECT DISTINCT user_id AS a, event_id AS b FROM events WHERE event_id > user_id),
c(a, b) AS (SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a) SELECT a AS root, b AS block FROM c""")
def t15(spark, sf):
    """Every block that any version of any directory led to; a link leads to a later block."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("a"), F.col("event_id").alias("b")).where("b > a").distinct()
    return closure(e)


def closure(links):
    """(root, block): all that links (a, b) lead to from each root, until a round adds none."""
    from tidemark.operators.shared import saved

    e = saved(links, "links")
    reached = e
    new = reached
    while not new.isEmpty():
        step = new.join(e.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b")).distinct()
        new = saved(step.join(reached, ["a", "b"], "left_anti"), "closure")
        reached = reached.unionAll(new)
    return reached.select(F.col("a").alias("root"), F.col("b").alias("block"))


@query("t16_folded_lookup", f"SELECT parent, first(id ORDER BY name) AS id, count(*) AS spellings FROM ({E_SQL}) WHERE upper(name) = 'ORDER-12' GROUP BY parent")
def t16(spark, sf):
    from tidemark.functions.names import fold_key

    hit = entries(spark, sf).where(fold_key(F.col("name")) == fold_key(F.lit("Order-12")))
    return hit.groupBy("parent").agg(F.min_by("id", F.struct(F.col("name") != "Order-12", F.col("name"))).alias("id"), F.count("*").alias("spellings"))


@query("p01_item_projection", f"{WALK_SQL} SELECT w.id, w.name, w.path, w.type, i.size, i.modified FROM w LEFT JOIN ({I_SQL}) i ON w.id = i.id")
def p01(spark, sf):
    return walked(spark, sf).join(items(spark, sf), "id", "left").select("id", "name", "path", "type", "size", "modified")


@query("p02_visible_types", f"SELECT type, count(*) AS n FROM ({E_SQL}) WHERE type IN ('file', 'dir', 'symlink') GROUP BY type")
def p02(spark, sf):
    return entries(spark, sf).where(F.col("type").isin(*T.VISIBLE)).groupBy("type").agg(F.count("*").alias("n"))


@query("p03_path_filter", "SELECT page_id, url FROM pages WHERE url = 'https://m' OR starts_with(url, 'https:/' || '/')")
def p03(spark, sf):
    return table(spark, sf, "pages").where(T.under(F.col("url"), "https:/")).select("page_id", "url")


@query("o01_item_sort", f"SELECT id, size, row_number() OVER (ORDER BY size DESC, lower(id), id) AS by_size, row_number() OVER (ORDER BY modified DESC, lower(id), id) AS by_modified FROM ({I_SQL})")
def o01(spark, sf):
    from tidemark.operators.dedupe import ranked

    rows = items(spark, sf)
    rows = ranked(rows, [F.desc("size"), F.lower("id").asc(), F.asc("id")], "by_size")
    return ranked(rows, [F.desc("modified"), F.lower("id").asc(), F.asc("id")], "by_modified").select("id", "size", "by_size", "by_modified")


@query("o02_exact_order", f"SELECT parent, string_agg(name, ',' ORDER BY name) AS names FROM ({E_SQL}) WHERE type = 'dir' GROUP BY parent")
def o02(spark, sf):
    return entries(spark, sf).where("type = 'dir'").groupBy("parent").agg(F.array_join(F.sort_array(F.collect_list("name")), ",").alias("names"))


@query("u02_state_difference", f"""WITH a AS (SELECT parent, id FROM ({E_SQL}) WHERE substr(id, 2) <> '3'), b AS (SELECT parent, id FROM ({E_SQL}) WHERE substr(id, 2) <> '5')
SELECT 'without' AS side, * FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT 'with', * FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def u02(spark, sf):
    e = entries(spark, sf).select("parent", "id")
    a, b = e.where("substr(id, 2) <> '3'"), e.where("substr(id, 2) <> '5'")
    return a.exceptAll(b).select(F.lit("without").alias("side"), "*").unionAll(b.exceptAll(a).select(F.lit("with").alias("side"), "*"))


@query("x06_walk_callback", f"SELECT parent AS folder, count(*) AS items, min(name) AS first, string_agg(id, ',' ORDER BY name) AS ids FROM ({E_SQL}) GROUP BY parent")
def x06(spark, sf):
    """A caller's function on every folder and its items."""
    import pandas as pd

    def told(folder, items):
        return pd.DataFrame({"folder": [folder], "items": [len(items)], "first": [items["name"].iloc[0]], "ids": [",".join(items["id"])]})

    return T.each_folder(entries(spark, sf), told, "folder string, items long, first string, ids string")
