"""Queries on duplicate content and references."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import dedupe as D
from tidemark.sources.adapters import C_SQL, contents, table

from .catalog import Catalog

catalog = Catalog()
QUERIES, ORACLE, query = catalog.queries, catalog.oracle, catalog.query

_ORDER = "referrers DESC, date, path, item, idx DESC, version"
_GROUPS = f"""SELECT sha256, size, first(idx ORDER BY {_ORDER}) AS canonical, count(*) AS copies, CAST((count(*) - 1) * size AS BIGINT) AS reclaimable FROM ({C_SQL}) WHERE NOT stub GROUP BY sha256, size HAVING count(*) > 1"""


@query("a01_duplicate_groups", _GROUPS)
def a01(spark, sf):
    return D.groups(contents(spark, sf))


@query("a01_duplicates", f"SELECT c.idx, g.canonical FROM ({C_SQL}) c JOIN ({_GROUPS}) g ON c.sha256 = g.sha256 AND c.size = g.size WHERE NOT c.stub AND c.idx <> g.canonical")
def a01_dup(spark, sf):
    return D.duplicates(contents(spark, sf))


@query("a02_dedupe_report", f"""WITH m AS (SELECT 'history' AS mode, * FROM ({C_SQL}) UNION ALL SELECT 'current', * FROM ({C_SQL}) WHERE current),
g AS (SELECT mode, sha256, size, count(*) AS n FROM m WHERE NOT stub AND size >= 200 GROUP BY 1, 2, 3 HAVING count(*) > 1),
s AS (SELECT mode, count(*) AS groups, CAST(sum(n - 1) AS BIGINT) AS duplicates, CAST(sum((n - 1) * size) AS BIGINT) AS reclaimable FROM g GROUP BY mode)
SELECT m.mode, count(*) FILTER (NOT stub) AS versions, count(*) FILTER (stub) AS stubs, coalesce(any_value(s.groups), 0) AS groups, coalesce(any_value(s.duplicates), 0) AS duplicates,
coalesce(any_value(s.reclaimable), 0) AS reclaimable, count(*) FILTER (NOT stub AND size < 200) AS below_min FROM m LEFT JOIN s ON m.mode = s.mode GROUP BY m.mode""")
def a02(spark, sf):
    return D.report(contents(spark, sf), 200)


@query("a03_history_rank", f"""WITH i AS (SELECT item, arg_min(path, idx) AS path, CAST(sum(referrers) AS BIGINT) AS referrers, min(date) AS oldest FROM ({C_SQL}) GROUP BY item),
d AS (SELECT item, bool_or(n > 1) AS dirty FROM (SELECT item, sha256, size, count(*) AS n FROM ({C_SQL}) WHERE NOT stub GROUP BY 1, 2, 3) GROUP BY item)
SELECT i.*, coalesce(d.dirty, false) AS dirty, row_number() OVER (ORDER BY coalesce(d.dirty, false), referrers DESC, oldest, path, i.item) AS rank FROM i LEFT JOIN d ON i.item = d.item""")
def a03(spark, sf):
    return D.rank_items(contents(spark, sf))


_REFS = "SELECT doc_id AS idx, doc_id * 7 % 1200 AS target FROM documents WHERE doc_id % 13 = 5"


def refs(spark, sf):
    d = table(spark, sf, "documents").where("doc_id % 13 = 5")
    return d.select(F.col("doc_id").alias("idx"), (F.col("doc_id") * 7 % 1200).alias("target"))


@query("a04_referrer_counts", f"SELECT 'i' || (target % 400) AS target, 'v' || target AS target_version, count(*) AS n, CAST(count(*) FILTER (idx % 2 = 0) AS BIGINT) AS pending FROM ({_REFS}) GROUP BY target")
def a04(spark, sf):
    s = lambda c: c.cast("string")
    r = refs(spark, sf).select(F.concat(F.lit("i"), s(F.col("target") % 400)).alias("target"), F.concat(F.lit("v"), s(F.col("target"))).alias("target_version"), (F.col("idx") % 2 == 0).alias("pending"))
    return D.referrer_counts(r)


@query("j03_stub_follow", f"""SELECT c.idx, coalesce(t.size, c.size) AS size, CASE WHEN r.target IS NULL THEN 'ok' WHEN t.idx IS NULL THEN 'dangling' WHEN t.stub THEN 'chained' ELSE 'ok' END AS state
FROM ({C_SQL}) c LEFT JOIN ({_REFS}) r ON c.idx = r.idx LEFT JOIN ({C_SQL}) t ON t.idx = r.target""")
def j03(spark, sf):
    return D.followed(contents(spark, sf), refs(spark, sf))


@query("j19_dangling_refs", f"SELECT idx, state FROM ({ORACLE['j03_stub_follow']}) WHERE state <> 'ok'")
def j19(spark, sf):
    return j03(spark, sf).where("state <> 'ok'").select("idx", "state")


@query("j20_referrer_liveness", f"SELECT r.idx, r.target FROM ({_REFS}) r WHERE r.idx % 4 = 1 OR EXISTS (SELECT 1 FROM ({C_SQL}) c WHERE c.idx = r.target AND NOT c.stub)")
def j20(spark, sf):
    r, real = refs(spark, sf), contents(spark, sf).where("not stub").select(F.col("idx").alias("target"))
    return r.where("idx % 4 = 1").unionAll(r.where("idx % 4 <> 1").join(real, "target", "left_semi").select("idx", "target"))


@query("j04_decorated_versions", f"""SELECT e.event_id, s.sha, coalesce(r.size, CAST(floor(e.value) AS BIGINT)) AS size FROM events e
LEFT JOIN (SELECT 'e' || (doc_id % 50) AS etag, 'sha-' || max(doc_id) AS sha FROM documents WHERE doc_id % 50 < 30 GROUP BY 1) s ON s.etag = 'e' || (e.event_id % 50)
LEFT JOIN (SELECT 'e' || (doc_id % 50) AS etag, max(n_chars) AS size FROM documents WHERE doc_id % 13 = 5 AND doc_id % 50 < 20 GROUP BY 1) r ON r.etag = 'e' || (e.event_id % 50)""")
def j04(spark, sf):
    d = table(spark, sf, "documents")
    etag = F.concat(F.lit("e"), (F.col("doc_id") % 50).cast("string")).alias("etag")
    sums = d.where("doc_id % 50 < 30").groupBy(etag).agg(F.concat(F.lit("sha-"), F.max("doc_id").cast("string")).alias("sha"))
    stubs = d.where("doc_id % 13 = 5 and doc_id % 50 < 20").groupBy(etag).agg(F.max("n_chars").alias("r_size"))
    e = table(spark, sf, "events").select("event_id", F.floor("value").cast("long").alias("size"), F.concat(F.lit("e"), (F.col("event_id") % 50).cast("string")).alias("etag"))
    return e.join(sums, "etag", "left").join(stubs, "etag", "left").select("event_id", "sha", F.coalesce("r_size", "size").alias("size"))


@query("j21_in_scope_versions", f"SELECT idx, item FROM ({C_SQL}) WHERE item IN (SELECT item FROM ({C_SQL}) WHERE starts_with(path, '/src3/'))")
def j21(spark, sf):
    c = contents(spark, sf)
    return c.join(c.where(F.col("path").startswith("/src3/")).select("item"), "item", "left_semi").select("idx", "item")


@query("a11_content_map", f"SELECT sha256, min((item, version)).item AS item, min((item, version)).version AS version FROM (SELECT sha256, item, version FROM ({C_SQL})) GROUP BY sha256".replace("min((item, version)).item", "arg_min(item, (item, version))").replace("min((item, version)).version", "arg_min(version, (item, version))"))
def a11(spark, sf):
    return D.content_map(contents(spark, sf))


@query("j14_content_lookup", f"SELECT c.idx, m.item FROM ({C_SQL}) c JOIN ({ORACLE['a11_content_map']}) m ON c.sha256 = m.sha256 WHERE c.item <> m.item")
def j14(spark, sf):
    c = contents(spark, sf)
    m = D.content_map(c).select("sha256", F.col("item").alias("m_item"))
    return c.join(m, "sha256").where("item <> m_item").select("idx", F.col("m_item").alias("item"))


def _sum_sql(line: str) -> str:
    return f"SELECT source, count(*) AS n, CAST(sum(CAST('0x' || substr(md5({line}), 1, 15) AS BIGINT)) AS VARCHAR) AS total FROM documents GROUP BY source"


@query("a12_state_sum", _sum_sql("coalesce(lang, '') || ':' || doc_id"))
def a12(spark, sf):
    d = table(spark, sf, "documents")
    return D.state_sums(d, ["source"], F.concat_ws(":", F.coalesce("lang", F.lit("")), F.col("doc_id").cast("string")))


@query("a13_state_fingerprint", _sum_sql("doc_id || '=' || n_chars"))
def a13(spark, sf):
    """Blocks by key with their tags: keys are distinct, so the set of pairs stands for any order of them."""
    d = table(spark, sf, "documents")
    return D.state_sums(d, ["source"], F.concat_ws("=", F.col("doc_id").cast("string"), F.col("n_chars").cast("string")))


@query("m12_dedupe_replace", f"""SELECT d.idx, d.canonical, CASE WHEN c.size < 1 THEN 'small' WHEN c.referrers > 0 THEN 'referrers' WHEN c.item = k.item THEN 'same-item' ELSE 'stub' END AS outcome
FROM ({ORACLE['a01_duplicates']}) d JOIN ({C_SQL}) c ON c.idx = d.idx JOIN ({C_SQL}) k ON k.idx = d.canonical WHERE c.current""")
def m12(spark, sf):
    return D.replaced(contents(spark, sf))


@query("m12_repoint_finish", """SELECT doc_id AS holder, CASE WHEN doc_id * 2 % 5 = 0 THEN doc_id * 2 + 1 ELSE doc_id * 2 END AS target, CASE WHEN doc_id * 2 % 5 = 0 THEN 'repointed' WHEN doc_id % 3 = 0 THEN 'finished' ELSE 'kept' END AS outcome FROM documents""")
def m12_repoint(spark, sf):
    d, k = table(spark, sf, "documents"), F.col("doc_id")
    references = d.select(k.alias("holder"), (k * 2).alias("target"), (k % 3 == 0).alias("pending"))
    moved = references.where("target % 5 = 0").select("target", (F.col("target") + 1).alias("to")).distinct()
    return D.repointed(references, moved)


@query("f15_checksums", "SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256 FROM documents")
def f15(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5("text").alias("md5"), F.sha2("text", 256).alias("sha256"))


@query("f16_short_hash", "SELECT doc_id, CASE WHEN source = 'src0' THEN '' ELSE substr(sha256(source), 1, 16) END AS h FROM documents")
def f16(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.when(F.col("source") == "src0", "").otherwise(F.substring(F.sha2("source", 256), 1, 16)).alias("h"))


@query("j13_rename_by_hash", f"""WITH g AS (SELECT *, row_number() OVER (PARTITION BY size, sha256 ORDER BY idx) AS n FROM ({C_SQL}) WHERE idx % 2 = 0), b AS (SELECT *, row_number() OVER (PARTITION BY size, sha256 ORDER BY idx) AS n FROM ({C_SQL}) WHERE idx % 2 = 1)
SELECT b.idx AS new_key, g.idx AS old_key FROM b JOIN g ON b.size = g.size AND b.sha256 = g.sha256 AND b.n = g.n""")
def j13(spark, sf):
    c = contents(spark, sf).select(F.col("idx").alias("key"), "size", "sha256")
    return D.matched_renames(c.where("key % 2 = 0"), c.where("key % 2 = 1"))


@query("s20_json_dump", f"""SELECT idx, '{{"path":"' || path || '","itemId":"' || item || '","versionId":"' || version || '","size":' || size || '}}' AS line FROM ({C_SQL})""")
def s20(spark, sf):
    c = contents(spark, sf)
    return c.select("idx", F.to_json(F.struct("path", F.col("item").alias("itemId"), F.col("version").alias("versionId"), "size")).alias("line"))
