"""Model relations built from the provided tables; each is a projection, so filters and pruning reach the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NTZ = "timestamp_ntz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def store_second(ts):
    """Store time cut to the whole second."""
    return F.date_trunc("second", ts).cast(NTZ)


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key histories: (key, seq, last_modified, deleted, size, etag). A greater seq was stored later."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.col("ts").alias("last_modified"),
        (F.col("event_type") == "error").alias("deleted"), F.floor("value").cast("long").alias("size"), F.concat(F.lit("e"), (F.col("event_id") % 50).cast("string")).alias("etag"),
    )


def dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared times: (key, seq, at), for the versions whose counter is a multiple of ten; at lies that many hours before."""
    e = table(spark, sf_dir, "events").withColumn("k", F.regexp_extract("props", "([0-9]+)", 1).cast("int"))
    at = F.timestamp_seconds(F.unix_seconds(F.date_trunc("second", F.col("ts").cast("timestamp"))) - F.col("k") * 3600).cast(NTZ)
    return e.where("k % 10 = 0").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), at.alias("at"))


#: SQL of the two relations, with the effective date joined on.
V_SQL = """SELECT user_id AS key, event_id AS seq, ts AS last_modified, event_type = 'error' AS deleted, CAST(floor(value) AS BIGINT) AS size, 'e' || CAST(event_id % 50 AS VARCHAR) AS etag FROM events"""
D_SQL = """SELECT user_id AS key, event_id AS seq, date_trunc('second', ts) - to_hours(CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)) AS at FROM events WHERE CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 10 = 0"""
EFF_SQL = f"""SELECT v.*, coalesce(d.at, date_trunc('second', v.last_modified)) AS eff FROM ({V_SQL}) v LEFT JOIN ({D_SQL}) d ON v.key = d.key AND v.seq = d.seq"""


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree: (parent, id, name, type); the root is ''. Regions, nations and customers are directories, orders files."""
    t = lambda n: table(spark, sf_dir, n)
    tag = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    row = lambda df, parent, key, name, kind: df.select(parent.alias("parent"), key.alias("id"), name.alias("name"), F.lit(kind).alias("type"))
    return (
        row(t("region"), F.lit(""), tag("r", "r_regionkey"), F.col("r_name"), "dir")
        .unionAll(row(t("nation"), tag("r", "n_regionkey"), tag("n", "n_nationkey"), F.col("n_name"), "dir"))
        .unionAll(row(t("customer"), tag("n", "c_nationkey"), tag("c", "c_custkey"), F.col("c_name"), "dir"))
        .unionAll(row(t("orders"), tag("c", "o_custkey"), tag("o", "o_orderkey"), F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")), "file"))
    )


E_SQL = """SELECT '' AS parent, 'r' || r_regionkey AS id, r_name AS name, 'dir' AS type FROM region
UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey, n_name, 'dir' FROM nation
UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, c_name, 'dir' FROM customer
UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey, 'order-' || o_orderkey, 'file' FROM orders"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes of the tree's files: (id, size, modified, owner_rank, nlink)."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"), F.floor("o_totalprice").cast("long").alias("size"), F.col("o_orderdate").alias("modified"))


I_SQL = "SELECT 'o' || o_orderkey AS id, CAST(floor(o_totalprice) AS BIGINT) AS size, o_orderdate AS modified FROM orders"


def trash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deletion log from orders, entry ids e<orderkey>; batches of up to eight, named by their root's entry; the multiples of seven are live again."""
    o = table(spark, sf_dir, "orders")
    s = lambda c: F.col(c).cast("string")
    return o.select(
        F.concat(F.lit("e"), s("o_orderkey")).alias("entry_id"), F.concat(F.lit("o"), s("o_orderkey")).alias("item"), F.concat(F.lit("order-"), s("o_orderkey")).alias("name"),
        F.concat(F.lit("/c"), s("o_custkey"), F.lit("/order-"), s("o_orderkey")).alias("path"), F.col("o_orderdate").alias("deleted_at"), F.when(F.col("o_orderkey") % 11 != 0, F.concat(F.lit("e"), (F.col("o_orderkey") - F.col("o_orderkey") % 8).cast("string"))).alias("batch"),
        F.concat(F.lit("p"), (F.col("o_orderkey") % 5).cast("string")).alias("pass"), F.concat(F.lit("d"), (F.col("o_orderkey") % 3).cast("string")).alias("origin_drive"), (F.col("o_orderkey") % 7 == 0).alias("live"),
    )


T_SQL = """SELECT 'e' || o_orderkey AS entry_id, 'o' || o_orderkey AS item, 'order-' || o_orderkey AS name, '/c' || o_custkey || '/order-' || o_orderkey AS path, o_orderdate AS deleted_at,
CASE WHEN o_orderkey % 11 <> 0 THEN 'e' || (o_orderkey - o_orderkey % 8) END AS batch, 'p' || (o_orderkey % 5) AS pass, 'd' || (o_orderkey % 3) AS origin_drive, o_orderkey % 7 = 0 AS live FROM orders"""


def locks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range claims from events: (file, id, holder, start, end, shared, escalation_only, expires_at_ms)."""
    e = table(spark, sf_dir, "events")
    return e.select(
        (F.col("event_id") % 997).alias("file"), F.col("event_id").alias("id"), F.col("user_id").alias("holder"), (F.col("event_id") % 4000 * 10).alias("start"),
        (F.col("event_id") % 4000 * 10 + F.floor("value").cast("long") % 200 + 1).alias("end"), (F.col("event_id") % 3 == 0).alias("shared"), (F.col("event_id") % 11 == 0).alias("escalation_only"),
        (F.unix_seconds(F.date_trunc("second", F.col("ts").cast("timestamp"))) * 1000).alias("expires_at_ms"),
    )


K_SQL = """SELECT event_id % 997 AS file, event_id AS id, user_id AS holder, event_id % 4000 * 10 AS start, event_id % 4000 * 10 + CAST(floor(value) AS BIGINT) % 200 + 1 AS "end",
event_id % 3 = 0 AS shared, event_id % 11 = 0 AS escalation_only, CAST(epoch(date_trunc('second', ts)) AS BIGINT) * 1000 AS expires_at_ms FROM events"""


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The locks, of which every 501st is on the whole file from its start on."""
    return locks(spark, sf_dir).withColumn("end", F.when(F.col("id") % 501 == 0, F.lit(-(1 << 63))).otherwise(F.col("end")))


#: The same with the ends as numbers that compare: 9223372036854775807 for a whole file.
W_SQL = f"""SELECT * REPLACE (CASE WHEN id % 501 = 0 THEN 9223372036854775807 ELSE "end" END AS "end") FROM ({K_SQL})"""


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Version records with content from documents: (idx, item, path, version, date, sha256, size, stub, referrers)."""
    d = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    return d.select(
        F.col("doc_id").alias("idx"), F.concat(F.lit("i"), (F.col("doc_id") % 400).cast("string")).alias("item"), F.concat(F.lit("/"), "source", F.lit("/"), (F.col("doc_id") % 400).cast("string")).alias("path"),
        F.concat(F.lit("v"), F.col("doc_id").cast("string")).alias("version"), (F.col("doc_id") % 97).alias("date"), F.sha2(text, 256).alias("sha256"), F.octet_length(text).cast("long").alias("size"),
        (F.col("doc_id") % 13 == 5).alias("stub"), (F.col("doc_id") % 6).alias("referrers"), (F.col("doc_id") % 4 == 0).alias("current"),
    )


C_SQL = """SELECT doc_id AS idx, 'i' || (doc_id % 400) AS item, '/' || source || '/' || (doc_id % 400) AS path, 'v' || doc_id AS version, doc_id % 97 AS date, sha256(coalesce(text, '')) AS sha256,
CAST(strlen(coalesce(text, '')) AS BIGINT) AS size, doc_id % 13 = 5 AS stub, doc_id % 6 AS referrers, doc_id % 4 = 0 AS current FROM documents"""
