"""Queries on version histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import temporal as T
from tidemark.sources.adapters import EFF_SQL, NTZ, V_SQL, dates, store_second, table, versions

AT = "2024-01-15 00:00:00"
MOMENTS = ["2024-01-05 00:00:00", "2024-01-12 12:00:00", "2024-01-20 00:00:00", "2024-02-01 00:00:00"]
NAMES = [("alpha", "2024-01-04 09:00:00"), ("beta", "2024-01-10 00:00:00"), ("gamma", "2024-01-18 18:30:00"), ("omega", "2024-03-01 00:00:00")]
QUERIES: dict = {}
ORACLE: dict = {}
_COLS = "key, seq, eff, size"


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return put


def dated(spark, sf):
    return T.effective(versions(spark, sf), dates(spark, sf))


def _asof_sql(source: str, at: str = AT) -> str:
    return f"SELECT {_COLS} FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY eff DESC, seq DESC) AS rn FROM ({source}) WHERE eff <= TIMESTAMP '{at}') WHERE rn = 1 AND NOT deleted"


_STORE_SQL = f"SELECT *, date_trunc('second', last_modified) AS eff FROM ({V_SQL})"
_HOUR_SQL = f"SELECT *, date_trunc('day', last_modified) AS eff FROM ({V_SQL})"


@query("s02_key_history", f"SELECT key, seq, last_modified, deleted, row_number() OVER (ORDER BY seq DESC) - 1 AS pos FROM ({V_SQL}) WHERE key = 7")
def s02(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("key").orderBy(F.desc("seq"))
    return versions(spark, sf).where("key = 7").select("key", "seq", "last_modified", "deleted", (F.row_number().over(w) - 1).cast("long").alias("pos"))


@query("s03_prefix_history", f"SELECT key, seq, deleted, size FROM ({V_SQL}) WHERE starts_with(CAST(key AS VARCHAR), '1')")
def s03(spark, sf):
    return versions(spark, sf).where(F.col("key").cast("string").startswith("1")).select("key", "seq", "deleted", "size")


@query("s04_history_sample", f"SELECT key, seq FROM ({V_SQL}) WHERE key = 3 ORDER BY seq DESC LIMIT 5")
def s04(spark, sf):
    return versions(spark, sf).where("key = 3").orderBy(F.desc("seq")).limit(5).select("key", "seq")


@query("s05_versions_since", f"SELECT key, seq, last_modified FROM ({V_SQL}) WHERE NOT deleted AND last_modified >= TIMESTAMP '{AT}'")
def s05(spark, sf):
    return versions(spark, sf).where(~F.col("deleted") & (F.col("last_modified") >= F.lit(AT).cast(NTZ))).select("key", "seq", "last_modified")


@query("s06_live_keys", f"SELECT key, size FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM ({V_SQL})) WHERE rn = 1 AND NOT deleted")
def s06(spark, sf):
    return T.newest(versions(spark, sf), ["key"], [F.col("seq")], ["key", "size", "deleted"]).where("not deleted").select("key", "size")


@query("s07_listing_after", f"SELECT key, size FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM ({V_SQL})) WHERE rn = 1 AND NOT deleted AND key > 20 ORDER BY key LIMIT 10")
def s07(spark, sf):
    return s06(spark, sf).where("key > 20").orderBy("key").limit(10)


@query("s08_paged_fold", f"SELECT (n - 1) // 1000 AS page, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes, max(seq) AS cursor FROM (SELECT *, row_number() OVER (ORDER BY seq) AS n FROM ({V_SQL}) WHERE NOT deleted) GROUP BY 1")
def s08(spark, sf):
    """A listing in pages of a thousand, each with its sums and the cursor that the next one goes on from."""
    from tidemark.operators.dedupe import ranked

    rows = ranked(versions(spark, sf).where("not deleted").select("seq", "size"), [F.asc("seq")], "n")
    return rows.groupBy(F.floor((F.col("n") - 1) / 1000).alias("page")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.max("seq").alias("cursor"))


@query("f02_store_second", "SELECT event_id, date_trunc('second', ts) AS second FROM events")
def f02(spark, sf):
    return table(spark, sf, "events").select("event_id", store_second(F.col("ts")).alias("second"))


@query("j01_effective_dates", f"SELECT key, seq, eff, deleted FROM ({EFF_SQL})")
def j01(spark, sf):
    return dated(spark, sf).select("key", "seq", "eff", "deleted")


@query("w01_as_of_pick", _asof_sql(EFF_SQL))
def w01(spark, sf):
    return T.as_of(dated(spark, sf), AT).select("key", "seq", "eff", "size")


@query("w01_as_of_ties", _asof_sql(_HOUR_SQL))
def w01_ties(spark, sf):
    days = versions(spark, sf).withColumn("eff", F.date_trunc("day", "last_modified").cast(NTZ))
    return T.as_of(days, AT).select("key", "seq", "eff", "size")


@query("w02_history_up_to", f"SELECT key, seq, eff, deleted FROM ({EFF_SQL}) WHERE eff <= TIMESTAMP '{AT}'")
def w02(spark, sf):
    return dated(spark, sf).where(F.col("eff") <= F.lit(AT).cast(NTZ)).select("key", "seq", "eff", "deleted")


@query("w03_bulk_as_of", _asof_sql(_STORE_SQL))
def w03(spark, sf):
    return T.as_of(T.effective(versions(spark, sf)), AT).select("key", "seq", "eff", "size")


@query("w04_version_list", f"SELECT key, seq, eff, current, row_number() OVER (PARTITION BY key ORDER BY eff DESC, seq DESC) AS rank FROM (SELECT *, seq = max(seq) OVER (PARTITION BY key) AND NOT deleted AS current FROM ({EFF_SQL})) WHERE NOT deleted")
def w04(spark, sf):
    return T.version_list(dated(spark, sf)).select("key", "seq", "eff", "current", F.col("rank").cast("long").alias("rank"))


@query("w05_version_intervals", f"SELECT key, seq, eff, lead(eff) OVER (PARTITION BY key ORDER BY eff, seq) AS until, deleted FROM ({EFF_SQL})")
def w05(spark, sf):
    return T.intervals(dated(spark, sf)).select("key", "seq", "eff", "until", "deleted")


def _not_states_sql(rounds: int = 12) -> str:
    """Rounds of the definition, none late at first; twelve are more than these tables need, and a test holds that."""
    out = [f"r0 AS (SELECT key, seq, eff, false AS late, false AS shadowed FROM ({EFF_SQL}) WHERE NOT deleted)"]
    for i in range(rounds):
        out.append(f"""s{i} AS (SELECT * REPLACE (coalesce(bool_or(NOT late) OVER (PARTITION BY key, eff ORDER BY seq DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS shadowed) FROM r{i}),
r{i + 1} AS (SELECT * REPLACE (NOT shadowed AND coalesce(eff < max(eff) FILTER (NOT shadowed) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS late) FROM s{i})""")
    return "WITH " + ", ".join(out) + f" SELECT key, seq, CASE WHEN shadowed THEN 'shadowed' ELSE 'late' END AS state FROM r{rounds} WHERE shadowed OR late"


@query("w06_not_states", _not_states_sql())
def w06(spark, sf):
    return T.not_states(dated(spark, sf))


@query("w09_w10_record_at", f"SELECT key, max_by(seq, (eff, seq)) AS seq FROM ({EFF_SQL}) WHERE eff <= TIMESTAMP '{AT}' GROUP BY key")
def w10(spark, sf):
    return T.newest(dated(spark, sf).where(F.col("eff") <= F.lit(AT).cast(NTZ)), ["key"], [F.col("eff"), F.col("seq")], ["key", "seq"])


@query("w17_written_behind", f"SELECT DISTINCT key FROM ({_not_states_sql()}) WHERE state = 'late'")
def w17(spark, sf):
    return T.written_behind(dated(spark, sf))


@query("w20_history_span", f"SELECT min(last_modified) AS created, max(last_modified) AS newest FROM ({V_SQL})")
def w20(spark, sf):
    return versions(spark, sf).agg(F.min("last_modified").alias("created"), F.max("last_modified").alias("newest"))


@query("a14_state_span", f"SELECT key, min(eff) AS first, max(eff) AS latest FROM ({EFF_SQL}) WHERE NOT deleted GROUP BY key")
def a14(spark, sf):
    return dated(spark, sf).where("not deleted").groupBy("key").agg(F.min("eff").alias("first"), F.max("eff").alias("latest"))


@query("a16_created_fallback", f"SELECT key, coalesce(max(CASE WHEN key % 3 = 0 THEN TIMESTAMP '2023-12-01 00:00:00' END), min(last_modified)) AS created FROM ({V_SQL}) GROUP BY key")
def a16(spark, sf):
    recorded = F.when(F.col("key") % 3 == 0, F.lit("2023-12-01 00:00:00").cast(NTZ))
    return versions(spark, sf).groupBy("key").agg(F.coalesce(F.max(recorded), F.min("last_modified")).alias("created"))


_VALUES = ", ".join(f"('{n}', TIMESTAMP '{t}')" for n, t in NAMES)


@query("j05_names_range_join", f"""WITH i AS (SELECT *, lead(eff) OVER (PARTITION BY key ORDER BY eff, seq) AS until FROM ({EFF_SQL}))
SELECT i.key, i.seq, string_agg(n.name, ',' ORDER BY n.name) AS names FROM i JOIN (VALUES {_VALUES}) n(name, "at") ON n."at" >= i.eff AND n."at" < coalesce(i.until, TIMESTAMP '2024-06-01 01:00:00') WHERE NOT i.deleted GROUP BY i.key, i.seq""")
def j05(spark, sf):
    return T.named_versions(dated(spark, sf), NAMES, "2024-06-01 00:00:00").select("key", "seq", F.array_join("names", ",").alias("names"))


_TIMES = ", ".join(f"(TIMESTAMP '{t}')" for t in MOMENTS)


@query("j06_as_of_many", f"""SELECT "at", key, seq, size FROM (SELECT *, row_number() OVER (PARTITION BY "at", key ORDER BY eff DESC, seq DESC) AS rn FROM (VALUES {_TIMES}) m("at") JOIN ({EFF_SQL}) e ON e.eff <= m."at") WHERE rn = 1 AND NOT deleted""")
def j06(spark, sf):
    return T.as_of_many(dated(spark, sf), MOMENTS).select("at", "key", "seq", "size")


_REQ_SQL = """SELECT o_orderkey AS id, o_custkey % 50 AS key, TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(o_orderkey % 700 AS INT)) AS "at" FROM orders"""


@query("j06_as_of_join", f"""SELECT id, key, "at", CASE WHEN deleted THEN NULL ELSE seq END AS seq, CASE WHEN deleted THEN NULL ELSE size END AS size FROM (
SELECT r.id, r.key, r."at", e.seq, e.size, e.deleted, row_number() OVER (PARTITION BY r.id ORDER BY e.eff DESC, e.seq DESC) AS rn FROM ({_REQ_SQL}) r LEFT JOIN ({EFF_SQL}) e ON e.key = r.key AND e.eff <= r."at") WHERE rn = 1""")
def j06_join(spark, sf):
    o = table(spark, sf, "orders")
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("o_orderkey") % 700 * 3600).cast(NTZ)
    left = o.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 50).alias("key"), at.alias("at"))
    return T.as_of_join(left, dated(spark, sf))


def changes(spark, sf):
    """Entry changes of folders: dir = user, name = event type, item = event."""
    e = table(spark, sf, "events")
    return e.select(F.col("user_id").alias("dir"), (F.col("event_id") % 4).alias("name"), F.col("event_id").cast("string").alias("item"), store_second(F.col("ts")).alias("at"), (F.col("event_type") != "error").alias("present"), F.col("event_id").alias("seq"))


_LIFE_SQL = """SELECT dir, name, item, from_at, to_at FROM (
SELECT dir, name, held AS item, "at" AS from_at, lead("at") OVER (PARTITION BY dir, name ORDER BY "at", seq) AS to_at FROM (
SELECT *, lag(held) OVER (PARTITION BY dir, name ORDER BY "at", seq) AS was FROM (
SELECT user_id AS dir, event_id % 4 AS name, CASE WHEN event_type <> 'error' THEN CAST(event_id AS VARCHAR) END AS held, date_trunc('second', ts) AS "at", event_id AS seq,
row_number() OVER (PARTITION BY user_id, event_id % 4, date_trunc('second', ts) ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1) WHERE held IS DISTINCT FROM was) WHERE item IS NOT NULL"""


@query("w08_lifetimes", _LIFE_SQL)
def w08(spark, sf):
    return T.lifetimes(changes(spark, sf))


@query("w09_entries_at", f"SELECT * FROM ({_LIFE_SQL}) WHERE from_at <= TIMESTAMP '{AT}' AND (to_at IS NULL OR to_at > TIMESTAMP '{AT}')")
def w09(spark, sf):
    return T.entries_at(w08(spark, sf), AT)


_U0, _U1 = "2024-01-08 00:00:00", "2024-01-16 00:00:00"


@query("w12_late_remove", f"""WITH l AS ({_LIFE_SQL}), h AS (SELECT *, dir % 2 = 0 AND from_at < TIMESTAMP '{_U1}' AND (to_at IS NULL OR to_at > TIMESTAMP '{_U0}') AS hit FROM l)
SELECT dir, name, item, from_at, to_at FROM h WHERE NOT hit
UNION ALL SELECT dir, name, item, from_at, TIMESTAMP '{_U0}' FROM h WHERE hit AND from_at < TIMESTAMP '{_U0}'
UNION ALL SELECT dir, name, item, TIMESTAMP '{_U1}', to_at FROM h WHERE hit AND (to_at IS NULL OR to_at > TIMESTAMP '{_U1}')""")
def w12(spark, sf):
    spans = w08(spark, sf)
    gone = spans.where("dir % 2 = 0").select("dir", "name", "item").distinct().withColumn("at", F.lit(_U0).cast(NTZ)).withColumn("until", F.lit(_U1).cast(NTZ))
    return T.cut_out(spans, gone)


@query("w11_late_add", f"""WITH l AS ({_LIFE_SQL}), a AS (SELECT DISTINCT dir, name FROM l WHERE dir % 3 = 0),
m AS (SELECT dir, name, greatest(from_at, TIMESTAMP '{_U0}') AS f, least(coalesce(to_at, TIMESTAMP '{_U1}'), TIMESTAMP '{_U1}') AS t FROM l JOIN a USING (dir, name) WHERE from_at < TIMESTAMP '{_U1}' AND (to_at IS NULL OR to_at > TIMESTAMP '{_U0}')
  UNION ALL SELECT dir, name, TIMESTAMP '{_U1}', TIMESTAMP '{_U1}' FROM a),
g AS (SELECT dir, name, f, coalesce(max(t) OVER (PARTITION BY dir, name ORDER BY f, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TIMESTAMP '{_U0}') AS s FROM m)
SELECT * FROM l UNION ALL SELECT dir, name, 'late', s, f FROM g WHERE s < f""")
def w11(spark, sf):
    spans = w08(spark, sf)
    new = spans.where("dir % 3 = 0").select("dir", "name").distinct().select("dir", "name", F.lit("late").alias("item"), F.lit(_U0).cast(NTZ).alias("at"), F.lit(_U1).cast(NTZ).alias("until"))
    return T.fill_in(spans, new)


def states_sql(spans: str) -> str:
    """States at every change point, each summed up anew from the lifetimes that cover it."""
    return f"""WITH l AS ({spans}), t AS (SELECT DISTINCT dir, "at" FROM (SELECT dir, from_at AS "at" FROM l UNION ALL SELECT dir, to_at FROM l WHERE to_at IS NOT NULL)),
s AS (SELECT t.dir, t."at", count(l.item) AS n, CAST(coalesce(sum(CAST('0x' || substr(md5(CAST(l.name AS VARCHAR) || '/' || l.item), 1, 15) AS BIGINT)), 0) AS VARCHAR) AS total
  FROM t LEFT JOIN l ON l.dir = t.dir AND l.from_at <= t.at AND (l.to_at IS NULL OR l.to_at > t.at) GROUP BY t.dir, t.at)
SELECT dir, "at", n, total FROM (SELECT *, lag(n || ':' || total) OVER (PARTITION BY dir ORDER BY "at") AS was FROM s) WHERE was IS DISTINCT FROM n || ':' || total"""


@query("w07_folder_states", states_sql(_LIFE_SQL))
def w07(spark, sf):
    return T.folder_states(w08(spark, sf))


@query("w13_clip_to_first_state", f"""WITH f AS (SELECT key, min(eff) AS first FROM ({EFF_SQL}) WHERE NOT deleted GROUP BY key)
SELECT d.key, d.seq, greatest(d.eff, f.first) AS "at" FROM ({EFF_SQL}) d JOIN f USING (key) WHERE greatest(d.eff, f.first) < TIMESTAMP '{AT}'""")
def w13(spark, sf):
    d = dated(spark, sf)
    first = d.where("not deleted").groupBy("key").agg(F.min("eff").alias("first"))
    return d.join(first, "key").select("key", "seq", F.greatest("eff", "first").alias("at")).where(F.col("at") < F.lit(AT).cast(NTZ))


def late_entries(spark, sf):
    """Changes dated behind their folder's newest state as additions: (dir, name, item, at, until, seq), until that state; the present ones."""
    from pyspark.sql import Window

    e = dated(spark, sf).select(F.col("key").alias("dir"), (F.col("seq") % 4).alias("name"), F.col("seq").cast("string").alias("item"), F.col("eff").alias("at"), (~F.col("deleted")).alias("present"), "seq")
    newest = F.max("at").over(Window.partitionBy("dir").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    return e.withColumn("until", newest).where("at < until and present").drop("present")


LATE_SQL = f"""SELECT dir, name, item, "at", until, seq FROM (SELECT key AS dir, seq % 4 AS name, CAST(seq AS VARCHAR) AS item, eff AS "at", deleted, seq,
max(eff) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS until FROM ({EFF_SQL})) WHERE "at" < until AND NOT deleted"""
#: Late additions, segment by segment between all the moments at which anything of a name begins or ends: a free segment goes to the first addition that covers it.
SETTLED_SQL = f"""WITH l AS ({_LIFE_SQL}), a AS ({LATE_SQL}), c AS (SELECT dir, name, unnest([from_at, to_at]) AS t FROM l UNION SELECT dir, name, unnest(["at", until]) FROM a),
g AS (SELECT dir, name, t AS f, lead(t) OVER (PARTITION BY dir, name ORDER BY t) AS t FROM (SELECT DISTINCT * FROM c WHERE t IS NOT NULL)),
w AS (SELECT g.dir, g.name, g.f, g.t, arg_min(a.item, (a."at", a.seq)) AS item FROM g JOIN a ON a.dir = g.dir AND a.name = g.name AND a."at" <= g.f AND a.until >= g.t
  WHERE g.t IS NOT NULL AND NOT EXISTS (SELECT 1 FROM l WHERE l.dir = g.dir AND l.name = g.name AND l.from_at <= g.f AND (l.to_at IS NULL OR l.to_at >= g.t)) GROUP BY ALL),
n AS (SELECT *, sum(CASE WHEN f = was AND item = before THEN 0 ELSE 1 END) OVER (PARTITION BY dir, name ORDER BY f) AS run FROM (SELECT *, lag(t) OVER o AS was, lag(item) OVER o AS before FROM w WINDOW o AS (PARTITION BY dir, name ORDER BY f)))
SELECT dir, name, item, from_at, to_at FROM l UNION ALL SELECT dir, name, any_value(item), min(f), max(t) FROM n GROUP BY dir, name, run"""


def settled(spark, sf):
    return T.fill_in(w08(spark, sf), late_entries(spark, sf))


@query("w14_settle_states", f"""SELECT dir, count(*) AS states, max("at") AS latest FROM ({states_sql(SETTLED_SQL)}) GROUP BY dir""")
def w14(spark, sf):
    """States of each folder once its late changes are in their places; one like the state before it is none."""
    return T.folder_states(settled(spark, sf)).groupBy("dir").agg(F.count("*").alias("states"), F.max("at").alias("latest"))


@query("w18_derived_mtime", """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN TIMESTAMP '2024-01-02 00:00:00' ELSE greatest(ts, date_trunc('day', ts) + to_hours(6)) END AS mtime FROM events""")
def w18(spark, sf):
    e = table(spark, sf, "events")
    floor = F.timestamp_seconds(F.unix_seconds(F.date_trunc("day", F.col("ts").cast("timestamp"))) + 6 * 3600).cast(NTZ)
    return e.select("event_id", derived_mtime(F.when(F.col("event_id") % 5 == 0, F.lit("2024-01-02 00:00:00").cast(NTZ)), F.when(F.col("event_id") % 5 == 0, F.lit("x")), F.lit("x"), F.col("ts"), floor).alias("mtime"))


def derived_mtime(override, override_etag, content_etag, content_time, created_bound):
    """The override while it was set for the content's own etag; else the content's time, not before the item's creation."""
    return F.when(override.isNotNull() & (override_etag == content_etag), override).otherwise(F.greatest(content_time, created_bound))


@query("w19_derived_ctime", "SELECT event_id, greatest(date_trunc('hour', ts), ts, TIMESTAMP '2024-01-10 00:00:00') AS ctime FROM events")
def w19(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", F.greatest(F.date_trunc("hour", "ts").cast(NTZ), F.col("ts"), F.lit("2024-01-10 00:00:00").cast(NTZ)).alias("ctime"))


@query("w22_history_rewrite", f"""SELECT key, seq, eff FROM ({EFF_SQL}) WHERE key % 10 <> 3
UNION ALL SELECT key, row_number() OVER (PARTITION BY key ORDER BY eff) AS seq, eff FROM (SELECT DISTINCT key, eff FROM ({EFF_SQL}) WHERE key % 10 = 3 AND NOT deleted)""")
def w22(spark, sf):
    """Histories of some keys replaced by their distinct states, strictly increasing; the others stay."""
    from pyspark.sql import Window

    d = dated(spark, sf)
    new = d.where("key % 10 = 3 and not deleted").select("key", "eff").distinct().withColumn("seq", F.row_number().over(Window.partitionBy("key").orderBy("eff")).cast("long"))
    return d.where("key % 10 <> 3").select("key", "seq", "eff").unionByName(new)
