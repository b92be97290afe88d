"""Queries on scalar functions: names, paths, rights, times, codecs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import names as N
from tidemark.functions import rights as R
from tidemark.functions import values as V
from tidemark.sources.adapters import table

from .catalog import Catalog
from .q_tree import WALK_SQL, walked

catalog = Catalog()
QUERIES, ORACLE, query = catalog.queries, catalog.oracle, catalog.query
_URLNAME = "regexp_extract(url, '([^/]*)$', 1)"


def url_names(spark, sf):
    return table(spark, sf, "pages").select("page_id", "url", F.regexp_extract("url", "([^/]*)$", 1).alias("name"))


@query("p12_relatime_due", "SELECT event_id, ts <= TIMESTAMP '2024-01-10 00:00:00' OR ts <= date_trunc('hour', ts) OR epoch_us(TIMESTAMP '2024-01-20 00:00:00') - epoch_us(ts) >= 86400000000 AS due FROM events")
def p12(spark, sf):
    t = lambda x: F.lit(x).cast("timestamp_ntz")
    return table(spark, sf, "events").select("event_id", V.relatime_due(F.col("ts"), t("2024-01-10 00:00:00"), F.date_trunc("hour", "ts").cast("timestamp_ntz"), t("2024-01-20 00:00:00")).alias("due"))


_NAMES = """SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'con.txt' WHEN 1 THEN 'LPT' || (doc_id % 11) WHEN 2 THEN 'a:b' WHEN 3 THEN 'ends ' WHEN 4 THEN 'ends.' WHEN 5 THEN '' WHEN 6 THEN source || chr(9) ELSE source || '.txt' END AS name FROM documents"""


def odd_names(spark, sf):
    d, k = table(spark, sf, "documents"), F.col("doc_id") % 8
    name = F.when(k == 0, "con.txt").when(k == 1, F.concat(F.lit("LPT"), (F.col("doc_id") % 11).cast("string"))).when(k == 2, "a:b").when(k == 3, "ends ").when(k == 4, "ends.").when(k == 5, "").when(k == 6, F.concat("source", F.lit("\t"))).otherwise(F.concat("source", F.lit(".txt")))
    return d.select("doc_id", name.alias("name"), "source", "text")


@query("p13_reserved_names", f"""SELECT doc_id, name, name = '' OR regexp_matches(name, '[\\x00-\\x1f<>:"/\\\\|?*]') OR ends_with(name, ' ') OR ends_with(name, '.') OR upper(split_part(name, '.', 1)) IN ('CON', 'PRN', 'AUX', 'NUL') OR regexp_full_match(upper(split_part(name, '.', 1)), '(COM|LPT)[1-9]') AS reserved FROM ({_NAMES})""")
def p13(spark, sf):
    return odd_names(spark, sf).select("doc_id", "name", N.reserved(F.col("name")).alias("reserved"))


@query("p14_name_lengths", "SELECT doc_id, CAST(strlen(text) > 255 AS BOOLEAN) AS posix, length(text) > 255 AS windows FROM documents")
def p14(spark, sf):
    return odd_names(spark, sf).select("doc_id", N.too_long(F.col("text"), False).alias("posix"), N.too_long(F.col("text"), True).alias("windows"))


@query("p15_version_names", f"SELECT doc_id, name, regexp_full_match(name, '[A-Za-z0-9][A-Za-z0-9._ -]{{0,62}}') AS ok FROM ({_NAMES})")
def p15(spark, sf):
    return odd_names(spark, sf).select("doc_id", "name", N.version_name_ok(F.col("name")).alias("ok"))


@query("p16_path_validity", "SELECT page_id, NOT list_contains(string_split(regexp_replace(url, '^/', ''), '/'), '') AND NOT list_contains(string_split(url, '/'), '.') AND NOT list_contains(string_split(url, '/'), '..') AS ok FROM pages")
def p16(spark, sf):
    return table(spark, sf, "pages").select("page_id", N.path_ok(F.col("url")).alias("ok"))


@query("p17_app_keys", "SELECT doc_id, regexp_full_match(replace(source, 'c', '.'), '[a-z0-9]+\\.[A-Za-z0-9._-]+') AS ok FROM documents")
def p17(spark, sf):
    return table(spark, sf, "documents").select("doc_id", N.app_key_ok(F.translate("source", "c", ".")).alias("ok"))


@query("p18_trash_cursors", "SELECT o_orderkey, o_orderkey % 3 <> 2 AS ok FROM orders")
def p18(spark, sf):
    k = F.col("o_orderkey")
    cursor = F.when(k % 3 == 0, F.concat(F.lpad(k.cast("string"), 19, "0"), F.lit("-e"), k.cast("string"))).when(k % 3 == 1, F.concat(F.lit("e"), k.cast("string"))).otherwise("No/Cursor")
    return table(spark, sf, "orders").select("o_orderkey", N.trash_cursor_ok(cursor).alias("ok"))


@query("p21_format_gate", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem WHERE l_linenumber % 3 <> 0 GROUP BY 1, 2")
def p21(spark, sf):
    """Rows of a known layout; those of another are told apart first, as the gate would raise an error."""
    layout = F.when(F.col("l_linenumber") % 3 == 0, 9).otherwise(1)
    li = table(spark, sf, "lineitem").withColumn("layout", layout).where("layout = 1")
    return li.groupBy("l_orderkey", V.gated(F.col("layout"), F.col("l_linenumber")).alias("l_linenumber")).agg(F.count("*").alias("n"))


_KEYS = "SELECT doc_id, source || '-' || doc_id || CASE doc_id % 6 WHEN 0 THEN '.metadata' WHEN 1 THEN '.lock' WHEN 2 THEN '.refs' WHEN 3 THEN '.version' WHEN 4 THEN '.ads.stream' ELSE '' END AS key FROM documents"


@query("f01_base_keys", f"SELECT doc_id, CASE WHEN contains(key, '.ads.') THEN split_part(key, '.ads.', 1) ELSE regexp_replace(key, '\\.(metadata|lock|refs|version)$', '') END AS base FROM ({_KEYS})")
def f01(spark, sf):
    k = F.col("doc_id") % 6
    end = F.when(k == 0, ".metadata").when(k == 1, ".lock").when(k == 2, ".refs").when(k == 3, ".version").when(k == 4, ".ads.stream").otherwise("")
    return table(spark, sf, "documents").select("doc_id", N.base_key(F.concat("source", F.lit("-"), F.col("doc_id").cast("string"), end)).alias("base"))


@query("f03_parse_as_of", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN date_trunc('day', o_orderdate) + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND ELSE date_trunc('minute', o_orderdate) END AS moment FROM orders")
def f03(spark, sf):
    text = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm"))
    return table(spark, sf, "orders").select("o_orderkey", V.as_of_moment(text).alias("moment"))


@query("f04_fold_key", "SELECT doc_id, CASE WHEN text = '' THEN '' ELSE array_to_string([lpad(upper(to_hex(unicode(CASE WHEN c = 'ß' THEN c WHEN length(upper(c)) = 1 THEN upper(c) ELSE c END))), 8, '0') FOR c IN string_split(text, '')], '') END AS folded FROM documents")
def f04(spark, sf):
    return table(spark, sf, "documents").select("doc_id", N.fold_bytes(F.col("text")).alias("folded"))


@query("o03_folded_order", "SELECT lang, string_agg(s, ',' ORDER BY upper(s), s) AS sources FROM (SELECT DISTINCT lang, CASE WHEN doc_id % 2 = 0 THEN upper(source) ELSE source END AS s FROM documents) GROUP BY lang")
def o03(spark, sf):
    d = table(spark, sf, "documents").select("lang", F.when(F.col("doc_id") % 2 == 0, F.upper("source")).otherwise(F.col("source")).alias("s")).distinct()
    rows = d.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct(N.fold_key(F.col("s")).alias("k"), "s"))).alias("a"))
    return rows.select("lang", F.array_join(F.transform("a", lambda x: x["s"]), ",").alias("sources"))


@query("f06_windows_names", f"SELECT doc_id, name AS back FROM ({_NAMES})")
def f06(spark, sf):
    """Shown on Windows and stored again: the same name."""
    return odd_names(spark, sf).select("doc_id", N.windows_stored(N.windows_shown(F.col("name"))).alias("back"))


@query("f06_windows_shown", f"""SELECT doc_id, regexp_replace(regexp_replace(translate(name, ':' || chr(9), chr(61498) || chr(61449)), ' $', chr(61472)), '\\.$', chr(61486)) AS shown FROM ({_NAMES})""")
def f06_shown(spark, sf):
    return odd_names(spark, sf).select("doc_id", N.windows_shown(F.col("name")).alias("shown"))


@query("f07_windows_paths", "SELECT page_id, replace(translate(replace(url, '/', chr(1)), ':?', chr(61498) || chr(61503)), chr(1), chr(92)) AS path FROM pages")
def f07(spark, sf):
    return table(spark, sf, "pages").select("page_id", N.windows_path(F.col("url")).alias("path"))


@query("f08_path_join", "SELECT page_id, '/root/' || array_to_string(list_filter(string_split(url, '/'), lambda p: p <> ''), '/') AS path FROM pages")
def f08(spark, sf):
    return table(spark, sf, "pages").select("page_id", N.joined_path(F.lit("/root/"), F.col("url")).alias("path"))


@query("f09_stream_names", "SELECT doc_id, source AS file, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 's' || (doc_id % 9) END AS stream, doc_id % 5 = 0 AS refused FROM documents")
def f09(spark, sf):
    k = F.col("doc_id")
    name = F.concat(F.lit("dir\\"), "source", F.lit(":"), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("s"), (k % 9).cast("string"))), F.when(k % 5 == 0, ":$INDEX").when(k % 2 == 0, ":$DATA").otherwise(""))
    return table(spark, sf, "documents").select("doc_id", N.stream_name(name).alias("s")).select("doc_id", "s.*")


@query("f10_prefix_bound", "SELECT count(*) AS n FROM pages WHERE url >= 'https' AND url < 'httpt'")
def f10(spark, sf):
    return table(spark, sf, "pages").where(F.col("url").startswith("https")).agg(F.count("*").alias("n"))


@query("f11_uuid_time", "SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN date_trunc('millisecond', ts) END AS created FROM events")
def f11(spark, sf):
    ms = F.lpad(F.lower(F.hex(F.unix_millis(F.col("ts").cast("timestamp")))), 12, "0")
    key = F.concat(F.when(F.col("event_id") % 3 == 0, "00ab-").otherwise(""), F.substring(ms, 1, 8), F.lit("-"), F.substring(ms, 9, 4), F.when(F.col("event_id") % 4 == 0, "-4abc").otherwise("-7abc"), F.lit("-8123-0123456789ab"))
    return table(spark, sf, "events").select("event_id", N.uuid_time(key).alias("created"))


@query("f14_trash_keys", "SELECT o_orderkey, lpad(CAST(9223372036854775807 - epoch_us(o_orderdate) * 1000 AS VARCHAR), 19, '0') || '-e' || o_orderkey AS key FROM orders")
def f14(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", N.trash_key(F.col("o_orderdate"), F.concat(F.lit("e"), F.col("o_orderkey").cast("string"))).alias("key"))


_MASK = "(p_partkey * 2654435761) % 4294967296"


@query("f17_generic_rights", f"""SELECT p_partkey, (m | CASE WHEN m & 2147483648 <> 0 THEN 1179785 ELSE 0 END | CASE WHEN m & 1073741824 <> 0 THEN 1179926 ELSE 0 END | CASE WHEN m & 536870912 <> 0 THEN 1179808 ELSE 0 END
| CASE WHEN m & 268435456 <> 0 THEN 2032127 ELSE 0 END) & 268435455 AS rights FROM (SELECT p_partkey, CAST({_MASK} AS BIGINT) AS m FROM part)""")
def f17(spark, sf):
    return table(spark, sf, "part").select("p_partkey", R.map_generic(F.col("p_partkey") * 2654435761 % 4294967296).alias("rights"))


SDDL = "O:S-1-5-21-1-2-3-{u}G:BAD:(D;;0x{d:x};;;S-1-5-21-1-2-3-{v})(A;OICI;GR;;;WD)(A;;FA;;;BA)(A;IO;GA;;;CO)(A;CINP;0x{d:x};;;CO)(A;;WD;;;OW)"
_USER = "S-1-5-21-1-2-3-5"


def descriptors(spark, sf):
    p = table(spark, sf, "part")
    s = lambda c: c.cast("string")
    bits = F.lower(F.hex(F.col("p_size") * 3))
    deny = F.concat(F.lit("(D;;0x"), bits, F.lit(";;;S-1-5-21-1-2-3-"), s(F.col("p_partkey") % 7), F.lit(")"))
    rest = F.concat(F.lit("(A;OICI;GR;;;WD)(A;;FA;;;BA)(A;IO;GA;;;CO)(A;CINP;0x"), bits, F.lit(";;;CO)"), F.when(F.col("p_partkey") % 4 == 0, "(A;;FR;;;OW)").otherwise(""))
    text = F.when(F.col("p_partkey") % 50 == 0, "O:BA").otherwise(F.concat(F.lit("O:S-1-5-21-1-2-3-"), s(F.col("p_partkey") % 6), F.lit("G:BAD:"), deny, rest))
    return p.select("p_partkey", text.alias("sddl"))


@query("f18_sddl_parse", """SELECT p_partkey, CASE WHEN p_partkey % 50 = 0 THEN 'BA' ELSE 'S-1-5-21-1-2-3-' || (p_partkey % 6) END AS owner, p_partkey % 50 <> 0 AS has_dacl, CASE WHEN p_partkey % 50 = 0 THEN 0 WHEN p_partkey % 4 = 0 THEN 6 ELSE 5 END AS n_aces FROM part""")
def f18(spark, sf):
    sd = descriptors(spark, sf).withColumn("sd", R.sddl_parser()(F.col("sddl")))
    return sd.select("p_partkey", F.col("sd.owner").alias("owner"), F.col("sd.has_dacl").alias("has_dacl"), F.size("sd.aces").alias("n_aces"))


@query("f19_windows_rights", """SELECT p_partkey, CASE WHEN p_partkey % 50 = 0 THEN 2032127 ELSE (1179785 & ~CASE WHEN p_partkey % 7 = 5 THEN CAST(p_size * 3 AS BIGINT) ELSE 0 END)
| CASE WHEN p_partkey % 6 = 5 AND p_partkey % 4 <> 0 THEN 393216 ELSE 0 END END AS rights FROM part""")
def f19(spark, sf):
    sd = descriptors(spark, sf).withColumn("sd", R.sddl_parser()(F.col("sddl")))
    return sd.select("p_partkey", R.windows_rights(F.col("sd.owner"), F.col("sd.has_dacl"), F.col("sd.aces"), _USER, []).alias("rights"))


_SDDL_SQL = """CASE WHEN p_partkey % 50 = 0 THEN 'O:BA' ELSE 'O:S-1-5-21-1-2-3-' || (p_partkey % 6) || 'G:BAD:(D;;0x' || lower(to_hex(p_size * 3)) || ';;;S-1-5-21-1-2-3-' || (p_partkey % 7) || ')(A;OICI;GR;;;WD)(A;;FA;;;BA)(A;IO;GA;;;CO)(A;CINP;0x'
|| lower(to_hex(p_size * 3)) || ';;;CO)' || CASE WHEN p_partkey % 4 = 0 THEN '(A;;FR;;;OW)' ELSE '' END END"""


@query("f18_sddl_print", f"SELECT p_partkey, {_SDDL_SQL} AS sddl FROM part")
def f18_print(spark, sf):
    """Descriptors parsed and printed: the texts that they were built from."""
    sd = descriptors(spark, sf).select("p_partkey", R.sddl_parser()(F.col("sddl")).alias("sd"))
    return sd.select("p_partkey", R.sddl_printer()(F.col("sd")).alias("sddl"))


@query("f20_acl_inheritance", f"""SELECT p_partkey, 'A' AS type, CASE WHEN p_partkey % 2 = 0 THEN 19 ELSE 16 END AS flags, 1179785 AS mask, 'WD' AS sid FROM part WHERE p_partkey % 50 <> 0
UNION ALL SELECT p_partkey, 'A', 16, p_size * 3, '{_USER}' FROM part WHERE p_partkey % 50 <> 0 AND p_partkey % 2 = 0 UNION ALL SELECT p_partkey, 'A', 0, 2032127, '{_USER}' FROM part WHERE p_partkey % 50 = 0""")
def f20(spark, sf):
    """Of the entries, files and directories get the one for all; directories the creator's too, once; a list of none gives the owner all."""
    sd = descriptors(spark, sf).withColumn("sd", R.sddl_parser()(F.col("sddl")))
    kids = R.inherited(F.col("sd.aces"), F.col("p_partkey") % 2 == 0, F.lit(_USER), F.lit("BA"))
    return sd.select("p_partkey", F.explode(kids).alias("a")).select("p_partkey", "a.type", "a.flags", "a.mask", "a.sid")


_ACCESS = "SELECT p_partkey, p_size * 11 % 512 AS mode, p_partkey % 20 AS uid, p_partkey % 7 AS gid, p_partkey % 3 = 0 AS is_dir FROM part"


def access(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", (F.col("p_size") * 11 % 512).cast("int").alias("mode"), (F.col("p_partkey") % 20).alias("uid"), (F.col("p_partkey") % 7).alias("gid"), (F.col("p_partkey") % 3 == 0).alias("is_dir"))


@query("f21_posix_access", f"SELECT p_partkey, (CASE WHEN uid = 5 THEN mode >> 6 WHEN gid IN (1, 2) THEN mode >> 3 ELSE mode END) & 6 = 6 AS allowed, NOT (NOT is_dir AND mode & 73 = 0) AS root FROM ({_ACCESS})")
def f21(spark, sf):
    a = [F.col(c) for c in ("mode", "uid", "gid", "is_dir")]
    return access(spark, sf).select("p_partkey", R.posix_allows(*a, user=5, groups=[1, 2], want=6).alias("allowed"), R.posix_allows(*a, user=0, groups=[], want=1).alias("root"))


@query("f22_mode_access", f"SELECT p_partkey, mode & 292 <> 0 AS read, mode & 128 <> 0 AS write FROM ({_ACCESS})")
def f22(spark, sf):
    return access(spark, sf).select("p_partkey", R.by_mode(F.col("mode")).alias("m")).select("p_partkey", "m.*")


@query("f23_rights_struct", f"SELECT p_partkey, rights & 1 <> 0 AS read, rights & 2 <> 0 AS write, rights & 65536 <> 0 AS delete, rights & 262144 <> 0 AS change FROM ({ORACLE['f19_windows_rights']})")
def f23(spark, sf):
    return f19(spark, sf).select("p_partkey", R.rights_struct(F.col("rights")).alias("r")).select("p_partkey", "r.*")


@query("f25_mode_attributes", f"SELECT p_partkey, CASE WHEN mode & 128 = 0 THEN 292 ELSE 420 END AS mode, CASE WHEN mode & 128 <> 0 THEN 'full' WHEN mode & 292 <> 0 THEN 'read' ELSE 'empty' END AS dacl FROM ({_ACCESS})")
def f25(spark, sf):
    return access(spark, sf).select("p_partkey", V.mode_of_readonly(F.col("mode").bitwiseAND(F.lit(128)) == 0).alias("mode"), V.dacl_of_mode(F.col("mode")).alias("dacl"))


@query("f26_filetime", "SELECT event_id, (epoch_us(ts) + 11644473600000000) * 10 AS ticks, ts AS back FROM events")
def f26(spark, sf):
    ticks = V.to_filetime(F.col("ts"))
    return table(spark, sf, "events").select("event_id", ticks.alias("ticks"), V.from_filetime(ticks).alias("back"))


@query("f27_content_types", "SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 'text/x' WHEN p_partkey % 4 = 0 THEN 'text/html' WHEN p_partkey % 4 = 1 THEN 'application/pdf' ELSE 'application/octet-stream' END AS type FROM part")
def f27(spark, sf):
    k = F.col("p_partkey")
    name = F.concat("p_name", F.when(k % 4 == 0, ".HTML").when(k % 4 == 1, ".pdf").when(k % 4 == 2, ".weird").otherwise(""))
    return table(spark, sf, "part").select("p_partkey", V.content_type(F.when(k % 10 == 0, "text/x").otherwise(""), name).alias("type"))


@query("f28_text_diff")
def f28(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf, "conversations").withColumn("old", F.lag("text").over(w)).where("old is not null")
    return c.select("conv_id", "turn", V.unified_diff()(F.col("old"), F.col("text")).alias("diff"))


@query("f29_part_size", "SELECT o_orderkey, least(8388608 * CAST(pow(2, greatest(0, ceil(log2(greatest(s, 1) / 83886080000.0) - 1e-12))) AS BIGINT), 5368709120) AS part FROM (SELECT o_orderkey, o_orderkey * 1000000000 AS s FROM orders)")
def f29(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", V.part_size(F.col("o_orderkey") * 1000000000).alias("part"))


@query("f30_filesystem_ids", "SELECT n_nationkey, lpad(lower(to_hex(n_nationkey)), 4, '0') AS id FROM nation")
def f30(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", N.filesystem_id(F.col("n_nationkey")).alias("id"))


@query("f31_named_streams", "SELECT event_id, regexp_extract(props, '\"k\": ([0-9]+)', 1) AS id, 'k' AS names FROM events")
def f31(spark, sf):
    m = F.from_json("props", "map<string,string>")
    return table(spark, sf, "events").select("event_id", F.element_at(m, "k").alias("id"), F.array_join(F.map_keys(m), ",").alias("names"))


@query("f32_xattrs", "SELECT event_id, CASE WHEN event_type = 'click' THEN 'user.k,user.t' ELSE 'user.k' END AS names, regexp_extract(props, '([0-9]+)', 1) AS value FROM events")
def f32(spark, sf):
    k = F.regexp_extract("props", "([0-9]+)", 1)
    m = F.when(F.col("event_type") == "click", F.create_map(F.lit("user.k"), k, F.lit("user.t"), F.lit("c"))).otherwise(F.create_map(F.lit("user.k"), k))
    return table(spark, sf, "events").select("event_id", F.array_join(F.array_sort(F.map_keys(m)), ",").alias("names"), F.element_at(m, "user.k").alias("value"))


@query("f33_type_names", "SELECT l_linenumber, CASE l_linenumber WHEN 1 THEN 'dir' WHEN 2 THEN 'symlink' WHEN 3 THEN 'fifo' WHEN 4 THEN 'char-device' WHEN 5 THEN 'block-device' WHEN 6 THEN 'socket' ELSE 'unknown' END AS name, count(*) AS n FROM lineitem GROUP BY 1, 2")
def f33(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_linenumber", V.type_name(F.col("l_linenumber")).alias("name")).agg(F.count("*").alias("n"))


@query("f34_origin_equality", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem WHERE (l_partkey % 10, nullif(l_suppkey % 3, 0)) IS NOT DISTINCT FROM (l_orderkey % 10, nullif(l_linenumber % 3, 0)) GROUP BY 1, 2")
def f34(spark, sf):
    null0 = lambda c: F.when(c != 0, c)
    a = F.struct((F.col("l_partkey") % 10).alias("d"), null0(F.col("l_suppkey") % 3).alias("i"))
    b = F.struct((F.col("l_orderkey") % 10).alias("d"), null0(F.col("l_linenumber").cast("long") % 3).alias("i"))
    return table(spark, sf, "lineitem").where(a.eqNullSafe(b)).groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))


@query("a07_identities", f"SELECT kind, id, count(*) AS items FROM (SELECT 'uid' AS kind, uid AS id FROM ({_ACCESS}) UNION ALL SELECT 'gid', gid FROM ({_ACCESS})) GROUP BY 1, 2")
def a07(spark, sf):
    who = F.explode(F.array(F.struct(F.lit("uid").alias("kind"), F.col("uid").alias("id")), F.struct(F.lit("gid").alias("kind"), F.col("gid").alias("id")))).alias("w")
    return access(spark, sf).select(who).groupBy("w.kind", "w.id").agg(F.count("*").alias("items"))


@query("j22_inherited_acl", f"""{WALK_SQL}, own AS (SELECT id, path, depth, CASE WHEN id IN ('r1', 'n5', 'n7') OR (type = 'dir' AND CAST(substr(id, 2) AS BIGINT) % 17 = 0) THEN 'sd-' || id END AS sd FROM w),
a AS (SELECT o.id, arg_max(p.sd, p.depth) AS sd, arg_max(p.path, p.depth) AS source FROM own o JOIN own p ON p.sd IS NOT NULL AND (o.path = p.path OR starts_with(o.path, p.path || '/')) GROUP BY o.id)
SELECT own.id, a.sd, a.source FROM own LEFT JOIN a ON own.id = a.id""")
def j22(spark, sf):
    """The nearest descriptor at or above each item: paths' prefixes joined on equality, then the deepest kept."""
    w = walked(spark, sf)
    named = F.col("id").isin("r1", "n5", "n7") | ((F.col("type") == "dir") & (F.substring("id", 2, 20).cast("long") % 17 == 0))
    own = w.where(named).select(F.col("path").alias("source"), F.concat(F.lit("sd-"), "id").alias("sd"), F.col("depth").alias("_d"))
    parts = F.split("path", "/")
    up = w.select("id", F.explode(F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("source"))
    best = up.join(own, "source").groupBy("id").agg(F.max_by(F.struct("sd", "source"), "_d").alias("b"))
    return w.join(best, "id", "left").select("id", F.col("b.sd").alias("sd"), F.col("b.source").alias("source"))


@query("x09_permissions", f"SELECT p_partkey, lpad(CAST(((mode >> 6) & 7) AS VARCHAR) || ((mode >> 3) & 7) || (mode & 7), 3, '0') AS mode, uid, gid FROM ({_ACCESS})")
def x09(spark, sf):
    d = lambda n: F.shiftright("mode", n).bitwiseAND(F.lit(7)).cast("string")
    return access(spark, sf).select("p_partkey", F.concat(d(6), d(3), d(0)).alias("mode"), "uid", "gid")


@query("x08_capabilities", "SELECT 'drive' AS backend, true AS versions, true AS trash, true AS acls, false AS search UNION ALL SELECT 'folder', false, false, true, false")
def x08(spark, sf):
    return spark.sql("SELECT * FROM VALUES ('drive', true, true, true, false), ('folder', false, false, true, false) AS t(backend, versions, trash, acls, search)")
