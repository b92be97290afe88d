"""Order-dependent folds against plain models, at random and exhaustively."""

import datetime
import itertools
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import names as N
from tidemark.functions import rights as R
from tidemark.functions import values as V
from tidemark.operators import mutations as M
from tidemark.operators import ranges as G
from tidemark.operators import reconcile, tree
from tidemark.operators import temporal as T
from tidemark.operators import trash as X
from tidemark.sources import records
from tidemark.streaming import feed

DAY = datetime.datetime(2024, 1, 1)
day = lambda n: DAY + datetime.timedelta(days=n)


def model_not_states(effs):
    """Straight from the definition, effs in the order of storing: none late at first, again until no more are."""
    n, late = range(len(effs)), set()
    while True:
        shadowed = {i for i in n if any(effs[j] == effs[i] and j not in late for j in n if j > i)}
        now = {i for i in n if i not in shadowed and any(effs[j] > effs[i] for j in n if j < i and j not in shadowed)}
        if now == late:
            return {**dict.fromkeys(shadowed, "shadowed"), **dict.fromkeys(late, "late")}
        late = now


def test_not_states_all_short_histories(spark):
    histories = [h for n in range(1, 6) for h in itertools.product(range(4), repeat=n)]
    rows = [(k, s, day(e), False) for k, h in enumerate(histories) for s, e in enumerate(h)]
    got = T.not_states(spark.createDataFrame(rows, "key long, seq long, eff timestamp_ntz, deleted boolean")).collect()
    found = {}
    for r in got:
        found.setdefault(r.key, {})[r.seq] = r.state
    assert all(found.get(k, {}) == model_not_states(h) for k, h in enumerate(histories))


def bits(spans, limit=60):
    return {d: {t for a, b in s for t in range(a, min(b, limit))} for d, s in spans.items()}


def test_late_add_and_remove_change_only_their_span(spark):
    rng = random.Random(5)
    rows, model = [], {}
    for d in range(20):
        at = 0
        while at < 50:
            a = at + rng.randrange(0, 6)
            b = a + rng.randrange(1, 8)
            rows.append((d, "n", f"i{rng.randrange(2)}", day(a), None if b > 50 else day(b)))
            model.setdefault(d, []).append((a, 60 if b > 50 else b, rows[-1][2]))
            at = b if b <= 50 else 99
    spans = spark.createDataFrame(rows, "dir long, name string, item string, from_at timestamp_ntz, to_at timestamp_ntz")
    edit = spark.createDataFrame([(d, "n", "i0", day(10), day(30)) for d in range(20)], "dir long, name string, item string, at timestamp_ntz, until timestamp_ntz")
    num = lambda t: 60 if t is None else (t - DAY).days
    covered = lambda got, item=None: bits({d: [(num(r.from_at), num(r.to_at)) for r in got if r.dir == d and item in (None, r.item)] for d in range(20)})
    before = bits({d: [(a, b) for a, b, _ in s] for d, s in model.items()})
    added = T.fill_in(spans, edit)
    got = covered(added.collect())
    for d in range(20):
        assert got[d] == before[d] | set(range(10, 30))
    assert sorted(map(str, T.fill_in(added, edit).collect())) == sorted(map(str, added.collect()))  # played again: nothing
    late = edit.withColumn("seq", F.lit(1).cast("long"))
    assert all(r.holds for r in T.settle_proof(spans, added, late).collect())
    assert not all(r.holds for r in T.settle_proof(spans, spans, late).collect())
    cut = T.cut_out(spans, edit).collect()
    for d in range(20):
        own = {t for a, b, i in model[d] if i == "i0" for t in range(a, b)}
        other = {t for a, b, i in model[d] if i != "i0" for t in range(a, b)}
        assert covered(cut, "i0")[d] == own - set(range(10, 30)) and covered(cut, "i1")[d] == other


def test_many_late_changes_for_one_name(spark):
    """Settles against a table of days, each change played in its order: additions, removals, and both."""
    rng = random.Random(15)
    spans, changes, model = [], [], {}
    for d in range(60):
        at = 0
        while at < 40:
            a = at + rng.randrange(0, 8)
            b = a + rng.randrange(1, 8)
            spans.append((d, "n", f"i{rng.randrange(3)}", day(a), None if b > 40 else day(b)))
            model.setdefault(d, {}).update(dict.fromkeys(range(a, 60 if b > 40 else b), spans[-1][2]))
            at = b if b <= 40 else 99
        kinds = [[True], [False], [True, False]][d % 3]
        own = []
        for _ in range(rng.randrange(1, 7)):
            a = rng.randrange(45)
            own.append((d, "n", f"i{rng.randrange(3)}", a, a + rng.randrange(0, 15), rng.choice(kinds), len(changes) + len(own)))
        changes += [(*c[:3], day(c[3]), day(c[4]), *c[5:]) for c in own]
        for _, _, item, a, b, add, _ in sorted(own, key=lambda c: (c[3], c[6])):
            for t in range(a, b):
                if add:
                    model.setdefault(d, {}).setdefault(t, item)
                elif model.get(d, {}).get(t) == item:
                    del model[d][t]
    s = spark.createDataFrame(spans, "dir long, name string, item string, from_at timestamp_ntz, to_at timestamp_ntz")
    c = spark.createDataFrame(changes, "dir long, name string, item string, at timestamp_ntz, until timestamp_ntz, add boolean, seq long")
    got = {}
    for r in T.settle(s, c).collect():
        for t in range((r.from_at - DAY).days, 60 if r.to_at is None else (r.to_at - DAY).days):
            assert got.setdefault(r.dir, {}).setdefault(t, r.item) == r.item
    assert got == {d: m for d, m in model.items() if m}


def test_folder_states_against_sets(spark):
    rng = random.Random(16)
    rows = [(d, rng.randrange(5), f"i{rng.randrange(3)}", day(a := rng.randrange(20)), day(a + rng.randrange(1, 9)) if rng.random() < 0.8 else None) for d in range(8) for _ in range(12)]
    got = T.folder_states(spark.createDataFrame(rows, "dir long, name long, item string, from_at timestamp_ntz, to_at timestamp_ntz")).collect()
    for d in range(8):
        own = [r for r in rows if r[0] == d]
        want, was = [], None
        for t in sorted({t for r in own for t in r[3:] if t is not None}):
            now = sorted((r[1], r[2]) for r in own if r[3] <= t and (r[4] is None or r[4] > t))
            if now != was:
                want.append((t, len(now)))
            was = now
        assert [(r["at"], r.n) for r in sorted(got, key=lambda r: r["at"]) if r.dir == d] == want


def test_whole_file_claims_meet_everything_after_their_start(spark):
    rng = random.Random(17)
    spans = [(f, a, G.EOF if rng.random() < 0.1 else a + rng.choice([1, 3, 900, 1 << 20, 1 << 44])) for f in range(3) for a in (rng.choice([rng.randrange(50), rng.randrange(1 << 21), rng.randrange(1 << 45)]) for _ in range(60))]
    rows = [(f, i, i % 7, a, b, i % 3 == 0, i % 11 == 0, 10) for i, (f, a, b) in enumerate(spans)]
    df = spark.createDataFrame(rows, "file long, id long, holder long, start long, end long, shared boolean, escalation_only boolean, expires_at_ms long")
    end = lambda b: 1 << 63 if b == G.EOF else b
    meet = lambda x, y: x[0] == y[0] and x[3] < end(y[4]) and y[3] < end(x[4]) and x[2] != y[2]
    held = [r for r in rows if not r[6]]
    want = [(x[0], x[1], y[1]) for x in held for y in held if x[1] < y[1] and meet(x, y) and not (x[5] and y[5])]
    assert sorted(map(tuple, G.conflicts(df, 0).collect())) == sorted(want)
    writes = df.select("file", "id", "holder", "start", "end")
    assert sorted(map(tuple, G.blocked_writes(writes, df, 0).collect())) == sorted({(x[0], x[1]) for x in rows for y in held if meet(x, y)})
    assert G.taken([(100, 200, False)], 0, G.TOP, False) == [(0, G.TOP, False)]


def test_undo_restores_what_began_a_batch(spark):
    rows = [("e-a", "a", "/a", 1, "e-a", "p"), ("e-b", "b", "/a/b", 1, "e-a", "p"), ("e-c", "c", "/c", 0, None, "p"), ("e-d", "d", "/d", 2, "e-d", "q"), ("e-e", "e", "/c", 3, None, "p")]
    t = spark.createDataFrame(rows, "entry_id string, item string, path string, deleted_at long, batch string, pass string")
    assert [r.entry_id for r in sorted(X.undo_roots(t, "p").collect(), key=lambda r: r.pos)] == ["e-c", "e-a", "e-e"]
    got = {r.entry_id: r.outcome for r in X.undone(t, "p", spark.createDataFrame([("/a/b",)], "path string")).collect()}
    assert got == {"e-a": "restored", "e-b": "taken", "e-c": "older", "e-e": "restored"}


def test_walks_go_all_the_way_down_and_refuse_cycles(spark):
    deep = spark.createDataFrame([("" if i == 0 else f"d{i - 1}", f"d{i}", "x", "dir") for i in range(230)], "parent string, id string, name string, type string")
    assert tree.walk(deep.repartition(1)).agg(F.max("depth")).first()[0] == 230
    loop = spark.createDataFrame([("", "a", "a", "dir"), ("a", "b", "b", "dir"), ("b", "a", "a", "dir")], "parent string, id string, name string, type string")
    with pytest.raises(Exception, match="below itself"):
        tree.walk(loop).collect()


def test_signals_over_three_bursts(spark, tmp_path):
    for n, keys in enumerate((["a", "a", "b"], ["a", "c"], ["b", "b"])):
        spark.createDataFrame([(k, 10 * n + i) for i, k in enumerate(keys)], "key string, cursor long").coalesce(1).write.parquet(f"{tmp_path}/in/b{n}")
    read = lambda: spark.readStream.schema("key string, cursor long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    got = {}
    for r in feed.coalesced(read(), "burst-test").collect():
        got.setdefault(r.burst, []).append(r.key)
    assert sorted(map(sorted, got.values())) == [["a", "b"], ["a", "c"], ["b"]]
    out = [tuple(r) for r in feed.fanned_out(read(), {"all": None, "slow": 1}, "fan-test").collect()]
    assert sum(r == "all" for r, _ in out) == 7 and sorted(k for r, k in out if r == "slow") == ["a", "a", "b"]


def test_debounced_marks_over_three_bursts(spark, tmp_path):
    rng = random.Random(19)
    marks = sorted((rng.randrange(20_000), rng.choice("ab")) for _ in range(90))
    for n in range(3):
        spark.createDataFrame([(k, t) for t, k in marks[30 * n : 30 * n + 30]], "key string, at long").coalesce(1).write.parquet(f"{tmp_path}/in/b{n}")
    stream = spark.readStream.schema("key string, at long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    got = {}
    for r in feed.drained(feed.debounced(stream, 1000), "debounce-test").collect():
        got.setdefault(r.key, []).append(r.sent)
    for key in "ab":
        sent, own = sorted(got[key]), [t for t, k in marks if k == key]
        assert sent[0] == own[0] and all(b - a >= 1000 for a, b in zip(sent, sent[1:]))
        assert all(any(t <= s <= t + 1000 for s in sent) for t in own)


def test_renames_become_moves_and_edits_below_them_stay_edits(spark):
    kind = "key string, path string, dir boolean, size long, mtime long, id string, version string, acl string, created long, remote_id string"
    row = lambda key, n, size=1, dir=False: (key, key, dir, size, 0, f"l{n}", f"v{size}", "", 0, f"r{n}")
    df = lambda *rows: spark.createDataFrame(list(rows), kind)
    base = df(row("a", 1, dir=True), row("a/x", 2), row("a/sub", 3, dir=True), row("a/sub/y", 4), row("f", 5), row("g", 6))
    local = df(row("b", 1, dir=True), row("b/x", 2, size=9), row("b/sub", 3, dir=True), row("b/sub/z", 4), row("f", 5), row("g", 6))
    remote = df(row("a", 1, dir=True), row("a/x", 2), row("a/sub", 3, dir=True), row("a/sub/y", 4), row("f", 5), row("h", 6))
    got = sorted((r.kind, r.key, r.note) for r in reconcile.plan_with_moves(base, local, remote, True).collect())
    assert got == [("move-local", "h", "g"), ("move-remote", "b", "a"), ("move-remote", "b/sub/z", "a/sub/y"), ("upload", "b/x", "")]


def test_merge_own_equals_bytes():
    rng = random.Random(6)
    for _ in range(300):
        held, byte = [], {}
        for _ in range(rng.randrange(8)):
            a, shared = rng.randrange(40), rng.random() < 0.5
            b = a + rng.randrange(1, 12)
            held = G.taken(held, a, b, shared)
            byte.update(dict.fromkeys(range(a, b), shared))
        assert {t: s for a, b, s in held for t in range(a, b)} == byte
        assert sum(b - a for a, b, _ in held) == len(byte)


def test_range_budget(spark):
    rng = random.Random(7)
    rows = [(f, a, a + rng.randrange(1, 9)) for f in range(5) for a in rng.sample(range(400), 30)]
    got = G.budgeted(spark.createDataFrame(rows, "file long, start long, end long"), 6).collect()
    for f in range(5):
        spans = []
        for _, a, b in sorted(r for r in rows if r[0] == f):
            if spans and a <= spans[-1][1]:
                spans[-1] = (spans[-1][0], max(b, spans[-1][1]))
            else:
                spans.append((a, b))
        assert sorted((r.start, r.end) for r in got if r.file == f) == G.within_budget(spans, 6)


def test_conditional_writes(spark):
    rng = random.Random(8)
    log = [(rng.randrange(5), i, rng.choice([None, "", "a", "b"]), rng.choice("ab")) for i in range(200)]
    got = {r.seq: r.accepted for r in M.conditional_writes(spark.createDataFrame(log, "key long, seq long, expect string, version string")).collect()}
    now = dict.fromkeys(range(5), "")
    for key, seq, expect, version in log:
        ok = expect is None or expect == now[key]
        assert got[seq] == ok
        now[key] = version if ok else now[key]


def test_late_changes_over_several_batches(spark, tmp_path):
    rng = random.Random(9)
    rows = [(rng.randrange(4), i, rng.randrange(1000)) for i in range(120)]
    for n in range(3):
        spark.createDataFrame(rows[n * 40 : n * 40 + 40], "folder long, seq long, at long").coalesce(1).write.parquet(f"{tmp_path}/in/b{n}")
    stream = spark.readStream.schema("folder long, seq long, at long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    got = sorted(map(tuple, feed.drained(feed.late_changes(stream), "late-test").collect()))
    newest, want = {}, []
    for folder, seq, at in rows:
        if folder in newest and at < newest[folder]:
            want.append((folder, seq, at, newest[folder]))
        else:
            newest[folder] = at
    assert got == sorted(want)


def test_records_there_and_back():
    block = {"kind": 0, "entries": [{"name": "é", "uuid": "u", "type": 2}, {"name": "b", "uuid": "v", "type": 0}], "children": [], "high_key": "z", "right": "", "layout": 1}
    assert records.checked("block", records.encode(records.RECORDS["block"], block)) == block
    stub = {"layout": 1, "key": "k", "version_id": "v", "size": -5, "sha256": b"\0\1"}
    assert records.checked("stub", records.encode(records.RECORDS["stub"], stub)) == stub
    assert records.checked("block", b"")["entries"] == [] and records.checked("block", None) is None
    with pytest.raises(ValueError):
        records.checked("stub", records.encode(records.RECORDS["stub"], stub | {"layout": 2}))
    with pytest.raises(ValueError):
        records.checked("stub", records.encode(records.RECORDS["stub"], stub)[:-1])


def test_descriptors():
    sd = R.parse_sddl("O:BAG:S-1-5-21-1D:PAI(A;OICI;FA;;;WD)(XA;;FX;;;S-1-1-0;(@User.a==(1)))(OA;;CR;11-22;33-44;BU)S:(AU;SA;FA;;;WD)")
    assert sd["owner"] == "BA" and sd["group"] == "S-1-5-21-1" and sd["dacl_flags"] == "PAI" and [a["flags"] for a in sd["aces"]] == [3, 0, 0]
    assert sd["aces"][1]["condition"] == "(@User.a==(1))" and (sd["aces"][2]["object"], sd["aces"][2]["inherited_object"]) == ("11-22", "33-44")
    assert R.print_sddl(sd) == "O:BAG:S-1-5-21-1D:PAI(A;OICI;FA;;;WD)(XA;;FX;;;S-1-1-0;(@User.a==(1)))(OA;;CR;11-22;33-44;BU)"
    assert R.parse_sddl("O:BA")["has_dacl"] is False and R.parse_sddl("D:P")["aces"] == [] and R.parse_sddl("D:P")["has_dacl"]
    for bad in ("D:(A;QQ;FA;;;WD)", "nonsense", None, "D:(A;;FA;;;WD", "D:A;;FA;;;WD)", "(A;;FA;;;WD)", "D:(A;;FA)", "D:(A;;ZZ;;;WD)"):
        assert R.parse_sddl(bad) is None


#: What Windows documents for an entry of a directory, worked out by hand: flags, sid; the entries of a new file, of a new directory.
INHERITED = [
    (0, "WD", [], []), (1, "WD", [(16, "WD")], [(25, "WD")]), (2, "WD", [], [(18, "WD")]), (3, "WD", [(16, "WD")], [(19, "WD")]), (4, "WD", [], []), (5, "WD", [(16, "WD")], []), (6, "WD", [], [(16, "WD")]), (7, "WD", [(16, "WD")], [(16, "WD")]),
    (8, "WD", [], []), (9, "WD", [(16, "WD")], [(25, "WD")]), (11, "WD", [(16, "WD")], [(19, "WD")]), (14, "WD", [], [(16, "WD")]),
    (1, "CO", [(16, "own")], [(25, "CO")]), (2, "CO", [], [(16, "own"), (26, "CO")]), (3, "CO", [(16, "own")], [(16, "own"), (27, "CO")]), (7, "CO", [(16, "own")], [(16, "own")]), (11, "CG", [(16, "grp")], [(16, "grp"), (27, "CG")]), (0, "CG", [], []),
]


def test_inheritance(spark):
    rows = [(i, d, [("A", f, 5, s, "", "", "")]) for i, (f, s, _, _) in enumerate(INHERITED) for d in (False, True)]
    df = spark.createDataFrame(rows, f"i int, d boolean, aces array<{R.ACE_TYPE}>")
    for r in df.select("i", "d", R.inherited(F.col("aces"), F.col("d"), F.lit("own"), F.lit("grp")).alias("k")).collect():
        want = [("A", f, 5, s) for f, s in INHERITED[r.i][2 + r.d]] or [("A", 0, R.ALL_ACCESS, "own")]
        assert [tuple(x)[:4] for x in r.k] == want, (INHERITED[r.i], r.d)


def test_inodes_listings_and_diffs(spark, tmp_path):
    import xxhash

    from tidemark.plans import registry

    keys = ["", "a", "é" * 50]
    got = spark.createDataFrame([(k,) for k in keys], "k string").select(V.inode()(F.col("k")).alias("i")).collect()
    assert [r.i % (1 << 64) for r in got] == [xxhash.xxh64_intdigest(k.encode()) or 1 for k in keys]
    (tmp_path / "x.bin").write_bytes(b"12345")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "y").write_bytes(b"")
    files = {r.path: r for r in registry.queries()["s22_folder_listing"](spark, str(tmp_path)).collect()}
    assert {k: (r["size"], r["dir"]) for k, r in files.items()} == {"x.bin": (5, False), "sub": (0, True), "sub/y": (0, False)}
    assert abs((files["x.bin"].mtime - datetime.datetime.fromtimestamp((tmp_path / "x.bin").stat().st_mtime, datetime.UTC).replace(tzinfo=None)).total_seconds()) < 1
    diff = spark.createDataFrame([("a\nb\nc\n", "a\nx\nc\n"), ("same", "same")], "o string, n string").select(V.unified_diff()(F.col("o"), F.col("n")).alias("d")).collect()
    assert "-b" in diff[0].d and "+x" in diff[0].d and " a" in diff[0].d and not diff[1].d


def test_names(spark):
    df = spark.createDataFrame([("con.txt",), ("é:x",), ("aß",), ("x ",), ("ok",), ("",), ("a b.",)], "n string")
    got = {r.n: r for r in df.select("n", N.reserved(F.col("n")).alias("r"), N.fold_key(F.col("n")).alias("f"), N.windows_stored(N.windows_shown(F.col("n"))).alias("b")).collect()}
    assert [got[n].r for n in ("con.txt", "é:x", "aß", "x ", "ok", "", "a b.")] == [True, True, False, True, False, True, True]
    assert got["aß"].f == "Aß" and all(r.b == r.n for r in got.values())


def test_part_size_and_moments(spark):
    df = spark.createDataFrame([(1,), (83886080000,), (83886080001,), (10**15,)], "s long").select(V.part_size(F.col("s")).alias("p"))
    assert [r.p for r in df.collect()] == [8 << 20, 8 << 20, 16 << 20, 5 << 30]
    df = spark.createDataFrame([("2024-02-28",), ("2024-02-28 10:11",), ("no",)], "t string").select(V.as_of_moment(F.col("t")).alias("m"))
    assert [r.m for r in df.collect()] == [datetime.datetime(2024, 2, 28, 23, 59, 59, 999999), datetime.datetime(2024, 2, 28, 10, 11), None]


def test_commands_are_registered():
    from tidemark import commands
    from tidemark.plans import registry

    assert set(commands.COMMANDS.values()) <= set(registry.queries())
    with pytest.raises(KeyError):
        commands.command("fs fly")


def test_commands_take_arguments(spark):
    from tidemark import commands

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("needs the driver's tables")
    got = [json.loads(line) for line in commands.run(spark, ["fs", "list", "--data", sf, "--where", "pos > 0", "--columns", "pos,name", "--limit", "2"])]
    assert len(got) == 2 and all(set(g) == {"pos", "name"} and g["pos"] > 0 for g in got)


def test_unknown_layouts_are_refused(spark):
    df = spark.createDataFrame([(1, 5), (2, 6)], "layout int, x int")
    assert df.where("layout = 1").select(V.gated(F.col("layout"), F.col("x"))).first()[0] == 5
    with pytest.raises(Exception, match="unknown layout 2"):
        df.select(V.gated(F.col("layout"), F.col("x"))).collect()


def test_metadata_records_with_maps_and_a_record_within():
    spec = records.RECORDS["metadata"]
    full = {"mode": 420, "xattrs": [{"key": "a", "value": b"\0x"}, {"key": "", "value": b""}], "windows": {"sddl": "O:BA", "attributes": 32, "reparse": b"", "dir_symlink": True}, "checksums": [{"key": "v", "value": {"md5": b"1", "sha256": b"2"}}], "layout": 1}
    got = records.checked("metadata", records.encode(spec, full))
    assert {k: got[k] for k in full} == full and got["refs"] == [] and records.checked("metadata", b"")["windows"] is None


def test_a_cursor_goes_on_where_it_stopped(spark):
    log = spark.createDataFrame([(f"k{i}", i) for i in range(10)], "key string, cursor long")
    cursor = feed.Cursor(spark, "cursor-test")
    assert [feed.since(log.where(F.col("cursor") < n), cursor).count() for n in (0, 4, 4, 10)] == [0, 4, 0, 6] and cursor.get() == 9
