"""Queries over whole tables against brute force: no prefix, fold of ids or limit of depth."""

import os

import pytest

from tidemark.functions import names as N
from tidemark.plans import q_catalog, registry
from tidemark.sources.adapters import claims

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def rows(spark, name):
    return [tuple(r) for r in registry.queries()[name](spark, SF).collect()]


def test_whole_texts_are_folded(spark):
    low, up = N._upcase_pairs()
    fold = dict(zip(map(ord, low), up, strict=True))
    texts = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = [(d, None if t is None else t.translate(fold).encode("utf-32-be").hex().upper()) for d, t in texts]
    assert max(len(w or "") for _, w in want) > 8 * 12
    assert sorted(rows(spark, "f04_fold_key")) == sorted(want)


def test_blocks_of_all_roots_are_reached(spark):
    links = {}
    for r in spark.read.parquet(f"{SF}/events.parquet").select("user_id", "event_id").collect():
        if r.event_id > r.user_id:
            links.setdefault(r.user_id, set()).add(r.event_id)
    want = set()
    for root in links:
        todo = list(links[root])
        while todo:
            if (root, b := todo.pop()) not in want:
                want.add((root, b))
                todo += links.get(b, ())
    got = rows(spark, "t15_block_closure")
    assert sorted(got) == sorted(want) and len({r for r, _ in got}) > 5


def test_pages_hold_entries_of_all_depths(spark):
    page = rows(spark, "t02_list_page")
    orders = spark.read.parquet(f"{SF}/orders.parquet").where("o_custkey = 5").count()
    assert len(page) == 40 and [p for _, _, p in page] == list(range(1, 41))
    assert orders > 0 and all(i.startswith("o") for i, _, _ in page[: min(orders, 40)])


def test_every_claim_is_tested_as_a_write(spark):
    sf = SF.replace("0.001", "0.01")  # the smallest tables have about one claim for a file
    files = {}
    ends = {}
    for c in claims(spark, sf).collect():
        files.setdefault(c.file, []).append(c)
        ends[c.id] = c.end if c.end > 0 else 1 << 63
    holds = lambda c: not c.escalation_only and c.expires_at_ms > q_catalog.NOW_MS
    want = [(w.file, w.id) for cs in files.values() for w in cs if any(holds(c) and c.holder != w.holder and c.start < ends[w.id] and w.start < ends[c.id] for c in cs)]
    assert any(i % 5 for _, i in want)
    got = registry.queries()["j17_write_conflicts"](spark, sf).collect()
    assert sorted(map(tuple, got)) == sorted(want)
