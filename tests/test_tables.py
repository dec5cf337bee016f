"""Bucketed tables and keyset pages."""

from __future__ import annotations

import os
from datetime import datetime, timedelta

import pytest

from dqspark.operators import alerts, history
from dqspark.sources.buckets import BucketedTable


def keep_newest(held, fresh):
    """Fresh rows win over held ones of the same key."""
    return held.join(fresh.select("k"), "k", "left_anti").unionByName(fresh)


def files(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.startswith("part-")}


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "t")
    table = BucketedTable(spark, path, ["k"], 16)
    assert table.read() is None and table.update(spark.createDataFrame([], "k string, v long"), keep_newest) == []
    first = spark.createDataFrame([(f"k{i}", i) for i in range(300)] + [(None, -1)], "k string, v long")
    assert len(table.update(first, keep_newest)) == 16
    before = files(path)
    changed = table.update(spark.createDataFrame([("k7", 700), ("k8", 8), ("new", 1)], "k string, v long"), keep_newest)
    after = files(path)
    assert 1 <= len(changed) <= 2  # k8 is what it was
    gone, come = set(before) - set(after), set(after) - set(before)
    assert len(gone) == len(come) == len(changed) and all(before[f] == after[f] for f in set(before) & set(after))
    rows = {r["k"]: r["v"] for r in table.read().collect()}
    assert len(rows) == 302 and rows["k7"] == 700 and rows["k8"] == 8 and rows["new"] == 1 and rows[None] == -1
    assert BucketedTable(spark, path, ["k"], 16).update(spark.createDataFrame([("k7", 700), ("new", 1)], "k string, v long"), keep_newest) == []
    assert files(path) == after
    with pytest.raises(ValueError):
        BucketedTable(spark, path, ["k"], 8)


def test_alerts_kept_in_buckets_equal_a_full_upsert(spark, tmp_path):
    made = lambda ids, severity: spark.createDataFrame(
        [(i % 2 + 1, f"run:{i}", "run", severity, "t", f"d{i}", "ds", f"a{i}", None, datetime(2024, 1, 1) + timedelta(hours=i)) for i in ids],
        "workspace_id long, fingerprint string, alert_type string, severity string, title string, description string, dataset_name string, audit_id string, rule_id long, detected_at timestamp",
    )
    kinds = "workspace_id long, fingerprint string, alert_type string, severity string, status string, title string, description string, dataset_name string, audit_id string, rule_id long, detected_at timestamp, updated_at timestamp"
    empty = spark.createDataFrame([], kinds)
    table = BucketedTable(spark, str(tmp_path / "alerts"), ["workspace_id", "fingerprint"], 8)
    whole = empty
    for ids, severity, day in ((range(40), "low", "2024-02-01"), (range(30, 60), "high", "2024-02-02")):
        found = made(ids, severity)
        whole = alerts.upsert(whole, found, day)
        table.update(found, lambda held, fresh, day=day: alerts.upsert(held if held.columns == whole.columns else empty, fresh, day))
    rows = lambda df: sorted(map(str, (tuple(r[c] for c in whole.columns) for r in df.collect())))
    assert rows(table.read()) == rows(whole) and table.read().count() == 60


def test_pages_by_key_equal_pages_by_offset(spark):
    rows = [(i, None if i % 7 == 0 else i % 5, None if i % 11 == 0 else datetime(2024, 1, 1 + i % 9), f"f'{i}") for i in range(60)]
    df = spark.createDataFrame(rows, "id long, score int, at timestamp, fingerprint string").repartition(3)
    for order in ([("score", True), ("id", False)], [("at", False), ("score", True), ("fingerprint", True)], [("at", True), ("id", True)]):
        whole = df.orderBy(*[df[c].desc_nulls_last() if falls else df[c].asc_nulls_first() for c, falls in order]).collect()
        got, after = [], None
        while True:
            page = history.page_after(df, order, 7, after)
            assert "TakeOrderedAndProject" in page._jdf.queryExecution().executedPlan().toString()
            found = page.collect()
            if not found:
                break
            got, after = got + found, found[-1].asDict()
        assert got == whole
