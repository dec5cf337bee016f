"""Example queries against DuckDB on the smallest tables.  DQ_ALL=1 runs every query."""

from __future__ import annotations

import os

import __spark_entry__ as entry
import check
import duckdb
import pytest
from workload import load

SF = "/root/testdata/sf0.001"
SOME = [
    "rules_summary", "rule_violations", "profile_columns", "profile_by_slice", "top_values", "dataset_profile", "issues_customer",
    "privacy_scan", "score_dimensions", "version_lineage", "compare_issues", "drift_events", "contract_validation", "remediate_mask",
    "remediate_dedupe", "lifecycle_state", "alerts_upsert", "report_lifecycle", "report_evidence", "window_failures",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in check.TABLES.split():
        connection.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", list(load()[0]) if os.environ.get("DQ_ALL") else SOME)
def test_equals_duckdb(spark, db, name):
    df = entry.queries()[name](spark, SF)
    mine = check.rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = db.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert mine == check.rows(columns, cursor.fetchall())


def test_every_query_has_sql():
    queries, oracles = load()
    assert set(queries) == set(oracles) and set(oracles) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
