from __future__ import annotations

import hashlib
import random

from dqspark import Options, Rule, audit
from dqspark.operators import alerts, contracts, drift, lifecycle, profile, remediate, reports, versions
from dqspark.plans import clean
from dqspark.sources.store import AuditStore, export_csv

PROFILE = "dataset string, version int, column string, inferred_type string, missing_rate double, unique_count long"


def test_lineage_explicit_legacy_and_mixed(spark):
    rows = [
        ("d", "a1", 1, "dataset_import", 1, "f1"), ("d", "a2", 2, "rerun", 1, "f1"), ("d", "a3", 3, "version_import", 2, "f2"),
        ("d", "a4", 4, "version_import", 2, "f3"), ("d", "a5", 5, None, None, "f3"), ("d", "a6", 6, None, None, "f4"),
        ("d", "a7", 7, None, None, None), ("l", "b1", 1, None, None, None), ("l", "b2", 2, None, None, "x"), ("l", "b3", 3, None, None, "x"),
        ("l", "b4", 4, None, None, "y"), ("l", "b5", 5, "version_import", 3, "z"), ("l", "b6", 6, None, None, "w"),
    ]
    audits = spark.createDataFrame(rows, "dataset_name string, audit_id string, t int, audit_kind string, dataset_version int, source string")
    audits = audits.selectExpr("*", "timestamp_seconds(t) as created_at")
    found = {(r["dataset_name"], r["version"]): r["audit_id"] for r in versions.lineage(audits).collect()}
    # b4 is version 3, so the explicit version 3 of b5 is taken already; b6 follows as 4.
    assert found == {("d", 1): "a1", ("d", 2): "a3", ("d", 3): "a6", ("l", 1): "b1", ("l", 2): "b2", ("l", 3): "b4", ("l", 4): "b6"}
    assert {r[0]: r[1] for r in versions.current_version(audits).collect()} == {"d": 3, "l": 4}


def test_lineage_equals_a_loop(spark):
    rng = random.Random(5)
    kinds = {"legacy": [None, "rerun", "audit"], "explicit": ["version_import", "dataset_import", "rerun"], "mixed": [None, "version_import", "rerun"]}
    rows, wanted = [], {}
    for d in range(60):
        choices, now, last, versions_seen = kinds[rng.choice(list(kinds))], 0, None, {}
        for t in range(rng.randint(1, 12)):
            now += rng.choice([1000, 50000, 200000])
            kind, source = rng.choice(choices), rng.choice([None, "x", "y", "z"])
            explicit = rng.randint(1, 5) if kind in ("version_import", "dataset_import") else None
            rows.append((f"d{d}", f"a{d}-{t:02d}", now, kind, explicit, source))
            if explicit:
                versions_seen.setdefault(explicit, rows[-1][1])
                last = source or last
            elif kind != "rerun" and (not versions_seen or (source and source != last)):
                versions_seen[max(versions_seen, default=0) + 1] = rows[-1][1]
                last = source
        wanted |= {(f"d{d}", place): versions_seen[n] for place, n in enumerate(sorted(versions_seen), 1)}
    audits = spark.createDataFrame(rows, "dataset_name string, audit_id string, t int, audit_kind string, dataset_version int, source string")
    found = versions.lineage(audits.selectExpr("*", "timestamp_seconds(t) as created_at")).collect()
    assert {(r["dataset_name"], r["version"]): r["audit_id"] for r in found} == wanted


def test_drift_status(spark):
    rows = []
    for version, columns in ((1, {"a": "text", "b": "numeric"}), (2, {"a": "numeric", "b": "numeric", "c": "text"}),
                             (3, {"a": "text", "b": "numeric", "c": "text"}), (4, {"a": "text", "c": "text"})):
        rows += [("d", version, c, kind, 0.0 if version < 3 or c != "c" else 0.5, 10) for c, kind in columns.items()]
    events = drift.drift_events(spark.createDataFrame(rows, PROFILE))
    got = {(r["candidate"], r["drift_type"], r["subject"]): (r["impact_score"], r["severity"], r["status"]) for r in events.collect()}
    assert got == {
        (2, "column_added", "c"): (54, "medium", "resolved"), (2, "type_changed", "a"): (78, "high", "persistent"),
        (3, "type_changed", "a"): (78, "high", "resolved"), (3, "nullability_changed", "c"): (75, "high", "resolved"),
        (4, "column_removed", "b"): (70, "high", "new"),
    }
    assert drift.drift_summary(events).first()["total"] == 5


def test_contract_prefers_rules(spark, customers):
    found = profile.profile_columns(customers, options=Options(dtypes="csv"))
    made = [Rule(1, "s", "allowed_values", "status", parameters={"values": ["Active", "Inactive"]}), Rule(2, "m", "numeric_range", "monthly_spend", parameters={"min": 0}),
            Rule(3, "r", "required", "customer_id"), Rule(4, "e", "email", "email"), Rule(5, "gone", "required", "nope")]
    from dqspark.operators.rules import rules_table

    row = contracts.contract_from_rules(rules_table(spark, made), found, []).first()
    assert row["allowed_values"]["status"] == ["Active", "Inactive"] and row["required_columns"] == ["customer_id"]
    assert row["numeric_ranges"]["monthly_spend"]["min"] == 0 and row["numeric_ranges"]["monthly_spend"]["max"] is None
    assert row["email_columns"] == ["email"] and len(row["assigned_rules"]) == 5
    assert [r.rule_type for r in contracts.to_rules(row)] == ["email"]
    observed = contracts.contract_from_profile(found, profile.top_values(customers, 21)).first()
    assert "email" not in observed["required_columns"] and sorted(observed["allowed_values"]["status"]) == ["ACTIVE", "Active", "Inactive", "active"]
    issues = audit(customers, expectations=contracts.to_expectations(observed), options=Options(dtypes="csv")).issues
    assert issues.where("title like 'Configured%' or title like 'Values outside%' or title like 'Unexpected%'").count() == 0


def test_remediation(spark, customers, tmp_path):
    source = audit(customers, options=Options(dtypes="csv"))
    wanted = {r["category"]: r["id"] for r in source.issues.where("title in ('Duplicate rows detected', 'Missing values in email', 'Inconsistent category casing in status', 'Potential PII columns detected')").collect()}
    done = clean.preview(customers, source, list(wanted.values()), options=Options(dtypes="csv"), order_by=["customer_id"])
    result = done.remediation.result
    assert result.count() == 9 and result.where("email is null").count() == 0
    assert result.where(r"not email rlike '^user_[0-9a-f]{10}@masked[.]example$'").count() == 0
    assert result.where(r"not phone rlike '^[+]254[0-9]{9}$'").count() == 0
    assert sorted(r[0] for r in result.select("status").distinct().collect()) == ["Active", "Inactive"]
    row = done.comparison(source).first()
    assert (row["rows_before"], row["rows_after"]) == (10, 9) and row["projected_score_delta"] == row["projected_score"] - row["score_before"]
    again = remediate.standardize(result, ["status"])
    assert again.exceptAll(result).count() == 0
    store = AuditStore(spark, str(tmp_path / "store"))
    clean.apply(store, "customers", 1, done, "2025-06-01", "a1")
    assert store.read_version("cleaned_customers", 1).count() == 9 and store.audit("a1").first()["dataset_name"] == "cleaned_customers"


def test_masking_is_stable_and_keeps_distinct_values(customers):
    masked = remediate.mask(customers, ["email", "phone", "customer_id"])
    for column in ("email", "phone", "customer_id"):
        assert masked.select(column).distinct().count() == customers.select(column).distinct().count()
    assert masked.exceptAll(remediate.mask(customers, ["email", "phone", "customer_id"])).count() == 0
    assert masked.exceptAll(remediate.mask(customers, ["email", "phone", "customer_id"], salt="s")).count() == 10


def test_collisions_hash_each_different_value_once(spark):
    """Values are told apart before they are hashed: there is no digest below the inner aggregate."""
    texts = ["+1 555", " +1 555\t", "+1 556", "a@b.cd", "é\xa0", "", "  ", None, *[f"+{i}" for i in range(300)]]
    df = spark.createDataFrame([(t,) for t in texts], "phone string").selectExpr("phone", "phone as date_of_birth")
    plan = remediate.mask_collisions(df, "phone")._jdf.queryExecution().optimizedPlan().toString()
    assert "sha2" in plan and "sha2" not in plan[plan.rindex("Aggregate"):].split("\n", 1)[1]
    # Blanks are no values; all dates of birth share one stand-in, but an address keeps its own.
    assert [tuple(r) for r in remediate.mask_collisions(df, "date_of_birth").collect()] == [("1970-01-01", 303)]
    assert remediate.mask_collisions(df, "phone").count() == 0
    for r in remediate.mask(df.where("phone like '+%'").selectExpr("phone as old", "phone"), ["phone"]).collect():
        number = int(hashlib.sha256(r["old"].encode()).hexdigest()[:10], 16)
        assert r["phone"] == f"+254{number % 10**9:09d}"


def test_dedupe_keeps_null_keys(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None)], "i int, k string")
    assert sorted(r["i"] for r in remediate.deduplicate(df, ["k"], ["i"]).collect()) == [1, 3, 4]
    assert sorted(r["i"] for r in remediate.deduplicate(df, ["k"], ["i"], collapse_null_keys=True).collect()) == [1, 3]


def test_lifecycle(spark):
    issues = spark.sql(
        "select 'a' as audit_id, i.*, cast(null as string) as resolution_note, cast(null as string) as resolution_evidence, cast(null as string) as owner, 5L as affected_rows, 0.5D as affected_rate"
        " from values ('1', 'validity', 'high', 'open', 'Fix it'), ('2', 'privacy', 'high', 'open', 'Mask it') as i(id, category, severity, status, recommendation)"
    )
    changes = spark.sql(
        "select *, 'Ann' as actor_name, timestamp_seconds(n) as changed_at, cast(n as string) as change_id, 'a' as audit_id, cast(null as string) as owner, cast(null as string) as severity from values"
        " (1, '1', 'update', 'resolved', null, null), (2, '1', 'apply', null, null, null), (3, '1', 'apply', null, null, null), (4, '2', 'apply', null, null, null),"
        " (5, '2', 'update', null, 'done', 'ticket'), (6, '2', 'apply', null, null, null), (7, '9', 'apply', null, null, null)"
        " as c(n, issue_id, kind, status, resolution_note, resolution_evidence)"
    )
    judged = lifecycle.judge_changes(issues, changes)
    assert {r["change_id"] for r in lifecycle.rejected_changes(judged).collect()} == {"1", "3", "4", "7"}
    state = {r["id"]: r for r in lifecycle.current_issues(issues, judged).collect()}
    assert state["1"]["status"] == "fixed" and state["1"]["affected_rows"] == 0 and state["2"]["resolution_note"] == "done"


def fold(issue, changes):
    """Activities and end state of one issue, change by change, as a plain program would."""
    state, log = dict(issue), []
    fields = ("status", "owner", "severity", "resolution_note", "resolution_evidence")
    for c in changes:
        if c["kind"] == "apply":
            if state["status"] == "fixed" or state["category"] == "privacy" and not (state["resolution_note"] and state["resolution_evidence"]):
                continue
            state.update(status="fixed", owner=c["actor_name"])
            if state["category"] != "privacy":
                state["resolution_note"] = f"Applied recommendation: {state['recommendation']}"
            log.append(("recommendation_applied", "status", "open", "fixed"))
            continue
        given = {f: c[f] for f in fields if c[f] is not None}
        if not given or given.get("status") in ("resolved", "fixed") and not (given.get("resolution_note") or state["resolution_note"]):
            continue
        for f, value in given.items():
            if state[f] != value:
                log.append(("field_updated", f, state[f], value))
                state[f] = value
        if state["status"] == "reopened":
            state["status"] = "open"
            log.append(("reopened", "status", None, "open"))
    return log, [state[f] for f in fields]


def test_lifecycle_equals_a_plain_fold(spark):
    import random

    draw = random.Random(11)
    issues = [
        {"audit_id": "a", "id": str(i), "category": draw.choice(["privacy", "validity"]), "severity": "high", "status": draw.choice(["open", "reopened", "fixed", "triaged"]),
         "recommendation": "r", "resolution_note": None, "resolution_evidence": None, "owner": draw.choice([None, "A"]), "affected_rows": 3, "affected_rate": 0.5}
        for i in range(60)
    ]
    maybe = lambda *options: draw.choice([None, None, *options])
    changes = [
        {"change_id": f"{n:04}", "audit_id": "a", "issue_id": str(draw.randrange(60)), "kind": draw.choice(["update", "update", "update", "apply"]),
         "status": maybe("resolved", "fixed", "reopened", "open"), "owner": maybe("A", "B"), "severity": maybe("low", "high"), "resolution_note": maybe("n1", "n2"),
         "resolution_evidence": maybe("e1", "e2"), "actor_name": draw.choice(["Ann", "Bob"]), "changed_at": n}
        for n in range(700)
    ]
    for c in changes:
        if c["kind"] == "apply":
            c.update(status=None, owner=None, severity=None, resolution_note=None, resolution_evidence=None)
    text = "status string, owner string, severity string, resolution_note string, resolution_evidence string"
    left = spark.createDataFrame([tuple(i.values()) for i in issues], "audit_id string, id string, category string, severity string, status string, recommendation string, resolution_note string, resolution_evidence string, owner string, affected_rows long, affected_rate double")
    right = spark.createDataFrame([tuple(c.values()) for c in changes], f"change_id string, audit_id string, issue_id string, kind string, {text}, actor_name string, n long").selectExpr("* except (n)", "timestamp_seconds(n) as changed_at")
    judged = lifecycle.judge_changes(left, right)
    order = lambda row: tuple(str(x) for x in row)
    seen = sorted(((r["issue_id"], r["action"], r["field_name"], r["previous_value"], r["new_value"]) for r in lifecycle.change_activities(judged).collect()), key=order)
    state = {r["id"]: [r[f] for f in ("status", "owner", "severity", "resolution_note", "resolution_evidence")] for r in lifecycle.current_issues(left, judged).collect()}
    want = []
    for issue in issues:
        log, end = fold(issue, [c for c in changes if c["issue_id"] == issue["id"]])
        want += [(issue["id"], *row) for row in log]
        assert state[issue["id"]] == end
    assert seen == sorted(want, key=order)


def test_grave_issues_are_cleaned_first(spark):
    rows = [(str(i), "x") for i in range(96)] + [(None, "x")] * 3 + [("5", "x")]
    df = spark.createDataFrame(rows, "customer_id string, note string")
    found = spark.sql(
        "select id, category, severity, id as title, array('customer_id') as columns from values ('DQ-1000', 'validity', 'high'), ('DQ-001', 'completeness', 'low'), ('DQ-999', 'uniqueness', 'high') as i(id, category, severity)"
    )
    from dqspark.operators.detect import in_severity_order

    plan = remediate.plan_actions(in_severity_order(found)).collect()
    assert [r["issue_id"] for r in plan] == ["DQ-999", "DQ-1000", "DQ-001"]
    done = remediate.remediate(df, plan)
    assert done.result.count() == 99
    whole = spark.createDataFrame([("a", None), ("a", None), ("b", "x")], "k string, v string")
    assert remediate.deduplicate(whole, ["k", "v"]).count() == 3 and remediate.deduplicate(whole).count() == 2


def test_deleted_audits_are_hidden(spark, tmp_path):
    store = AuditStore(spark, str(tmp_path))
    for key in ("a1", "a2"):
        store.save("audits", spark.sql("select 1 as score, timestamp'2025-01-01' as created_at"), "2025-01-01", key)
    assert store.delete_audit("a1") == 1 and store.delete_audit("a1") == 0
    assert store.count_audits() == 1 and store.audit("a1").count() == 0 and [r["audit_id"] for r in store.list_audits().collect()] == ["a2"]


def test_lineage_reads_its_input_once(spark, tmp_path):
    spark.sql("select 'd' as dataset_name, 'a1' as audit_id, timestamp'2025-01-01' as created_at, 'version_import' as audit_kind, 1 as dataset_version, 's' as source").write.parquet(str(tmp_path / "a"))
    found = versions.lineage(spark.read.parquet(str(tmp_path / "a")))
    assert found.count() == 1 and "FileScan" not in found._jdf.queryExecution().executedPlan().toString()


def test_alert_snapshots(spark, tmp_path):
    audits = spark.sql("select 1L as workspace_id, 'd' as dataset_name, 'a1' as audit_id, 50 as score, timestamp'2025-01-01' as created_at")
    found = alerts.score_alerts(audits)
    empty = alerts.upsert(found.selectExpr("*", "'new' as status", "detected_at as updated_at").limit(0), found, "2025-01-02")
    store = AuditStore(spark, str(tmp_path))
    store.write_snapshot("alerts", empty)
    acted = alerts.apply_actions(store.snapshot("alerts"), spark.sql("select 1L as workspace_id, 'score:a1:80' as fingerprint, 'resolve' as action, timestamp'2025-01-03' as acted_at, '1' as action_id"))
    store.write_snapshot("alerts", alerts.upsert(acted, found, "2025-01-04"))
    row = store.snapshot("alerts").first()
    assert store.snapshot_number("alerts") == 2 and row["status"] == "resolved" and row["severity"] == "critical"
    export_csv(store.snapshot("alerts"), "alerts", str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first()["Type"] == "score_threshold"


def test_store_replaces_one_audit_only(spark, tmp_path):
    store = AuditStore(spark, str(tmp_path))
    rows = spark.sql("select 1 as n union all select 2")
    store.save("issues", rows, "2025-01-01", "a1")
    store.save("issues", rows, "2025-01-01", "a2")
    store.save("issues", rows.limit(1), "2025-01-01", "a1")
    assert store.read("issues").count() == 3


def test_scope_and_purge(spark):
    audits = spark.sql("select 'a' as audit_id, 'd' as dataset_name, timestamp'2025-01-01' as created_at union all select 'b', 'd', timestamp'2025-02-01'")
    assert reports.in_scope(audits, "2025-01-15").count() == 1
    kept, dropped = reports.purge_stale(audits, audits.where("audit_id = 'a'"))
    assert (kept.first()["audit_id"], dropped.first()["audit_id"]) == ("a", "b")


def test_whole_rows_with_nulls_are_equal_in_columns_of_any_type(spark):
    plain = "select 1 as a, cast(null as string) as b, double('NaN') as x union all select 1, null, null union all select 1, 'c', 2D union all select 2, null, null"
    for more in ("", ", map('k', a) as m", ", array(a) as m", ", named_struct('s', a) as m"):
        df = spark.sql(f"select *{more} from ({plain})")
        assert remediate.deduplicate(df).count() == 3, more
        assert remediate.deduplicate(df.unionByName(df)).count() == 3 and remediate.deduplicate(df).columns == df.columns
    turned = spark.sql("select map('a', 1, 'b', 2) as m union all select map('b', 2, 'a', 1)")
    assert remediate.deduplicate(turned).count() == 1
    assert remediate.deduplicate(turned, ["m"]).count() == 1
    assert remediate.deduplicate(spark.sql(plain).limit(0)).count() == 0


def test_first_and_last_rows_are_cut_down_in_each_task(spark):
    from dqspark.operators.history import latest

    df = spark.createDataFrame([(i % 3, i if i != 5 else None, f"v{i % 7}") for i in range(60)], "k long, t long, v string")
    plans = [remediate.deduplicate(df), remediate.deduplicate(df, ["k"], ["t"]), latest(df, ["k"], ["t", "v"])]
    for made in plans:
        shown = made._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in shown and "WindowGroupLimit" in shown
    assert sorted(map(tuple, plans[1].collect())) == [(0, 0, "v0"), (1, 1, "v1"), (2, None, "v5")]
    assert sorted(map(tuple, plans[2].collect())) == [(0, 57, "v1"), (1, 58, "v2"), (2, 59, "v3")]
    assert latest(df, [], ["t"]).first()["t"] == 59
    # of whole rows only those with a repeated digest are moved
    assert "LeftAnti" in plans[0]._jdf.queryExecution().optimizedPlan().toString()
