from __future__ import annotations

import dqspark
import pytest
from dqspark import Expectations, Options, Rule, ScoringContext, audit
from dqspark.operators import profile, score
from dqspark.operators.cells import Layout
from dqspark.operators.quantiles import exact_quantiles
from pyspark.sql import functions as F

CSV = Options(dtypes="csv", as_of="2025-06-01")


@pytest.fixture(scope="module")
def audited(customers):
    expect = Expectations(
        required_columns=["customer_id", "segment"], unique_columns=["CUSTOMER_ID"],
        allowed_values={"status": ["Active", "Inactive"]}, numeric_ranges={"monthly_spend": (0, 1000)},
    )
    rules = [Rule(1, "Email ok", "email", "email"), Rule(2, "Spend", "numeric_range", "monthly_spend", parameters={"max": 5000})]
    return audit(customers, rules, expect, options=CSV)


def test_profile(audited):
    found = {r["column"]: r for r in audited.columns.collect()}
    assert found["monthly_spend"]["inferred_type"] == "numeric" and found["monthly_spend"]["outlier_count"] == 3
    assert found["signup_date"]["inferred_type"] == "datetime" and found["signup_date"]["missing_count"] == 1
    assert found["country"]["constant"] and found["country"]["cardinality"] == "constant"
    assert found["email"]["sensitivity"] == "high" and found["status"]["sensitivity"] is None
    assert found["customer_id"]["unique_count"] == 9 and found["customer_id"]["identifier_candidate"]
    total = audited.dataset.first()
    assert (total["row_count"], total["duplicate_row_count"], total["rows_in_duplicate_groups"]) == (10, 1, 2)
    assert total["completeness_rate"] == 0.975


def test_issues(audited):
    found = {r["title"]: r for r in audited.issues.collect()}
    for title, rows in {
        "Missing values in email": 1, "Missing values in signup_date": 1, "country has one repeated value": 10,
        "Duplicate rows detected": 1, "Duplicate key values in customer_id": 2, "Invalid email format in email": 2,
        "Invalid phone format in phone": 1, "Potential PII columns detected": 10, "Outliers detected in monthly_spend": 3,
        "Inconsistent category casing in status": 2, "Required column missing: segment": 10,
        "Configured unique column has duplicates: customer_id": 2, "Values outside allowed set in status": 2,
        "Configured numeric range violated in monthly_spend": 1, "Email ok failed": 2,
    }.items():
        assert found[title]["affected_rows"] == rows, title
    assert "Required column missing: customer_id" not in found
    assert found["Missing values in email"]["id"] == "DQ-001" and found["Email ok failed"]["id"] == "QR-015"
    assert {r["outcome"] for r in audited.executions.collect()} == {"failed", "passed"}


def test_score_and_summary(audited):
    row = audited.score.first()
    assert 0 <= row["overall"] < 100 and row["active_issue_count"] == audited.issues.count()
    assert audited.summary.first()["risk_level"] == "critical"


def test_slices_equal_single_audits(spark, customers):
    twice = customers.withColumn("part", F.lit("a")).unionByName(customers.limit(0).withColumn("part", F.lit("a")))
    twice = twice.unionByName(customers.where("status <> 'Inactive'").withColumn("part", F.lit("b")))
    together = audit(twice, by=["part"], options=CSV)
    for part, frame in (("a", customers), ("b", customers.where("status <> 'Inactive'"))):
        alone = audit(frame, options=CSV)
        keep = ["id", "title", "severity", "affected_rows", "affected_rate"]
        left = sorted(map(tuple, together.issues.where(f"part = '{part}'").select(*keep).collect()))
        assert left == sorted(map(tuple, alone.issues.select(*keep).collect()))
        assert together.score.where(f"part = '{part}'").first()["overall"] == alone.score.first()["overall"]


def test_result_does_not_depend_on_partitions(spark, customers):
    base = None
    for parts in (1, 4, 16):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        got = sorted(map(str, audit(customers.repartition(parts), options=CSV).issues.collect()))
        base = base or got
        assert got == base
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_scoring_properties():
    assert abs(sum(ScoringContext(weights={"validity": 5.0}).shares().values()) - 1) < 1e-12


def scored(spark, **fields):
    issue = dict(id="DQ-001", category="validity", severity="medium", affected_rate=0.2, confidence=0.9, status="open", rule_id=None)
    issue.update(fields)
    context = issue.pop("context", ScoringContext())
    issues = spark.createDataFrame(
        [tuple(issue.values())], "id string, category string, severity string, affected_rate double, confidence double, status string, rule_id long"
    )
    shape = spark.createDataFrame([(0.0,)], "duplicate_row_rate double")
    return score.rescore(issues, shape, context).first()


def test_scores_order(spark):
    wide = scored(spark, severity="critical", affected_rate=1.0)["overall"]
    assert wide < scored(spark, severity="low", affected_rate=0.01)["overall"]
    open_, risk, done = (scored(spark, status=s)["total_weighted_penalty"] for s in ("open", "accepted_risk", "fixed"))
    assert open_ > risk > done == 0
    assert scored(spark, rule_id=7)["total_weighted_penalty"] > open_
    assert scored(spark, context=ScoringContext("mission_critical"))["total_weighted_penalty"] > open_


def test_quantiles_are_exact_for_every_bucket_count(spark):
    import numpy as np

    inf = float("inf")
    groups = {
        0: [7.0] * 900 + [float(hash((i, 1)) % 1000) / 10 for i in range(2000)], 1: [*map(float, range(60)), *[-inf] * 40], 2: [inf, -inf, 0.0, -0.0],
        3: [5e-324, 1e-323, -5e-324, 1.7e308, -1.7e308, 1e308], 4: [3.5], 5: [1 / 3 + i * 1e-16 for i in range(50)], 6: [-inf] * 5, 7: [float("nan"), 2.0, None, 4.0],
    }
    df = spark.createDataFrame([(g, x) for g, xs in groups.items() for x in xs], "g int, x double")
    some = [0.0, 0.25, 0.5, 0.9, 1.0]
    found = [{r["g"]: r for r in exact_quantiles(df, ["g"], some, buckets=b).collect()} for b in (4096, 3)]
    assert found[0] == found[1]
    for g, xs in groups.items():
        kept = sorted(x for x in xs if x is not None and x == x)
        assert found[0][g]["n"] == len(kept)
        for i, p in enumerate(some):
            place = (len(kept) - 1) * p
            a, b = kept[int(np.floor(place))], kept[int(np.ceil(place))]
            want = a if a == b else (np.ceil(place) - place) * a + (place - np.floor(place)) * b
            assert found[0][g][f"q{i}"] == want, (g, p)
    whole = exact_quantiles(df.where("g = 0"), [], [0.5]).first()
    assert whole["q0"] == found[0][0]["q2"]


def test_approximate_distinct_keeps_keys_exact(customers):
    found = profile.profile_columns(customers, options=Options(approximate_distinct=True)).where("column = 'customer_id'").first()
    assert found["unique_count"] == 9


def test_padded_values_count_as_spellings(spark):
    df = spark.createDataFrame([("a",), ("a ",), ("A",), (" ",)], "label string")
    found = profile.profile_columns(df).first()
    assert (found["unique_count"], found["missing_count"]) == (3, 1)
    issue = audit(df).issues.where("category = 'consistency'").first()
    assert issue["affected_rows"] == 2


def test_nested_columns_are_accepted(spark):
    df = spark.sql("select array(1, 2) as xs, map('a', 1) as m, named_struct('p', 1) as s union all select array(1, 2), map('a', 1), named_struct('p', 1)")
    assert dqspark.profile_dataset(df).first()["duplicate_row_count"] == 1


def test_top_and_sample_values(customers):
    first = profile.top_values(customers, 1).where("column = 'country'").first()
    assert (first["value"], first["n"]) == ("Kenya", 10)
    shown = profile.sample_values(customers, 2, columns=["name"], order_by=["customer_id"]).orderBy("place").collect()
    assert [r["value"] for r in shown] == ["Ada Obi", "Ben Ito"]


def test_long_values_are_counted_by_digest_and_shown_whole(spark):
    long = "x" * 400
    df = spark.createDataFrame([(long,), (long,), ("y" * 300,)], "text string")
    assert profile.distinct_measures(df, Layout.of(df)).first()["unique_count"] == 2
    assert profile.top_values(df, 1).first()["value"] == long


def test_top_k_is_cut_before_the_shuffle(customers):
    plan = profile.first_in_order(customers, ["country"], "customer_id", 2)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


def test_column_types_equal_the_full_measures_and_move_boolean_columns_only(spark, monkeypatch):
    """Types alone need no value counts but those of boolean words (before, every column's values were moved)."""
    rows = [
        (f"s{i % 2}", f"k{i}", ["yes", "No", " y "][i % 3], "true" if i < 99 else f"x{i}", ["0", "1", "y", "n", "no", "yes", "true", "false"][i % 8], "1" if i % 2 else "0",
         None, "", "1,200.5" if i % 20 else "z", "2025-01-0" + str(i % 9 + 1), "10:3" + str(i % 10), i % 2 == 0, float("nan") if i % 3 else 1.5, f"0{i % 2}")
        for i in range(100)
    ]
    kinds = "slice string, k string, flag string, most string, eight string, code string, none string, blank string, amount string, day string, made_time string, b boolean, x double, phone string"
    df = spark.createDataFrame(rows, kinds).repartition(3)
    moved, counts = [], profile.value_counts
    monkeypatch.setattr(profile, "value_counts", lambda df, layout, only=None: (moved.append(only), counts(df, layout, only))[1])
    for by in ([], ["slice"]):
        for options in (Options(as_of="2025-06-01"), Options(as_of="2025-06-01", dtypes="csv", name_match="word")):
            layout = Layout.of(df, by)
            keys = [*by, "ord", "inferred_type"]
            wanted = profile.column_measures(df, layout, options).select(*keys).collect()
            assert sorted(map(tuple, profile.column_types(df, layout, options).collect())) == sorted(map(tuple, wanted))
            assert {"flag", "most", "eight"} <= set(moved[-1]) <= {"flag", "most", "eight", "code"}
    assert profile.column_types(df.where("false"), Layout.of(df)).count() == 0
    plain = df.select("k", "amount")
    before = len(moved)
    assert {r["inferred_type"] for r in profile.column_types(plain, Layout.of(plain)).collect()} == {"text", "numeric"} and len(moved) == before
