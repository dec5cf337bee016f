"""One frequency table per audit, few passes, and states that add up."""

from __future__ import annotations

import pytest

from dqspark import Expectations, Options, Rule, audit
from dqspark.plans.audit import conclude
from dqspark.plans.state import StateError, load, merge, observe

AS_OF = Options(as_of="2025-06-01")
RULES = [
    Rule(1, "Email format", "email", "email"), Rule(2, "Ids once", "unique", "customer_id"), Rule(3, "No copies", "duplicate_rows", scope="dataset"),
    Rule(4, "Gaps", "missing_threshold", "email", parameters={"max_rate": 0.05}), Rule(5, "Fresh", "stale_days", "signup_date", parameters={"days": 90}),
]
EXPECT = Expectations(required_columns=["region"], unique_columns=["email"], allowed_values={"status": ["Active"]}, numeric_ranges={"monthly_spend": (0, 100)})
TABLES = ("columns", "dataset", "issues", "executions", "score")


def rows(df):
    return sorted(str(tuple(round(v, 9) if isinstance(v, float) else v for v in r)) for r in df.drop("executed_at").collect())


def same(a, b):
    for name in TABLES:
        assert rows(getattr(a, name)) == rows(getattr(b, name)), name


def counting(spark, df):
    """The same table, and a function telling how many rows have been read from it."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return df.mapInArrow(count, df.schema), lambda: seen.value


def test_an_audit_reads_its_table_four_times(spark, customers):
    spelled = customers.withColumn("signup_at", customers.signup_date).unionByName(customers.limit(1).selectExpr("* except (country)", "' kenya ' as country", "signup_date as signup_at"))
    table, seen = counting(spark, spelled.repartition(3).cache())
    size = spelled.count()
    audit(table, RULES, EXPECT, options=AS_OF).issues.collect()
    assert seen() == 4 * size
    audit(table, RULES, EXPECT, by=["country"], options=AS_OF).issues.collect()
    assert seen() == 8 * size


@pytest.mark.parametrize("by", [[], ["country"]])
def test_state_of_parts_is_the_state_of_the_whole(spark, customers, tmp_path, by):
    padded = customers.unionByName(customers.where("customer_id in ('K1', 'K8')").selectExpr("customer_id", "concat(' ', name) as name", "* except (customer_id, name, monthly_spend)", "' 1,250.5' as monthly_spend").select(customers.columns))
    parts = [padded.where("customer_id <= 'K3'"), padded.where("customer_id > 'K3' and customer_id < 'K8'"), padded.where("customer_id >= 'K8'")]
    expect = EXPECT if not by else Expectations(unique_columns=["email"])
    whole = audit(padded, RULES, expect, by, AS_OF)
    first = observe(parts[0], RULES, expect, by, AS_OF)
    first.save(f"{tmp_path}/state")
    again = load(spark, f"{tmp_path}/state", padded.schema, RULES, expect, by, AS_OF)
    same(conclude(merge(again, *[observe(p, RULES, expect, by, AS_OF) for p in parts[1:]])), whole)
    same(conclude(merge(observe(padded, RULES, expect, by, AS_OF), observe(padded.limit(0), RULES, expect, by, AS_OF))), whole)


def test_states_of_other_checks_are_refused(spark, customers, tmp_path):
    kept = observe(customers, RULES, options=AS_OF)
    for other in (observe(customers, RULES[:2], options=AS_OF), observe(customers.drop("country"), RULES, options=AS_OF), observe(customers, RULES, options=Options(as_of="2025-06-02"))):
        with pytest.raises(StateError):
            merge(kept, other)
    kept.save(f"{tmp_path}/state")
    with pytest.raises(StateError):
        load(spark, f"{tmp_path}/state", customers.schema, RULES[:1], options=AS_OF)
    with pytest.raises(Exception, match="exists"):
        kept.save(f"{tmp_path}/state")
    with pytest.raises(StateError):
        merge(observe(customers), observe(customers))


def test_numbers_from_frequencies_equal_those_from_rows(spark):
    values = [0.1, -0.0, 1e-7, 123456789.123, 1e20, 2.5, 2.5, None, float("nan"), 7.0]
    df = spark.createDataFrame([(v, None if v is None else float(v), str(v), "9" * 300 if i == 2 else str(i)) for i, v in enumerate(values * 3)], "a double, b float, c string, d string")
    from dqspark.operators import profile
    from dqspark.operators.cells import Layout

    layout = Layout.of(df)
    counted = profile.count_cells(df, layout, AS_OF)
    measures = profile.with_distinct(counted, layout, AS_OF)
    assert rows(profile.outlier_measures(df, layout, measures, AS_OF, counted)) == rows(profile.outlier_measures(df, layout, measures, AS_OF))


def test_sketched_quartiles_are_close_and_merge(spark):
    import random

    from dqspark.operators import profile
    from dqspark.operators.quantiles import exact_quantiles, sketched_quantiles

    draw = random.Random(4)
    values = sorted([draw.lognormvariate(0, 2) for _ in range(20_000)])
    df = spark.createDataFrame([(v, "a") for v in values], "x double, g string").repartition(7)
    got = sketched_quantiles(df, ["g"], [0.0, 0.1, 0.5, 0.99, 1.0]).first()
    assert got["n"] == 20_000 and got["q0"] == values[0] and got["q4"] == values[-1]
    for p, q in zip((0.1, 0.5, 0.99), (got["q1"], got["q2"], got["q3"]), strict=True):
        assert abs(sum(v <= q for v in values) / 20_000 - p) < 0.015
    assert sketched_quantiles(df.where("x < 0"), ["g"], [0.5]).count() == 0
    options = Options(as_of="2025-06-01", quantiles="sketch")
    whole = profile.profile_columns(df, options=options).where("column = 'x'").first()
    parts = merge(*[observe(df.where(t), options=options) for t in ("x < 1", "x >= 1")])
    merged = conclude(parts).columns.where("column = 'x'").first()
    exact = exact_quantiles(df, [], [0.5]).first()["q0"]
    rank = lambda q: sum(v <= q for v in values) / 20_000
    for found in (whole, merged):
        assert abs(rank(found["median"]) - rank(exact)) < 0.015 and found["row_count"] == 20_000
        assert found["outlier_count"] == pytest.approx(profile.profile_columns(df, options=AS_OF).where("column = 'x'").first()["outlier_count"], rel=0.2)


@pytest.mark.parametrize("wanted", [("completeness", "consistency"), ("uniqueness",), ("uniqueness", "completeness", "privacy"), ()])
def test_preview_by_what_changed_equals_a_whole_audit(spark, customers, wanted):
    from dqspark.operators.score import DEFAULT_CONTEXT
    from dqspark.plans.clean import preview

    df = customers.unionByName(customers.where("customer_id = 'K3'")).selectExpr(
        "*", "cast(monthly_spend as double) / 3 as ratio", "cast(signup_date as date) as joined", "repeat(name, 60) as story", "if(customer_id = 'K4', '  padded ', country) as place")
    source = audit(df, RULES, EXPECT, options=AS_OF)
    ids = [r["id"] for r in source.issues.collect() if r["category"] in wanted]
    how = {"order_by": ["customer_id"], "fill_strategy": "mode"}
    done = preview(df, source, ids, options=AS_OF, **how)
    whole = audit(done.remediation.result, RULES, EXPECT, options=AS_OF, context=DEFAULT_CONTEXT)
    same(done.projected, whole)
    assert bool(ids) == bool(wanted)
