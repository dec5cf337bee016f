from __future__ import annotations

import pytest
from dqspark import Options, Rule, execute_rules, violations
from dqspark.operators import rules
from dqspark.streaming import monitor

AS_OF = Options(as_of="2025-06-01")


def counts(df, *made):
    return {r["rule_id"]: r["affected_rows"] for r in execute_rules(df, list(made), options=AS_OF).collect()}


def test_every_rule_type(customers):
    made = [
        Rule(1, "a", "required", "email"), Rule(2, "b", "unique", "customer_id"), Rule(3, "c", "email", "email"),
        Rule(4, "d", "allowed_values", "status", parameters={"values": ["Active", "Inactive"]}),
        Rule(5, "e", "regex", "phone", parameters={"pattern": r"\+254\d{9}|0\d+"}),
        Rule(6, "f", "numeric_range", "monthly_spend", parameters={"min": 13, "max": 100}),
        Rule(7, "g", "length_range", "name", parameters={"min": 7}),
        Rule(8, "h", "missing_threshold", "email", parameters={"max_rate": 0.05}),
        Rule(9, "i", "missing_threshold", "email", parameters={"max_rate": 0.1}),
        Rule(10, "j", "expected_type", "phone", parameters={"type": "numeric"}),
        Rule(11, "k", "stale_days", "signup_date", parameters={"days": 85}),
        Rule(12, "l", "duplicate_rows", scope="dataset"), Rule(13, "m", "required", "nowhere"),
        Rule(14, "n", "expected_type", "status", parameters={"type": "boolean"}),
        Rule(15, "o", "expected_type", "signup_date", parameters={"type": "datetime"}),
    ]
    expected = {1: 1, 2: 2, 3: 2, 4: 2, 5: 1, 6: 2, 7: 1, 8: 1, 9: 0, 10: 1, 11: 7, 12: 2, 13: 10, 14: 10, 15: 0}
    got = counts(customers, *made)
    assert got == expected, {k: (got[k], expected[k]) for k in got if got[k] != expected[k]}
    flagged = violations(customers, made, ["customer_id"], AS_OF).groupBy("rule_id").count().collect()
    assert {r["rule_id"]: r["count"] for r in flagged} == {k: v for k, v in expected.items() if v}


def test_typed_columns(spark):
    df = spark.createDataFrame([(1, 25.0, True), (2, float("nan"), False), (3, 150.0, None)], "id int, age double, ok boolean")
    got = counts(df, Rule(1, "a", "numeric_range", "age", parameters={"max": 120}), Rule(2, "b", "required", "age"),
                 Rule(3, "c", "allowed_values", "id", parameters={"values": [1, 2]}), Rule(4, "d", "expected_type", "ok", parameters={"type": "boolean"}))
    assert got == {1: 1, 2: 1, 3: 1, 4: 0}


def test_refused_rules():
    for bad in (Rule(1, "a", "regex", "x"), Rule(1, "a", "required"), Rule(1, "a", "required", scope="dataset"), Rule(1, "a", "odd", "x"),
                Rule(1, "a", "regex", "x", parameters={"pattern": "("})):
        with pytest.raises(rules.RuleError):
            rules.validate_rule(bad)
    assert rules.java_pattern(r"(?P<y>\d{4})") == r"(?U)^(?:(?<y>\d{4}))$"


def test_many_rules_take_one_pass_per_chunk(customers):
    made = [Rule(i, f"r{i}", "length_range", "name", parameters={"max": i % 12}) for i in range(1, 130)]
    got = counts(customers, *made)
    assert len(got) == 129 and got[11] == 0 and got[1] == 10


def test_quotes_and_odd_names(spark):
    df = spark.createDataFrame([("it's",), ("b\\c",), (None,)], "`odd ``name` string")
    got = counts(df, Rule(1, "it's", "allowed_values", "odd `name", parameters={"values": ["it's"]}))
    assert got == {1: 1}


def test_rules_round_trip(spark):
    made = [Rule(3, "x", "regex", "c", parameters={"pattern": "a"}), Rule(4, "y", "required", "c", is_active=False)]
    assert [r.id for r in rules.rules_from_table(rules.rules_table(spark, made))] == [3]


def test_stream_equals_batch(spark, customers, tmp_path):
    made = [Rule(1, "a", "required", "email"), Rule(2, "b", "allowed_values", "status", parameters={"values": ["Active"]})]
    source = str(tmp_path / "in")
    for start in range(3):
        customers.where(f"pmod(hash(customer_id), 3) = {start}").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(customers.schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = monitor.watch_rules(stream, made, str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination()
    batches = spark.read.parquet(str(tmp_path / "out"))
    assert batches.select("batch_id").distinct().count() >= 2
    got = {r["rule_id"]: r["affected_rows"] for r in monitor.total_counts(batches).collect()}
    assert got == counts(customers, *made)
    with pytest.raises(rules.RuleError):
        monitor.row_rules([Rule(1, "a", "unique", "email")])
