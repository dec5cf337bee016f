"""Audits from states of parts, and of cleaned tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from dqspark.operators import contracts, profile, rules
from dqspark.operators.rules import Rule
from dqspark.plans.audit import audit, conclude
from dqspark.plans.clean import preview
from dqspark.plans.state import merge, observe

from .profile_queries import _CUSTOMER_ISSUES, _profile_sql, DIRTY
from .registry import inferred, miss, num, register, union
from .rule_queries import RULES, _SUMMARY
from .tables import table, view
from .views import AS_OF, with_views

OPTIONS = profile.Options(as_of=AS_OF)


def _halves(spark, sf_dir, rules=None):
    """The state of all customers, put together from two parts of the table."""
    df = view(spark, sf_dir, "customer_dup")
    odd = "cast(customer_id as int) % 2 = 1"
    return merge(*[observe(df.where(test), rules, options=OPTIONS) for test in (odd, f"not ({odd})")])


@register("state_profile", with_views(["customer_dup"], union([_profile_sql(c, c, "customer_dup") for c in DIRTY])))
def state_profile(spark, sf_dir):
    return conclude(_halves(spark, sf_dir)).columns.selectExpr(
        "column as column_name", "inferred_type", "row_count", "missing_count", "missing_rate", "unique_count", "unique_rate",
        "cardinality", "constant as is_constant", "identifier_candidate",
    )


@register("state_issues", with_views(["customer_dup"], f"""select category, severity, title, affected_rows, affected_rate,
 case when category = 'privacy' then null else confidence end as confidence from ({_CUSTOMER_ISSUES})"""))
def state_issues(spark, sf_dir):
    return conclude(_halves(spark, sf_dir)).issues.selectExpr(
        "category", "severity", "title", "affected_rows", "affected_rate", "if(category = 'privacy', null, confidence) as confidence"
    )


@register("state_rules", with_views(["customer_dup"], f"""select rule_id, case when affected_rows > 0 then 'failed' else 'passed' end as outcome,
 cast(affected_rows as bigint) as affected_rows, round(cast(affected_rows as double) / n, 4) as affected_rate from ({_SUMMARY})"""))
def state_rules(spark, sf_dir):
    return conclude(_halves(spark, sf_dir, RULES)).executions.select("rule_id", "outcome", "affected_rows", "affected_rate")


# --- risk of numeric columns -------------------------------------------------------------
def _risk_sql(name: str, value: str, missing: str, source: str) -> str:
    rate = f"round(cast(count_if({missing}) as double) / count(*), 4)"
    beyond = f"count_if({value} < q.a - 1.5 * (q.b - q.a) or {value} > q.b + 1.5 * (q.b - q.a))"
    share = f"round(cast({beyond} as double) / count({value}), 4)"
    return f"""select '{name}' as column_name, {beyond} as outlier_count, {share} as outlier_rate, cast(least(100, case when {rate} >= 0.5 then 45 when {rate} >= 0.1 then 25
 when {rate} > 0 then 8 else 0 end + case when {share} >= 0.1 then 30 when {share} > 0 then 12 else 0 end) as int) as risk_score
 from {source}, (select quantile_cont({value}, 0.25) as a, quantile_cont({value}, 0.75) as b from {source}) q"""


@register("profile_risk_numeric", with_views(["customer_dirty"], union([
    _risk_sql("balance_amount", num("balance_amount"), miss("balance_amount"), "customer_dirty"),
    *[_risk_sql(c, c, f"{c} is null", "lineitem") for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")]])))
def profile_risk_numeric(spark, sf_dir):
    """Risk of columns with outliers."""
    customers = profile.profile_columns(view(spark, sf_dir, "customer_dirty"), options=OPTIONS).where("column = 'balance_amount'")
    items = profile.profile_columns(table(spark, sf_dir, "lineitem", heavy=True), options=OPTIONS).where("column in ('l_quantity', 'l_extendedprice', 'l_discount', 'l_tax')")
    return customers.unionByName(items).selectExpr("column as column_name", "outlier_count", "outlier_rate", "risk_score")


# --- contracts of one version held against the next ---------------------------------------
COLUMNS = ("order_key", "total", "remark", "state")
_KINDS = "(" + union([
    f"select dataset, version, '{c}' as column_name, {inferred(c, c)} as kind, count_if({miss(c)}) = 0 as is_full, count(*) as n from order_versions group by dataset, version"
    for c in COLUMNS]) + ")"
_PAIRS = f"""(select b.dataset, b.version, b.column_name, b.kind, b.is_full, a.kind as next_kind, a.n from {_KINDS} b
 join {_KINDS} a on a.dataset = b.dataset and a.version = b.version + 1 and a.column_name = b.column_name)"""
_TYPES_BROKEN = "count_if(kind <> 'empty' and next_kind <> 'empty' and kind <> next_kind)"


def _versions(spark, sf_dir):
    """Profiles, and one audit for each version that follows another; a version's contract is named after it."""
    df = view(spark, sf_dir, "order_versions")
    seen = profile.profile_columns(df, ["dataset", "version"], OPTIONS)
    audits = seen.groupBy("dataset", "version").agg(F.max("row_count").alias("row_count")).selectExpr(
        "concat(dataset, '@', version - 1) as dataset_name", "concat(dataset, '-', version) as audit_id", "version as dataset_version",
        "make_timestamp(2000 + version, 1, 1, 0, 0, 0) as created_at", "row_count",
    )
    # a column without values is one that the version does not have
    profiles = seen.where("inferred_type <> 'empty'").selectExpr("concat(dataset, '-', version) as audit_id", "column", "inferred_type")
    return df, seen, audits, profiles


_VERDICT = "concat(dataset, '@', version) as dataset_name, concat(dataset, '-', version + 1) as audit_id, version + 1 as dataset_version"


@register("contract_next_version", with_views(["order_versions"], f"""select *, missing_columns + type_mismatches as violation_count,
 case when missing_columns + type_mismatches = 0 then 'passed' else 'failed' end as validation_status from (
 select {_VERDICT}, count_if(is_full and next_kind = 'empty') as missing_columns, {_TYPES_BROKEN} as type_mismatches from {_PAIRS} group by dataset, version)"""))
def contract_next_version(spark, sf_dir):
    """Contracts made from profiles, each held against the version after (K1, K4, K6); some pass, some fail."""
    df, seen, audits, profiles = _versions(spark, sf_dir)
    made = contracts.contract_from_profile(seen, profile.top_values(df, 21, ["dataset", "version"], sensitive=True), ["dataset", "version"])
    named = made.selectExpr(
        "concat(dataset, '@', version) as dataset_name", "*",
        "cast(array() as array<struct<rule_id: bigint, name: string, rule_type: string, column: string>>) as assigned_rules",
    ).drop("dataset", "version")
    none = spark.createDataFrame([], "audit_id string, rule_id long, outcome string, affected_rows long")
    return contracts.validate(named, audits, profiles, none).drop("rule_violations")


VERSION_RULES = [
    Rule(1, "Total present", "required", "total"), Rule(2, "States", "allowed_values", "state", parameters={"values": ["F", "O", "P"]}),
    Rule(3, "Total limits", "numeric_range", "total", parameters={"min": 0, "max": 900000}),
]
_RULES_BROKEN = f"""(select dataset, version, cast(count_if({miss('total')}) > 0 as int) + cast(count_if(not {miss('state')} and trim(state) not in ('F', 'O', 'P')) > 0 as int)
 + cast(count_if(not {miss('total')} and ({num('total')} is null or {num('total')} < 0 or {num('total')} > 900000)) > 0 as int) as broken from order_versions group by dataset, version)"""


@register("contract_rules_next_version", with_views(["order_versions"], f"""select *, missing_columns + type_mismatches + rule_violations as violation_count,
 case when missing_columns + type_mismatches + rule_violations = 0 then 'passed' else 'failed' end as validation_status from (
 select {_VERDICT}, count_if(column_name = 'total' and next_kind = 'empty') as missing_columns, {_TYPES_BROKEN} as type_mismatches, cast(max(broken) as bigint) as rule_violations
 from {_PAIRS} p join {_RULES_BROKEN} r using (dataset) where r.version = p.version + 1 group by dataset, p.version)""".replace("concat(dataset, '@', version)", "concat(dataset, '@', p.version)").replace("concat(dataset, '-', version + 1)", "concat(dataset, '-', p.version + 1)").replace(" version + 1 as dataset_version", " p.version + 1 as dataset_version")))
def contract_rules_next_version(spark, sf_dir):
    """Contracts made from rules and run on every version (K2, K5, K6)."""
    by = ["dataset", "version"]
    df, seen, audits, profiles = _versions(spark, sf_dir)
    assigned = seen.select(*by).distinct().crossJoin(F.broadcast(rules.rules_table(spark, VERSION_RULES)))  # a row per version and rule
    named = contracts.contract_from_rules(assigned, seen, by).selectExpr("concat(dataset, '@', version) as dataset_name", "*").drop(*by)
    ran = rules.execute_rules(df, VERSION_RULES, by, OPTIONS).selectExpr("concat(dataset, '-', version) as audit_id", "rule_id", "outcome", "affected_rows")
    return contracts.validate(named, audits, profiles, ran)


@register("contract_run", with_views(["order_versions"], f"""select column_name, affected_rows from (
 select 'total' as column_name, count_if(not {miss('total')} and ({num('total')} < a or {num('total')} > b)) as affected_rows from order_versions,
  (select min({num('total')}) as a, max({num('total')}) as b from order_versions where version = 3)
 union all select 'state', count_if(not {miss('state')} and trim(state) not in (select trim(state) from order_versions where version = 3 and not {miss('state')})) from order_versions) where affected_rows > 0"""))
def contract_run(spark, sf_dir):
    """The contract of the third year, turned into expectations that all years are audited by (K3)."""
    df = view(spark, sf_dir, "order_versions").drop("dataset")
    third = df.where("version = 3").drop("version")
    made = contracts.contract_from_profile(profile.profile_columns(third, options=OPTIONS), profile.top_values(third, 21, sensitive=True)).first()
    found = audit(df.drop("version"), expectations=contracts.to_expectations(made), options=OPTIONS).issues
    kept = found.where("title like 'Values outside allowed%' or title like 'Configured numeric range%'")
    return kept.selectExpr("columns[0] as column_name", "affected_rows").where("column_name in ('total', 'state')")


# --- preview of a cleaned table ------------------------------------------------------------
_CLEANED = """(select distinct on (customer_id) customer_id, full_name, email, phone, balance_amount, status,
 array_to_string(list_transform(regexp_extract_all(lower(trim(segment)), '[a-z]+|[^a-z]+'), lambda x: upper(x[1]) || x[2:]), '') as segment from customer_dup)"""


def _previewed(spark, sf_dir):
    df = view(spark, sf_dir, "customer_dup")
    source = audit(df, options=OPTIONS)
    keys = [r["id"] for r in source.issues.where("category in ('uniqueness', 'consistency')").select("id").collect()]
    return source, preview(df, source, keys, options=OPTIONS, order_by=["customer_id"])


@register("preview_profile", with_views(["customer_dup"], union([_profile_sql(c, c, _CLEANED) for c in DIRTY])))
def preview_profile(spark, sf_dir):
    """All columns of the cleaned table, as the preview's audit sees them (M9)."""
    return _previewed(spark, sf_dir)[1].projected.columns.selectExpr(
        "column as column_name", "inferred_type", "row_count", "missing_count", "missing_rate", "unique_count", "unique_rate",
        "cardinality", "constant as is_constant", "identifier_candidate",
    )


@register("preview_cells", with_views(["customer_dup"], f"""select (select count(*) from customer_dup) as rows_before, (select count(*) from {_CLEANED}) as rows_after,
 (select count_if(segment is distinct from array_to_string(list_transform(regexp_extract_all(lower(trim(segment)), '[a-z]+|[^a-z]+'), lambda x: upper(x[1]) || x[2:]), '')) from (select distinct on (customer_id) * from customer_dup)) as changed_cells,
 true as better"""))
def preview_cells(spark, sf_dir):
    """Rows, changed cells, and whether the score rises and issues fall (M6, M9)."""
    source, done = _previewed(spark, sf_dir)
    changed = done.remediation.changes().selectExpr("sum(changed_cells) as changed_cells")
    shown = done.comparison(source).selectExpr("rows_before", "rows_after", "projected_score_delta > 0 and projected_issues < issues_before as better")
    return shown.crossJoin(changed).select("rows_before", "rows_after", "changed_cells", "better")
