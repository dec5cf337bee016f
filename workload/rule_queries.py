"""Rule engine, remediation, contracts from data, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from dqspark.operators import contracts, profile, remediate, rules
from dqspark.operators.rules import Rule
from dqspark.streaming import monitor

from .registry import email, inferred, miss, num, register, stamp, union, unique_of
from .tables import issues, table, view
from .views import AS_OF, with_views

OPTIONS = profile.Options(as_of=AS_OF)
NOW = f"timestamp '{AS_OF}'"
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
_SEGMENTS = ", ".join(f"'{s}'" for s in SEGMENTS)

RULES = [
    Rule(1, "Name present", "required", "full_name", category="completeness", severity="high"),
    Rule(2, "Email format", "email", "email", severity="high"),
    Rule(3, "Known segment", "allowed_values", "segment", parameters={"values": SEGMENTS}),
    Rule(4, "Phone pattern", "regex", "phone", parameters={"pattern": r"\+254\d{9}"}),
    Rule(5, "Balance limits", "numeric_range", "balance_amount", parameters={"min": 0, "max": 50000}, severity="critical"),
    Rule(6, "Email length", "length_range", "email", parameters={"min": 17, "max": 19}),
    Rule(7, "Email gaps", "missing_threshold", "email", parameters={"max_rate": 0.05}),
    Rule(8, "Name gaps", "missing_threshold", "full_name", parameters={"max_rate": 0.5}),
    Rule(9, "Balance is a number", "expected_type", "balance_amount", parameters={"type": "numeric"}),
    Rule(10, "Email unique", "unique", "email"),
    Rule(11, "Region present", "required", "region"),
    Rule(12, "No copies", "duplicate_rows", scope="dataset", category="uniqueness"),
    Rule(13, "Status is text", "expected_type", "status", parameters={"type": "text"}),
]


def _rule(i: int, test: str, source: str = "customer_dup") -> str:
    return f"select cast({i} as bigint) as rule_id, count_if({test}) as affected_rows, count(*) as n from {source}"


_REPEATED_EMAIL = "select trim(email) from customer_dup where not " + miss("email") + " group by 1 having count(*) > 1"
_COLUMNS = "customer_id, full_name, email, phone, segment, balance_amount, status"
_RULE_TESTS = {
    1: miss("full_name"),
    2: f"not {miss('email')} and not {email('email')}",
    3: f"not {miss('segment')} and trim(segment) not in ({_SEGMENTS})",
    4: f"not {miss('phone')} and not regexp_full_match(trim(phone), '\\+254[0-9]{{9}}')",
    5: f"not {miss('balance_amount')} and ({num('balance_amount')} is null or {num('balance_amount')} < 0 or {num('balance_amount')} > 50000)",
    6: f"not {miss('email')} and (length(trim(email)) < 17 or length(trim(email)) > 19)",
    9: f"not {miss('balance_amount')} and {num('balance_amount')} is null",
    10: f"not {miss('email')} and trim(email) in ({_REPEATED_EMAIL})",
    11: "true",
    13: "false",
}
_GAPS = "select cast({i} as bigint), case when avg(case when {m} then 1.0 else 0.0 end) > {t} then count_if({m}) else 0 end, count(*) from customer_dup"
_COPIES = f"select cast(12 as bigint), cast(coalesce(sum(case when k > 1 then k else 0 end), 0) as bigint), cast(sum(k) as bigint) from (select count(*) as k from customer_dup group by {_COLUMNS})"
_SUMMARY = union([
    *[_rule(i, t) for i, t in _RULE_TESTS.items()], _GAPS.format(i=7, m=miss("email"), t=0.05), _GAPS.format(i=8, m=miss("full_name"), t=0.5), _COPIES,
])


@register("rules_summary", with_views(["customer_dup"], f"""select rule_id, case when affected_rows > 0 then 'failed' else 'passed' end as outcome,
 cast(affected_rows as bigint) as affected_rows, round(cast(affected_rows as double) / n, 4) as affected_rate from ({_SUMMARY})"""))
def rules_summary(spark, sf_dir):
    found = rules.execute_rules(view(spark, sf_dir, "customer_dup"), RULES, options=OPTIONS)
    return found.select("rule_id", "outcome", "affected_rows", "affected_rate")


@register("rules_by_slice", """select l_shipmode_group as slice, rule_id, case when affected_rows > 0 then 'failed' else 'passed' end as outcome, affected_rows,
 round(cast(affected_rows as double) / n, 4) as affected_rate from (
 select l_returnflag as l_shipmode_group, cast(1 as bigint) as rule_id, count_if(l_quantity > 45) as affected_rows, count(*) as n from lineitem group by 1
 union all select l_returnflag, cast(2 as bigint), count_if(l_discount < 0.05), count(*) from lineitem group by 1)""")
def rules_by_slice(spark, sf_dir):
    checks = [
        Rule(1, "Quantity", "numeric_range", "l_quantity", parameters={"max": 45}),
        Rule(2, "Discount", "numeric_range", "l_discount", parameters={"min": 0.05}),
    ]
    df = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", "l_discount")
    found = rules.execute_rules(df, checks, ["l_returnflag"], OPTIONS)
    return found.selectExpr("l_returnflag as slice", "rule_id", "outcome", "affected_rows", "affected_rate")


@register("rules_dates", with_views(["people"], f"""select rule_id, affected_rows from (
 select cast(1 as bigint) as rule_id, count_if(not {miss('birth_date')} and {stamp('birth_date')} is null) as affected_rows from people
 union all select cast(2 as bigint), count_if(not {miss('updated_at')} and ({stamp('updated_at')} is null or {stamp('updated_at')} < {NOW} - interval 100 day)) from people
 union all select cast(3 as bigint), count_if(not {miss('email_verified')} and lower(trim(email_verified)) not in ('true','false','yes','no','1','0')) from people)"""))
def rules_dates(spark, sf_dir):
    checks = [
        Rule(1, "Birth date", "expected_type", "birth_date", parameters={"type": "datetime"}),
        Rule(2, "Fresh", "stale_days", "updated_at", parameters={"days": 100}),
        Rule(3, "Flag", "expected_type", "email_verified", parameters={"type": "boolean"}),
    ]
    return rules.execute_rules(view(spark, sf_dir, "people"), checks, options=OPTIONS).select("rule_id", "affected_rows")


@register("rule_violations", with_views(["customer_dup"], union(
    [f"select customer_id, cast({i} as bigint) as rule_id from customer_dup where {t}" for i, t in _RULE_TESTS.items() if i != 13]
    + [f"select customer_id, cast(7 as bigint) from customer_dup where {miss('email')} and (select avg(case when {miss('email')} then 1.0 else 0.0 end) from customer_dup) > 0.05"]
    + [f"select customer_id, cast(12 as bigint) from (select *, count(*) over (partition by {_COLUMNS}) as k from customer_dup) where k > 1"])))
def rule_violations(spark, sf_dir):
    return rules.violations(view(spark, sf_dir, "customer_dup"), RULES, ["customer_id"], OPTIONS)


@register("rule_findings", with_views(["customer_dup"], f"""select rule_id, affected_rows from ({_SUMMARY}) where affected_rows > 0"""))
def rule_findings(spark, sf_dir):
    df = view(spark, sf_dir, "customer_dup")
    found = rules.rule_issues(rules.execute_rules(df, RULES, options=OPTIONS), RULES, df.columns)
    return found.select("rule_id", "affected_rows")


@register("rule_dry_run", """select 'failed' as outcome, count_if(l_quantity > 44) as affected_rows,
 round(round(cast(count_if(l_quantity > 44) as double) / count(*), 4) * 100, 2) as affected_percentage, count(*) as total_rows,
 least(25.0, round(round(cast(count_if(l_quantity > 44) as double) / count(*), 4) * 100 * 0.75, 1)) as estimated_score_impact from lineitem""")
def rule_dry_run(spark, sf_dir):
    rule = Rule(1, "Quantity", "numeric_range", "l_quantity", severity="high", parameters={"max": 44})
    return rules.dry_run(table(spark, sf_dir, "lineitem"), rule, OPTIONS).drop("message")


@register("rule_assignments", with_views(["assignments", "quality_rules"], """select a.dataset_id, r.id, r.name from quality_rules r
 join assignments a on a.rule_id = r.id where r.is_active and a.is_active"""))
def rule_assignments(spark, sf_dir):
    found = rules.assigned_rules(view(spark, sf_dir, "quality_rules"), view(spark, sf_dir, "assignments"))
    return found.select("dataset_id", "id", "name")


_CHOSEN = "select r.id as rule_id, d.id as dataset_id from quality_rules r cross join datasets d where r.id <= 2 and d.environment = 'staging'"


@register("rule_bulk_assign", with_views(["assignments"], f"""select coalesce(a.rule_id, c.rule_id) as rule_id, coalesce(a.dataset_id, c.dataset_id) as dataset_id,
 case when c.rule_id is not null then true else a.is_active end as is_active, (c.rule_id is not null and a.is_active is distinct from true) as changed
 from assignments a full outer join ({_CHOSEN}) c on a.rule_id = c.rule_id and a.dataset_id = c.dataset_id"""))
def rule_bulk_assign(spark, sf_dir):
    return rules.bulk_assign(
        view(spark, sf_dir, "assignments"), [1, 2], view(spark, sf_dir, "datasets").where("environment = 'staging'")
    )


@register("rule_bulk_unassign", with_views(["assignments"], f"""select a.rule_id, a.dataset_id, case when c.rule_id is not null then false else a.is_active end as is_active,
 (c.rule_id is not null and a.is_active) as changed from assignments a left join ({_CHOSEN}) c on a.rule_id = c.rule_id and a.dataset_id = c.dataset_id"""))
def rule_bulk_unassign(spark, sf_dir):
    return rules.bulk_assign(
        view(spark, sf_dir, "assignments"), [1, 2], view(spark, sf_dir, "datasets").where("environment = 'staging'"), "unassign",
    )


@register("rule_replace_executions", with_views(["executions"], """select audit_id, count(*) as runs, cast(sum(affected_rows) as bigint) as affected_rows from (
 select audit_id, affected_rows from executions where audit_id not in (select audit_id from executions where rule_id = 1 and affected_rows > 1)
 union all select audit_id, affected_rows + 1000 from executions where rule_id = 1 and affected_rows > 1) group by audit_id"""))
def rule_replace_executions(spark, sf_dir):
    stored = view(spark, sf_dir, "executions")
    fresh = stored.where("rule_id = 1 and affected_rows > 1").withColumn("affected_rows", F.expr("affected_rows + 1000"))
    merged = rules.replace_executions(stored, fresh)
    return merged.groupBy("audit_id").agg(F.expr("count(1) as runs"), F.expr("sum(affected_rows) as affected_rows"))


# --- remediation ---------------------------------------------------------------------
@register("remediate_dedupe", with_views(["customer_dirty"], f"""select email, customer_id, phone from (select *, row_number() over (partition by email order by cast(customer_id as int)) as rn
 from customer_dirty where email is not null) where rn = 1 union all select email, customer_id, phone from customer_dirty where email is null"""))
def remediate_dedupe(spark, sf_dir):
    df = view(spark, sf_dir, "customer_dirty").withColumn("place", F.expr("cast(customer_id as int)"))
    return remediate.deduplicate(df, ["email"], ["place"]).select("email", "customer_id", "phone")


@register("remediate_dedupe_nulls", with_views(["customer_dirty"], """select email, customer_id from (select *, row_number() over (partition by email order by cast(customer_id as int)) as rn
 from customer_dirty) where rn = 1"""))
def remediate_dedupe_nulls(spark, sf_dir):
    df = view(spark, sf_dir, "customer_dirty").withColumn("place", F.expr("cast(customer_id as int)"))
    return remediate.deduplicate(df, ["email"], ["place"], collapse_null_keys=True).select("email", "customer_id")


@register("remediate_dedupe_rows", "select text, lang, source from documents group by text, lang, source")
def remediate_dedupe_rows(spark, sf_dir):
    return remediate.deduplicate(table(spark, sf_dir, "documents").select("text", "lang", "source"))


def _mode(c: str) -> str:
    return f"(select {c} from customer_dirty where not {miss(c)} group by {c} order by count(*) desc, {c} limit 1)"


@register("remediate_fill_mode", with_views(["customer_dirty"], f"""select customer_id, case when {miss('full_name')} then {_mode('full_name')} else full_name end as full_name,
 case when {miss('email')} then {_mode('email')} else email end as email from customer_dirty"""))
def remediate_fill_mode(spark, sf_dir):
    filled = remediate.fill_missing(view(spark, sf_dir, "customer_dirty"), ["full_name", "email"])
    return filled.select("customer_id", "full_name", "email")


@register("remediate_fill_fixed", with_views(["customer_dirty", "orders_dirty"], f"""select customer_id as id, case when {miss('full_name')} then 'Not provided' else full_name end as full_name,
 cast(null as double) as total_amount from customer_dirty union all select cast(o_orderkey as varchar), null, coalesce(total_amount, 0) from orders_dirty"""))
def remediate_fill_fixed(spark, sf_dir):
    names = remediate.fill_missing(view(spark, sf_dir, "customer_dirty"), ["full_name"], "blank")
    amounts = remediate.fill_missing(view(spark, sf_dir, "orders_dirty"), ["total_amount"], "zero")
    return names.selectExpr("customer_id as id", "full_name", "cast(null as double) as total_amount").unionByName(
        amounts.selectExpr("cast(o_orderkey as string) as id", "cast(null as string) as full_name", "total_amount")
    )


_TITLE = "array_to_string(list_transform(regexp_extract_all(lower(trim({c})), '[a-z]+|[^a-z]+'), lambda x: upper(x[1]) || x[2:]), '')"


@register("remediate_standardize", with_views(["people"], f"select person_code, {_TITLE.format(c='status')} as status from people"))
def remediate_standardize(spark, sf_dir):
    return remediate.standardize(view(spark, sf_dir, "people"), ["status", "age"]).select("person_code", "status")


def _tok(c: str, start: int, size: int) -> str:
    return f"substr(sha256(trim({c})), {start}, {size})"


_IP = " || '.' || ".join(f"cast(cast('0x' || {_tok('host', s, 2)} as int) % 254 + 1 as varchar)" for s in (1, 3, 5, 7))


@register("remediate_mask", with_views(["customer_dirty"], f"""select
 case when {miss('full_name')} then full_name else 'Person ' || upper({_tok('full_name', 1, 8)}) end as full_name,
 case when {miss('email')} then email else 'user_' || {_tok('email', 1, 10)} || '@masked.example' end as email,
 case when {miss('phone')} then phone else '+254' || right(lpad(cast(cast('0x' || {_tok('phone', 1, 10)} as bigint) as varchar), 13, '0'), 9) end as phone,
 'ID-' || upper({_tok('customer_id', 1, 12)}) as customer_id,
 'TOKEN-' || upper({_tok('segment', 1, 12)}) as segment from customer_dirty"""))
def remediate_mask(spark, sf_dir):
    wanted = ["full_name", "email", "phone", "customer_id", "segment"]
    return remediate.mask(view(spark, sf_dir, "customer_dirty"), wanted).select(*wanted)


@register("remediate_mask_network", with_views(["people"], f"""select person_code, {_IP} as client_ip, 'ID-' || upper({_tok('card_number', 1, 12)}) as card_number from people"""))
def remediate_mask_network(spark, sf_dir):
    df = view(spark, sf_dir, "people").withColumnRenamed("host", "client_ip")
    return remediate.mask(df, ["client_ip", "card_number"]).select("person_code", "client_ip", "card_number")


@register("remediate_mask_collisions", with_views(["customer_dirty"], f"""select masked, count(*) as originals from (
 select distinct trim(phone) as p, '+254' || right(lpad(cast(cast('0x' || {_tok('phone', 1, 10)} as bigint) as varchar), 13, '0'), 9) as masked from customer_dirty)
 group by masked having count(*) > 1"""))
def remediate_mask_collisions(spark, sf_dir):
    return remediate.mask_collisions(view(spark, sf_dir, "customer_dirty"), "phone")


_LINE_PHONE = "concat('+', k, '-', l_orderkey * 10 + l_linenumber)"


@register("mask_collisions_lines", f"""select masked, count(*) as originals from (
 select distinct p, '+254' || right(lpad(cast(cast('0x' || substr(sha256(p), 1, 10) as bigint) as varchar), 13, '0'), 9) as masked from (select {_LINE_PHONE} as p from lineitem, range(1, 5) r(k)))
 group by masked having count(*) > 1""")
def mask_collisions_lines(spark, sf_dir):
    """Four phone numbers for each line: so many that some share a pseudonym of nine digits."""
    return remediate.mask_collisions(table(spark, sf_dir, "lineitem").selectExpr("*", "explode(sequence(1, 4)) as k").selectExpr(f"{_LINE_PHONE} as phone"), "phone")


_PLAN = [
    {"issue_id": "DQ-001", "title": "gaps", "action_type": "fill_missing", "columns": ["full_name", "email"]},
    {"issue_id": "DQ-002", "title": "casing", "action_type": "standardize", "columns": ["segment"]},
    {"issue_id": "DQ-003", "title": "copies", "action_type": "deduplicate", "columns": ["customer_id"]},
    {"issue_id": "DQ-004", "title": "ranges", "action_type": "validate", "columns": ["balance_amount"]},
]


@register("remediate_changes", with_views(["customer_dup"], f"""select 'DQ-001' as issue_id, 'full_name' as column_name, count_if({miss('full_name')}) as changed_cells from customer_dup
 union all select 'DQ-001', 'email', count_if({miss('email')}) from customer_dup
 union all select 'DQ-002', 'segment', count_if(segment is distinct from {_TITLE.format(c='segment')}) from customer_dup"""))
def remediate_changes(spark, sf_dir):
    done = remediate.remediate(view(spark, sf_dir, "customer_dup"), _PLAN, ["customer_id"])
    return done.changes().withColumnRenamed("column", "column_name")


@register("remediate_removed_rows", with_views(["customer_dup"], "select 'DQ-003' as issue_id, count(*) - count(distinct customer_id) as removed_rows from customer_dup"))
def remediate_removed_rows(spark, sf_dir):
    return remediate.remediate(view(spark, sf_dir, "customer_dup"), _PLAN, ["customer_id"]).removed_rows()


@register("remediate_sample", with_views(["customer_dirty"], f"""select customer_id, segment as before, {_TITLE.format(c='segment')} as after from customer_dirty
 where segment is distinct from {_TITLE.format(c='segment')} order by cast(customer_id as int) limit 20"""))
def remediate_sample(spark, sf_dir):
    df = view(spark, sf_dir, "customer_dirty").withColumn("place", F.expr("cast(customer_id as int)"))
    shown = remediate.remediate(df, _PLAN[1:2]).sample_changes(["place"])
    return shown.selectExpr("cast(row.place as string) as customer_id", "before", "after")


@register("remediate_plan", with_views(["issue_rows"], """select audit_id, id as issue_id, case category when 'completeness' then 'fill_missing' when 'integrity' then 'validate'
 when 'privacy' then 'mask' else 'review' end as action_type, case category when 'integrity' then 'high' when 'privacy' then 'high' else 'medium' end as risk,
 category in ('integrity', 'anomaly') as review_only from issue_rows"""))
def remediate_plan(spark, sf_dir):
    return remediate.plan_actions(issues(spark, sf_dir), ["audit_id"]).select("audit_id", "issue_id", "action_type", "risk", "review_only")


@register("remediate_preview", with_views(["customer_dup"], f"""select count(*) as rows_before, count(distinct customer_id) + count_if(customer_id is null) as rows_after from customer_dup"""))
def remediate_preview(spark, sf_dir):
    from dqspark.plans.audit import audit
    from dqspark.plans.clean import preview

    df = view(spark, sf_dir, "customer_dup")
    source = audit(df, options=OPTIONS)
    keys = [r["id"] for r in source.issues.where("category in ('uniqueness', 'consistency')").select("id").collect()]
    return preview(df, source, keys, options=OPTIONS).comparison(source).select("rows_before", "rows_after")


# --- contracts -------------------------------------------------------------------------
def _clause(c: str) -> str:
    m = f"count_if({miss(c)})"
    u = unique_of(c)
    return f"""select dataset, version, '{c}' as column_name, {m} = 0 as is_required, round(cast({u} as double) / count(*), 4) >= 0.98 and {m} = 0 as is_unique,
 nullif({inferred(c, c)}, 'empty') as expected_type,
 case when {inferred(c, c)} = 'text' and {u} between 2 and 20 then array_to_string(list_sort(list_distinct(list(trim({c})) filter (where not {miss(c)}))), '|') end as allowed
 from order_versions group by dataset, version"""


@register("contract_from_profile", with_views(["order_versions"], union([_clause(c) for c in ("order_key", "total", "remark", "state")])))
def contract_from_profile(spark, sf_dir):
    by = ["dataset", "version"]
    df = view(spark, sf_dir, "order_versions")
    made = contracts.contract_from_profile(profile.profile_columns(df, by, OPTIONS), profile.top_values(df, 21, by, sensitive=True), by)
    return made.selectExpr("*", "explode(array('order_key', 'total', 'remark', 'state')) as column_name").selectExpr(
        "dataset", "version", "column_name", "array_contains(required_columns, column_name) as is_required",
        "array_contains(unique_columns, column_name) as is_unique", "expected_types[column_name] as expected_type",
        "array_join(array_sort(allowed_values[column_name]), '|') as allowed",
    )


_CONTRACT_RULES = """select dataset, version, id, name, rule_type, column_name, severity, parameters from
 (select distinct dataset, version from order_versions) v cross join (
 select cast(1 as bigint) as id, 'Key present' as name, 'required' as rule_type, 'order_key' as column_name, 'high' as severity, '{}' as parameters union all
 select cast(2 as bigint), 'Total limits', 'numeric_range', 'total', 'high', '{"min": 0}' union all
 select cast(3 as bigint), 'States', 'allowed_values', 'state', 'low', '{"values": ["F", "O", "P"]}' union all
 select cast(4 as bigint), 'Gone', 'required', 'nowhere', 'low', '{}' union all
 select cast(5 as bigint), 'Total type', 'expected_type', 'total', 'low', '{"type": "text"}' union all
 select cast(6 as bigint), 'Total limits again', 'numeric_range', 'total', 'high', '{"min": 5, "max": 900000}') r"""


@register("contract_from_rules", with_views(["order_versions"], f"""select dataset, version, 'order_key' as required_columns, 'text' as total_type,
 cast(5 as double) as total_min, cast(900000 as double) as total_max, 'F,O,P' as states, cast(6 as int) as sources
 from order_versions group by dataset, version"""))
def contract_from_rules(spark, sf_dir):
    by = ["dataset", "version"]
    df = view(spark, sf_dir, "order_versions")
    df.createOrReplaceTempView("order_versions")
    assigned = spark.sql(_CONTRACT_RULES)
    made = contracts.contract_from_rules(assigned, profile.profile_columns(df, by, OPTIONS), by)
    return made.selectExpr(
        "dataset", "version", "array_join(required_columns, ',') as required_columns", "expected_types['total'] as total_type",
        "numeric_ranges['total'].min as total_min", "numeric_ranges['total'].max as total_max",
        "array_join(allowed_values['state'], ',') as states", "size(assigned_rules) as sources",
    )


# --- streams ---------------------------------------------------------------------------
STREAM_RULES = [
    Rule(1, "Value limit", "numeric_range", "value", parameters={"max": 50}),
    Rule(2, "Known type", "allowed_values", "event_type", parameters={"values": ["click", "view", "purchase"]}),
    Rule(3, "Small id", "length_range", "user_id", parameters={"max": 1}),
]
_STREAM_TESTS = {1: "value > 50", 2: "event_type not in ('click', 'view', 'purchase')", 3: "length(cast(user_id as varchar)) > 1"}


def _event_stream(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet")


def _folder(spark) -> str:
    import uuid

    from dqspark.session import shared_folder

    return f"{shared_folder(spark)}/streams-{uuid.uuid4().hex}"


@register("stream_rule_counts", union([f"select cast({i} as bigint) as rule_id, count_if({t}) as affected_rows from events" for i, t in _STREAM_TESTS.items()]))
def stream_rule_counts(spark, sf_dir):
    folder = _folder(spark)
    monitor.watch_rules(_event_stream(spark, sf_dir), STREAM_RULES, f"{folder}/counts", f"{folder}/state", OPTIONS).awaitTermination()
    return monitor.total_counts(spark.read.parquet(f"{folder}/counts"))


_WINDOWS = " union all ".join(
    f"""select cast(date_trunc('day', ts) as varchar) as window_start, cast({i} as bigint) as rule_id, count(*) as checked_rows, count_if({t}) as failed_rows from events group by 1"""
    for i, t in _STREAM_TESTS.items()
)


@register("window_failures", f"select strftime(cast(window_start as timestamp), '%Y-%m-%d') as day, rule_id, checked_rows, failed_rows from ({_WINDOWS})")
def window_failures(spark, sf_dir):
    found = monitor.windowed_failures(table(spark, sf_dir, "events"), STREAM_RULES, "ts", options=OPTIONS)
    return found.selectExpr("date_format(window_start, 'yyyy-MM-dd') as day", "rule_id", "rows as checked_rows", "failed_rows")


@register("stream_window_failures", f"select strftime(cast(window_start as timestamp), '%Y-%m-%d') as day, rule_id, checked_rows, failed_rows from ({_WINDOWS})")
def stream_window_failures(spark, sf_dir):
    """Windows that the watermark closed come from the stream, those still open from a last batch pass."""
    from dqspark.session import prepare

    prepare(spark)
    folder = _folder(spark)
    windows = monitor.windowed_failures(_event_stream(spark, sf_dir), STREAM_RULES, "ts", options=OPTIONS)
    monitor.write_windows(windows, f"{folder}/windows", f"{folder}/state").awaitTermination()
    written = spark.read.schema("window_start timestamp, rule_id long, rows long, failed_rows long, failure_rate double").parquet(f"{folder}/windows")
    found = written.unionByName(monitor.open_windows(table(spark, sf_dir, "events"), STREAM_RULES, "ts", written, options=OPTIONS))
    return found.selectExpr("date_format(window_start, 'yyyy-MM-dd') as day", "rule_id", "rows as checked_rows", "failed_rows")


@register("stream_violations", union([f"select event_id, cast({i} as bigint) as rule_id from events where {t}" for i, t in _STREAM_TESTS.items()]))
def stream_violations(spark, sf_dir):
    """Rows that break a rule, as the stream wrote them batch by batch."""
    folder = _folder(spark)
    monitor.watch_rules(_event_stream(spark, sf_dir), STREAM_RULES, f"{folder}/counts", f"{folder}/state", OPTIONS, key=["event_id"], violations_out=f"{folder}/violations").awaitTermination()
    return spark.read.parquet(f"{folder}/violations").select("event_id", "rule_id")
