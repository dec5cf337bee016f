"""Derived tables of the example workload, as SQL that Spark and DuckDB both run.

The given tables hold no defects, so defects are made from keys; audit history is made by
aggregating slices of ``orders``.  Every view reads whole tables.
"""

from __future__ import annotations

AS_OF = "2024-02-01 00:00:00"

VIEWS: dict[str, str] = {}

VIEWS["customer_dirty"] = """
select cast(c_custkey as varchar(20)) as customer_id,
 case when c_custkey % 11 = 0 then null when c_custkey % 13 = 0 then '  ' else c_name end as full_name,
 case when c_custkey % 10 = 0 then null when c_custkey % 17 = 0 then concat('user', c_custkey, '.example.com')
      else concat('user', c_custkey % 1400, '@example.com') end as email,
 case when c_custkey % 19 = 0 then 'bad-phone' else concat('+2547', cast(10000000 + c_custkey as varchar(20))) end as phone,
 case when c_custkey % 23 = 0 then lower(c_mktsegment) when c_custkey % 29 = 0 then 'UNKNOWN' else c_mktsegment end as segment,
 case when c_custkey % 31 = 0 then 'n/a' when c_custkey % 37 = 0 then '-5' when c_custkey % 41 = 0 then '100000'
      else cast(cast(c_acctbal as decimal(12,2)) as varchar(20)) end as balance_amount,
 case when c_custkey % 3 = 0 then 'Active' else 'Inactive' end as status
from customer"""

VIEWS["customer_dup"] = """
select * from customer_dirty union all
select * from customer_dirty where cast(customer_id as int) % 50 = 0"""

VIEWS["orders_dirty"] = """
select o_orderkey, o_custkey, o_orderpriority, o_orderdate as start_date,
 case when o_orderkey % 40 = 0 then o_orderdate - interval '3' day else o_orderdate + interval '5' day end as end_date,
 case when o_orderkey % 53 = 0 then null else o_totalprice end as total_amount
from orders"""

# Contacts with the columns the date, age, percentage and contact checks look for.
VIEWS["people"] = """
select cast(o_orderkey as varchar(20)) as person_code,
 case when o_orderkey % 4 = 0 then '' else concat('p', o_orderkey, '@example.org') end as email,
 case when o_orderkey % 6 = 0 then null else concat('07', cast(10000000 + o_orderkey as varchar(20))) end as phone,
 case when o_orderkey % 2 = 0 then 'active' when o_orderkey % 3 = 0 then ' Active ' else 'closed' end as status,
 case when o_orderkey % 97 = 0 then 150 when o_orderkey % 101 = 0 then -1 else cast(o_orderkey % 90 as int) end as age,
 case when o_orderkey % 89 = 0 then '120.5' when o_orderkey % 7 = 0 then null
      else cast(cast(o_orderkey % 100 as decimal(6,1)) as varchar(20)) end as discount_percent,
 case when o_orderkey % 83 = 0 then '1850-06-01' when o_orderkey % 79 = 0 then '2030-01-15'
      when o_orderkey % 5 = 0 then 'unknown' else '1985-03-09' end as birth_date,
 case when o_orderkey % 3 = 0 then '2019-12-31 08:30:00' when o_orderkey % 211 = 0 then '2031-05-05 00:00:00'
      else '2023-11-20 17:45:10' end as updated_at,
 case when o_orderkey % 2 = 0 then 'yes' else 'No' end as email_verified,
 concat('4', lpad(cast(o_orderkey as varchar(20)), 14, '0'), cast(o_custkey % 10 as varchar(2))) as card_number,
 concat(cast(10 + o_orderkey % 200 as varchar(5)), '.0.', cast(o_orderkey % 256 as varchar(5)), '.7') as host
from orders"""

# Yearly versions of order tables; in some a column is absent (all null), sparser or of another type.
VIEWS["order_versions"] = """
select concat('orders_', substr(o_orderpriority, 1, 1)) as dataset, cast(year(o_orderdate) - 1994 as int) as version,
 cast(o_orderkey as varchar(20)) as order_key,
 case when year(o_orderdate) = 1998 and o_orderpriority = '2-HIGH' and o_orderkey % 3 = 0 then 'unknown'
      when (year(o_orderdate) = 1997 or year(o_orderdate) = 2000) and o_orderkey % 4 = 0 then null
      else cast(cast(o_totalprice as decimal(12,2)) as varchar(20)) end as total,
 case when year(o_orderdate) = 1996 or year(o_orderdate) = 1999 then null else concat('note ', o_custkey % 7) end as remark,
 case when year(o_orderdate) = 1999 then concat(o_orderstatus, cast(o_custkey % 5 as varchar(5))) else o_orderstatus end as state
from orders"""

# One audit per customer group and quarter.
VIEWS["slices"] = """
select cast(floor(o_custkey / 100.0) as bigint) as ds, cast((year(o_orderdate) - 1995) * 4 + quarter(o_orderdate) as int) as v,
 count(*) as n, sum(case when o_orderkey % 53 = 0 then 1 else 0 end) as n_missing,
 sum(case when o_orderkey % 40 = 0 then 1 else 0 end) as n_late, sum(case when o_totalprice > 450000 then 1 else 0 end) as n_big,
 cast(sum(o_orderkey) % 61 as int) as luck, max(o_orderdate) as ended
from orders group by 1, 2"""

VIEWS["audits"] = """
select cast(ds % 2 + 1 as bigint) as workspace_id, concat('a-', ds, '-', v) as audit_id, concat('orders_', ds) as dataset_name,
 case when ds % 7 = 3 then null else v end as dataset_version,
 case when ds % 7 = 3 then null when v = 1 then 'dataset_import' else 'version_import' end as audit_kind,
 concat('orders_', ds, '_', cast(floor(v / (case when ds % 7 = 3 then 3.0 else 1.0 end)) as int), '.csv') as source,
 ended as created_at, cast(40 + luck as int) as score,
 case when 40 + luck < 60 then 'critical' when 40 + luck < 75 then 'high' when 40 + luck < 90 then 'medium' else 'low' end as risk_level,
 cast((case when n_missing > 0 then 1 else 0 end) + (case when n_late > 0 then 1 else 0 end) + (case when n_big > 0 then 1 else 0 end)
   + (case when v % 6 = 0 then 1 else 0 end) as bigint) as issue_count,
 cast(n as bigint) as row_count, cast(6 as bigint) as column_count,
 case when v % 8 = 0 then concat('a-', ds, '-', v - 1) else null end as source_audit_id
from slices
union all
select cast(ds % 2 + 1 as bigint), concat('r-', ds, '-', v), concat('orders_', ds), v, 'rerun', concat('orders_', ds, '_', v, '.csv'),
 ended + interval '1' hour, cast(40 + (luck + 7) % 61 as int), 'medium', cast(1 as bigint), cast(n as bigint), cast(6 as bigint), null
from slices where v % 5 = 0"""

_STATUS = """case (ds * 7 + v * 3 + {k}) % 9 when 0 then 'open' when 1 then 'in_progress' when 2 then 'resolved' when 3 then 'fixed'
 when 4 then 'accepted_risk' when 5 then 'ignored' when 6 then 'reopened' when 7 then 'triaged' else 'open' end"""

_RATE = "round(cast({part} as double) / n, 4)"


def _issue(k, test, category, severity, title, columns, rows, confidence, rule):
    return f"""select concat('a-', ds, '-', v) as audit_id, 'DQ-00{k}' as id, '{category}' as category, {severity} as severity,
 '{title}' as title, '{columns}' as column_list, cast({rows} as bigint) as affected_rows, {_RATE.format(part=rows)} as affected_rate,
 cast({confidence} as double) as confidence, {_STATUS.format(k=k)} as status, cast({rule} as bigint) as rule_id,
 'Advice {k}' as recommendation, case when (ds + v) % 4 = 0 then 'kept' else null end as resolution_note,
 case when (ds + v) % 5 = 0 then 'ticket' else null end as resolution_evidence, case when ds % 3 = 0 then 'ops' else null end as owner
from slices where {test}"""


VIEWS["issue_rows"] = " union all ".join([
    _issue(1, "n_missing > 0", "completeness", "case when n_missing * 20 >= n then 'medium' else 'low' end",
           "Missing values in total_amount", "total_amount", "n_missing", 0.98, "null"),
    _issue(2, "n_late > 0", "integrity", "'high'", "end_date is before start_date", "start_date,end_date", "n_late", 0.93, "2"),
    _issue(3, "n_big > 0", "anomaly", "'medium'", "Outliers detected in total_amount", "total_amount", "n_big", 0.82, "null"),
    _issue(4, "v % 6 = 0", "privacy", "'critical'", "Potential PII columns detected", "email,phone", "n", 0.966, "null"),
])

VIEWS["quality_rules"] = """
select cast(1 as bigint) as id, 'Amount present' as name, 'high' as severity, true as is_active union all
select cast(2 as bigint), 'Dates in order', 'critical', true union all
select cast(3 as bigint), 'Amount limit', 'low', true union all
select cast(4 as bigint), 'Old rule', 'low', false"""

VIEWS["executions"] = " union all ".join(
    f"""select concat('a-', ds, '-', v, '-{rule}') as execution_id, concat('a-', ds, '-', v) as audit_id, cast({rule} as bigint) as rule_id,
 case when {rows} > 0 then 'failed' else 'passed' end as outcome, cast({rows} as bigint) as affected_rows,
 {_RATE.format(part=rows)} as affected_rate, concat(cast({rows} as varchar(20)), ' rows broke rule {rule}') as message,
 ended + interval '{rule}' minute as executed_at
from slices where (ds + v + {rule}) % 13 <> 0"""
    for rule, rows in ((1, "n_missing"), (2, "n_late"), (3, "n_big"))
)

VIEWS["datasets"] = """
select ds as id, concat('orders_', ds) as name, case ds % 4 when 0 then 'Sales' when 1 then 'Finance' when 2 then '' else 'Risk' end as domain,
 case when ds % 3 = 0 then 'staging' else 'production' end as environment, cast(ds % 2 + 1 as bigint) as workspace_id, max(ended) as updated_at
from slices group by ds"""

VIEWS["assignments"] = """
select r.id as rule_id, d.id as dataset_id, (d.id + r.id) % 5 <> 0 as is_active
from quality_rules r cross join datasets d where (d.id + r.id) % 4 <> 0"""

VIEWS["contracts"] = """
select concat('c-', ds) as contract_key, cast(ds % 2 + 1 as bigint) as workspace_id, concat('orders_', ds) as dataset_name,
 concat('Contract ', ds) as name, cast(floor(v / 9.0) + 1 as bigint) as version,
 case when v = 1 then 'draft' else 'published' end as status, case when n_late > 0 then 'failed' else 'passed' end as validation_status,
 cast(n_late + n_missing as bigint) as violation_count, concat('a-', ds, '-', v) as source_audit_id, ended as updated_at
from slices where v % 9 = 1"""

VIEWS["runs"] = """
select concat('run-', ds, '-', v) as run_id, cast(ds % 2 + 1 as bigint) as workspace_id, concat('orders_', ds) as dataset_name,
 concat('a-', ds, '-', v) as audit_id, case when (ds + v) % 11 = 0 then 'failed' when (ds + v) % 17 = 0 then 'running' else 'completed' end as status,
 case when (ds + v) % 22 = 0 then 'source not reachable' else null end as error_message, ended as started_at,
 cast(n * 37 + v as bigint) as duration_ms
from slices"""

VIEWS["action_points"] = """
select concat('ap-', ds, '-', v) as id, case (ds + v) % 4 when 0 then 'open' when 1 then 'completed' when 2 then 'in_progress' else 'closed' end as status,
 case when v % 3 = 0 then 'critical' else 'normal' end as priority from slices"""

VIEWS["alert_actions"] = """
select workspace_id, concat('score:', audit_id, ':80') as fingerprint, action, acted_at, action_id from (
 select workspace_id, audit_id, 'read' as action, created_at + interval '1' day as acted_at, concat(audit_id, '-1') as action_id, score from audits
 union all
 select workspace_id, audit_id, case score % 5 when 0 then 'acknowledge' when 1 then 'resolve' when 2 then 'dismiss' when 3 then 'unread' else 'reopen' end,
  created_at + interval '2' day, concat(audit_id, '-2'), score from audits where score % 3 <> 0
 union all
 select workspace_id, audit_id, 'read', created_at + interval '3' day, concat(audit_id, '-3'), score from audits where score % 2 = 0
) t"""

VIEWS["issue_changes"] = """
select concat(audit_id, id, '-1') as change_id, audit_id, id as issue_id, case when affected_rows % 3 = 0 then 'apply' else 'update' end as kind,
 case when affected_rows % 3 = 0 then null when affected_rows % 3 = 1 then 'resolved' else 'reopened' end as status,
 case when affected_rows % 2 = 0 then 'team-b' else null end as owner, cast(null as varchar(20)) as severity,
 cast(null as varchar(20)) as resolution_note, cast(null as varchar(20)) as resolution_evidence, 'Ann' as actor_name,
 timestamp '2024-01-10 00:00:00' as changed_at from issue_rows
union all
select concat(audit_id, id, '-2'), audit_id, id, 'update', 'in_progress', null, 'low', 'looked at', null, 'Bo', timestamp '2024-01-11 00:00:00'
from issue_rows where affected_rows % 5 = 0
union all
select concat(audit_id, 'x', '-3'), audit_id, 'DQ-999', 'update', 'open', null, null, null, null, 'Bo', timestamp '2024-01-12 00:00:00'
from issue_rows where affected_rows % 7 = 0 and id = 'DQ-002'"""

NEEDS = {
    "customer_dup": ["customer_dirty"],
    "audits": ["slices"], "issue_rows": ["slices"], "executions": ["slices"], "datasets": ["slices"], "contracts": ["slices"],
    "runs": ["slices"], "action_points": ["slices"], "assignments": ["quality_rules", "datasets"],
    "alert_actions": ["audits"], "issue_changes": ["issue_rows"],
}


def _order(names: list[str]) -> list[str]:
    out: list[str] = []
    for name in names:
        for needed in [*_order(NEEDS.get(name, [])), name]:
            if needed not in out:
                out.append(needed)
    return out


def with_views(names: list[str], body: str) -> str:
    """``body`` with the named views in front of it."""
    parts = ", ".join(f"{name} as ({VIEWS[name]})" for name in _order(names))
    return f"with {parts} {body}"
