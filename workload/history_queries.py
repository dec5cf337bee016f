"""Scores, versions, drift, contracts, lifecycle, alerts and reports over audit history."""

from __future__ import annotations

from pyspark.sql import functions as F

from dqspark.operators import alerts, contracts, drift, lifecycle, profile, reports, score, versions
from dqspark.session import pin
from dqspark.sources import store

from .registry import inferred, miss, register, union, unique_of
from .tables import issues, view
from .views import AS_OF, with_views

OPTIONS = profile.Options(as_of=AS_OF)
SINCE = "2001-03-01 00:00:00"  # inside the audited period
INACTIVE = "('fixed', 'resolved', 'ignored')"
CLOSED = "('resolved', 'fixed', 'accepted', 'dismissed', 'closed', 'accepted_risk', 'ignored')"
RANK = "case severity when 'critical' then 4 when 'high' then 3 when 'medium' then 2 else 1 end"


# --- scores -----------------------------------------------------------------------------
def _costs(criticality: float = 1.0, discount: float = 0.25, multiplier: float = 1.1) -> str:
    return f"""(select audit_id, id as issue_id, severity, status, affected_rate,
 case category when 'completeness' then 'completeness' when 'validity' then 'validity' when 'consistency' then 'consistency'
   when 'uniqueness' then 'uniqueness' else 'reliability' end as dimension,
 (case severity when 'critical' then 24 when 'high' then 14 when 'medium' then 7 else 3 end) * (0.18::double + 0.82::double * sqrt(affected_rate)) as raw,
 (case severity when 'critical' then 24 when 'high' then 14 when 'medium' then 7 else 3 end) * (0.18::double + 0.82::double * sqrt(affected_rate))
  * (0.75::double + 0.25::double * confidence) * (case when rule_id is not null then {multiplier}::double else 1 end) * {criticality}::double
  * (case status when 'accepted_risk' then {discount}::double when 'in_progress' then 0.9::double else 1 end) as penalty
 from issue_rows where status not in {INACTIVE})"""


@register("score_deductions", with_views(["issue_rows"], f"""select audit_id, issue_id, dimension, severity, status, round(raw, 3) as raw_penalty,
 round(penalty, 3) as weighted_penalty from {_costs()}"""))
def score_deductions(spark, sf_dir):
    found = score.deductions(issues(spark, sf_dir), ["audit_id"])
    return found.select("audit_id", "issue_id", "dimension", "severity", "status", "raw_penalty", "weighted_penalty")


@register("score_top_deductions", with_views(["issue_rows"], f"""select audit_id, issue_id, place from (select audit_id, issue_id,
 cast(row_number() over (partition by audit_id order by round(penalty, 3) desc, issue_id) as int) as place from {_costs()}) where place <= 2"""))
def score_top_deductions(spark, sf_dir):
    costs = score.deductions(issues(spark, sf_dir), ["audit_id"])
    return score.top_deductions(costs, ["audit_id"], 2).select("audit_id", "issue_id", "place")


def _shapes(spark, sf_dir):
    found = view(spark, sf_dir, "audits")
    return found.selectExpr("audit_id", "(row_count % 10) / 100D as duplicate_row_rate")


def _score_sql(criticality: float = 1.0, **how) -> str:
    dims = {"completeness": 0.24, "validity": 0.22, "consistency": 0.16, "uniqueness": 0.16, "reliability": 0.22}
    parts = ", ".join(f"coalesce(sum(case when dimension = '{d}' then penalty else 0 end), 0) as {d}" for d in dims)
    dup = f"(case when r > 0 then least(15, 4 + 18 * sqrt(r)) * {criticality}::double else 0 end)"
    scored = ", ".join(
        f"cast(greatest(0, least(100, round_even(100 - (coalesce({d}, 0) + {dup if d == 'uniqueness' else '0'}), 0))) as bigint) as {d}" for d in dims
    )
    overall = " + ".join(f"{d} * {w}::double" for d, w in dims.items())
    return f"""select audit_id, cast(round_even({overall}, 0) as bigint) as overall, {', '.join(dims)}, active_issue_count from (
 select s.audit_id, {scored}, coalesce(k, 0) as active_issue_count from (select audit_id, (row_count % 10) / 100::double as r from audits) s
 left join (select audit_id, count(*) as k, {parts} from {_costs(criticality, **how)} group by audit_id) c on c.audit_id = s.audit_id)"""


@register("score_dimensions", with_views(["issue_rows", "audits"], _score_sql()))
def score_dimensions(spark, sf_dir):
    found = score.score(score.deductions(issues(spark, sf_dir), ["audit_id"]), _shapes(spark, sf_dir), ["audit_id"])
    return found.drop("accepted_risk_count", "total_weighted_penalty")


@register("score_recalculated", with_views(["issue_rows", "audits"], _score_sql(1.3, discount=0.5, multiplier=2.0)))
def score_recalculated(spark, sf_dir):
    context = score.ScoringContext("mission_critical", 0.5, 2.0)
    found = score.rescore(issues(spark, sf_dir), _shapes(spark, sf_dir), context, ["audit_id"])
    return found.drop("accepted_risk_count", "total_weighted_penalty")


@register("audit_summary", with_views(["issue_rows", "audits"], """select a.audit_id, a.score as overall, case when a.score < 60 or coalesce(c, 0) > 0 then 'critical'
 when a.score < 75 or coalesce(h, 0) > 0 then 'high' when a.score < 90 or coalesce(m, 0) > 0 then 'medium' else 'low' end as risk_level,
 coalesce(k, 0) as issue_count, coalesce(c, 0) as critical_issues, coalesce(p, 0) as privacy_issues from audits a left join (
 select audit_id, count(*) as k, count_if(severity = 'critical') as c, count_if(severity = 'high') as h, count_if(severity = 'medium') as m,
 count_if(category = 'privacy') as p from issue_rows group by audit_id) i on i.audit_id = a.audit_id"""))
def audit_summary(spark, sf_dir):
    scores = view(spark, sf_dir, "audits").selectExpr("audit_id", "score as overall")
    found = score.summary(issues(spark, sf_dir), scores, ["audit_id"])
    return found.select("audit_id", "overall", "risk_level", "issue_count", "critical_issues", "privacy_issues")


@register("ml_readiness", with_views(["issue_rows", "audits", "order_versions"], f"""select a.audit_id, greatest(0, a.score - least(60, coalesce(b, 0) * 15 + coalesce(w, 0) * 4 + 2)) as score,
 coalesce(b, 0) as blockers, coalesce(w, 0) as warnings,
 case when greatest(0, a.score - least(60, coalesce(b, 0) * 15 + coalesce(w, 0) * 4 + 2)) < 50 or coalesce(b, 0) > 0 then 'critical'
  when greatest(0, a.score - least(60, coalesce(w, 0) * 4 + 2)) < 70 then 'high' when greatest(0, a.score - least(60, coalesce(w, 0) * 4 + 2)) < 85 then 'medium' else 'low' end as risk_level
 from audits a left join (select audit_id, count_if(category = 'privacy') as b, count_if(category in ('anomaly', 'completeness')) as w from issue_rows group by audit_id) i
 on i.audit_id = a.audit_id"""))
def ml_readiness(spark, sf_dir):
    audits = view(spark, sf_dir, "audits")
    columns = audits.selectExpr(
        "audit_id", "inline(array(struct('user_id' as column, 0D as missing_rate, 0.5D as unique_rate, 'text' as inferred_type),"
        " struct('amount' as column, 0.3D as missing_rate, 1D as unique_rate, 'numeric' as inferred_type)))"
    )
    found = score.readiness(issues(spark, sf_dir), columns, audits.selectExpr("audit_id", "score as overall"), ["audit_id"])
    return found.select("audit_id", "score", "blockers", "warnings", "risk_level")


@register("top_issues", with_views(["issue_rows"], f"""select audit_id, id, place from (select audit_id, id,
 cast(row_number() over (partition by audit_id order by {RANK} desc, affected_rate desc, confidence desc, id) as int) as place from issue_rows) where place <= 2"""))
def top_issues(spark, sf_dir):
    return score.top_issues(issues(spark, sf_dir), ["audit_id"], 2).select("audit_id", "id", "place")


@register("top_issues_by_rows", with_views(["issue_rows"], f"""select audit_id, id, place from (select audit_id, id,
 cast(row_number() over (partition by audit_id order by {RANK} desc, affected_rows desc, id) as int) as place from issue_rows) where place <= 1"""))
def top_issues_by_rows(spark, sf_dir):
    return score.top_issues(issues(spark, sf_dir), ["audit_id"], 1, "rows").select("audit_id", "id", "place")


@register("issues_by_column", with_views(["issue_rows"], "select audit_id, id from issue_rows where list_contains(string_split(column_list, ','), 'end_date')"))
def issues_by_column(spark, sf_dir):
    return score.issues_about(issues(spark, sf_dir), "end_date").select("audit_id", "id")


# --- versions -----------------------------------------------------------------------------
# Explicit groups carry one version per quarter; legacy groups (ds % 7 = 3) start one when the file changes.
_LINEAGE = """(select dataset_name, audit_id, created_at, source, row_number() over (partition by dataset_name order by created_at) as version from (
 select *, lag(source) over (partition by dataset_name order by created_at) as last_source from audits where audit_kind is distinct from 'rerun')
 where audit_kind is not null or source is distinct from last_source)"""


@register("version_lineage", with_views(["audits"], f"select dataset_name, audit_id, version from {_LINEAGE}"))
def version_lineage(spark, sf_dir):
    return versions.lineage(view(spark, sf_dir, "audits")).selectExpr("dataset_name", "audit_id", "cast(version as bigint) as version")


@register("version_current", with_views(["audits"], f"select dataset_name, count(*) as current_version from {_LINEAGE} group by dataset_name"))
def version_current(spark, sf_dir):
    return versions.current_version(view(spark, sf_dir, "audits"))


@register("version_list", with_views(["audits"], f"""select v.dataset_name, v.version, v.audit_id, a.score, a.row_count,
 v.version = max(v.version) over (partition by v.dataset_name) as is_latest from {_LINEAGE} v join audits a on a.audit_id = v.audit_id"""))
def version_list(spark, sf_dir):
    audits = view(spark, sf_dir, "audits")
    found = versions.version_list(audits, audits.select("audit_id", "row_count", "column_count"))
    return found.selectExpr("dataset_name", "cast(version as bigint) as version", "audit_id", "score", "row_count", "is_latest")


_PAIRS = f"""(select * from (select lag(audit_id) over (partition by dataset_name order by version) as b, audit_id as c from {_LINEAGE}) where b is not null)"""


@register("compare_totals", with_views(["audits"], f"""select p.b as baseline_audit_id, p.c as candidate_audit_id, y.score - x.score as score_delta,
 y.issue_count - x.issue_count as issue_count_delta, y.row_count - x.row_count as row_count_delta, y.column_count - x.column_count as column_count_delta
 from {_PAIRS} p join audits x on x.audit_id = p.b join audits y on y.audit_id = p.c"""))
def compare_totals(spark, sf_dir):
    audits = view(spark, sf_dir, "audits")
    return versions.compare_totals(versions.audit_pairs(audits), audits)


@register("compare_issues", with_views(["audits", "issue_rows"], f"""select coalesce(o.b, n.b) as baseline_audit_id, coalesce(o.c, n.c) as candidate_audit_id,
 coalesce(o.title, n.title) as title, case when o.title is null then 'new' when n.title is null then 'resolved' else 'persistent' end as change
 from (select p.b, p.c, i.title, i.column_list from {_PAIRS} p join issue_rows i on i.audit_id = p.b) o
 full outer join (select p.b, p.c, i.title, i.column_list from {_PAIRS} p join issue_rows i on i.audit_id = p.c) n
 on o.b = n.b and o.c = n.c and o.title = n.title and o.column_list = n.column_list"""))
def compare_issues(spark, sf_dir):
    pairs = versions.audit_pairs(view(spark, sf_dir, "audits"))
    found = versions.compare_issues(pairs, issues(spark, sf_dir))
    return found.select("baseline_audit_id", "candidate_audit_id", "title", "change")


def _version_profiles(spark, sf_dir):
    """Profiles of the yearly order versions; a column that is all null is absent."""
    found = profile.schema_profile(view(spark, sf_dir, "order_versions"), ["dataset", "version"], OPTIONS)
    return found.where("inferred_type <> 'empty'").select("dataset", "version", "column", "inferred_type", "missing_rate", "unique_count")


_PROFILES = "(" + union([
    f"""select * from (select dataset, version, '{c}' as col, {inferred(c, c)} as kind, round(cast(count_if({miss(c)}) as double) / count(*), 4) as gaps,
 {unique_of(c)} as kinds from order_versions group by dataset, version) where kind <> 'empty'""" for c in ("order_key", "total", "remark", "state")]) + ")"


@register("compare_columns", with_views(["order_versions"], f"""select * from (with p as (select * from {_PROFILES}), s as (select dataset, version, lag(version) over (partition by dataset order by version) as prior
  from (select distinct dataset, version from p)), pr as (select dataset, prior, version from s where prior is not null),
 o as (select pr.dataset, pr.prior, pr.version, p.col, p.kind, p.gaps from pr join p on p.dataset = pr.dataset and p.version = pr.prior),
 n as (select pr.dataset, pr.prior, pr.version, p.col, p.kind, p.gaps from pr join p on p.dataset = pr.dataset and p.version = pr.version)
 select coalesce(o.dataset, n.dataset) as dataset, coalesce(o.version, n.version) as version, coalesce(o.col, n.col) as column_name,
 case when o.col is null then 'added' when n.col is null then 'removed' else 'shared' end as presence,
 case when o.col is null or n.col is null then null when n.gaps > o.gaps then 'worsened' when n.gaps < o.gaps then 'improved' else 'same' end as completeness,
 o.kind as type_before, n.kind as type_after, o.col is not null and n.col is not null and o.kind <> n.kind as type_changed
 from o full outer join n on o.dataset = n.dataset and o.version = n.version and o.col = n.col)"""))
def compare_columns(spark, sf_dir):
    """Every version of every dataset against the one before it."""
    found = _version_profiles(spark, sf_dir).withColumn("audit_id", F.expr("concat(dataset, '/', version)"))
    pairs = found.select("dataset", "version", "audit_id").distinct().selectExpr(
        "lag(audit_id) over (partition by dataset order by version) as baseline_audit_id", "audit_id as candidate_audit_id"
    ).where("baseline_audit_id is not null")
    return versions.compare_columns(pairs, found).selectExpr(
        "split(candidate_audit_id, '/')[0] as dataset", "cast(split(candidate_audit_id, '/')[1] as int) as version",
        "column as column_name", "presence", "completeness", "type_before", "type_after", "type_changed"
    )


# --- drift ------------------------------------------------------------------------------------
_DRIFT = f"""(with p as (select * from {_PROFILES}), s as (select dataset, version, row_number() over (partition by dataset order by version) as i
  from (select distinct dataset, version from p)),
 pr as (select a.dataset, a.version as b, n.version as c, n.i from s a join s n on n.dataset = a.dataset and n.i = a.i + 1),
 j as (select coalesce(x.dataset, y.dataset) as dataset, coalesce(x.b, y.b) as b, coalesce(x.c, y.c) as c, coalesce(x.i, y.i) as i, coalesce(x.col, y.col) as col,
  x.col is null as added, y.col is null as removed, x.kind as k0, y.kind as k1, x.gaps as g0, y.gaps as g1, x.kinds as u0, y.kinds as u1
  from (select pr.*, p.col, p.kind, p.gaps, p.kinds from pr join p on p.dataset = pr.dataset and p.version = pr.b) x
  full outer join (select pr.*, p.col, p.kind, p.gaps, p.kinds from pr join p on p.dataset = pr.dataset and p.version = pr.c) y
  on x.dataset = y.dataset and x.i = y.i and x.col = y.col),
 e as (
  select dataset, b, c, i, 'type_changed' as t, col as subject, 78 as impact from j where not added and not removed and k0 <> k1
  union all select dataset, b, c, i, 'nullability_changed', col, least(90, cast(trunc(25 + abs(g1 - g0) * 100) as int)) from j where not added and not removed and abs(g1 - g0) >= 0.1::double
  union all select dataset, b, c, i, 'cardinality_shift', col, least(85, cast(trunc(20 + abs(u1 - u0)::double / u0 * 55) as int)) from j
    where not added and not removed and u0 > 0 and u1 > 0 and abs(u1 - u0)::double / u0 >= 0.3::double
  union all select dataset, b, c, i, 'column_added', string_agg(col, ',' order by col), least(96, 40 + 14 * count(*)) from j where added group by dataset, b, c, i
  union all select dataset, b, c, i, 'column_removed', string_agg(col, ',' order by col), least(100, 55 + 15 * count(*)) from j where removed group by dataset, b, c, i)
 select dataset, b as baseline, c as candidate, t as drift_type, subject, cast(impact as bigint) as impact_score,
  case when impact >= 70 then 'high' when impact >= 35 then 'medium' else 'low' end as severity,
  case when i = (select max(i) from s where s.dataset = e.dataset) then
    case when exists (select 1 from e f where f.dataset = e.dataset and f.t = e.t and f.subject = e.subject and f.i = e.i - 1) then 'persistent' else 'new' end
   when exists (select 1 from e f where f.dataset = e.dataset and f.t = e.t and f.subject = e.subject and f.i > e.i) then 'persistent' else 'resolved' end as status from e)"""


def _drift(spark, sf_dir):
    return drift.drift_events(_version_profiles(spark, sf_dir))


@register("drift_events", with_views(["order_versions"], f"select * from {_DRIFT}"))
def drift_events(spark, sf_dir):
    return _drift(spark, sf_dir).select("dataset", "baseline", "candidate", "drift_type", "subject", "impact_score", "severity", "status")


@register("drift_summary", with_views(["order_versions"], f"""select count(*) as total, count_if(severity = 'high') as high, count_if(severity = 'medium') as medium,
 count_if(severity = 'low') as low, cast(round_even(avg(impact_score), 0) as bigint) as average_impact from {_DRIFT}"""))
def drift_summary(spark, sf_dir):
    return drift.drift_summary(_drift(spark, sf_dir))


@register("drift_counts", with_views(["order_versions"], f"select drift_type, count(*) as events from {_DRIFT} group by drift_type"))
def drift_counts(spark, sf_dir):
    return drift.drift_counts(_drift(spark, sf_dir))


@register("drift_listing", with_views(["order_versions"], f"select dataset, candidate, drift_type, subject from {_DRIFT} where severity = 'high' and status = 'resolved' and contains(lower(dataset), 'orders_')"))
def drift_listing(spark, sf_dir):
    found = drift.drift_listing(_drift(spark, sf_dir), severity="high", status="resolved", search="Orders_")
    return found.select("dataset", "candidate", "drift_type", "subject")


@register("drift_trend", with_views(["order_versions"], f"select concat(candidate + 2000, '-01-01') as day, count(*) as events from {_DRIFT} group by candidate"))
def drift_trend(spark, sf_dir):
    dated = view(spark, sf_dir, "order_versions").selectExpr(
        "dataset", "version", "make_timestamp(2000 + version, 1, 1, 0, 0, 0) as detected_at").distinct()
    return drift.drift_trend(_drift(spark, sf_dir), dated).selectExpr("cast(day as string) as day", "events")


# --- contracts over history ------------------------------------------------------------------------
def _contract_rows(spark, sf_dir):
    return view(spark, sf_dir, "datasets").selectExpr(
        "name as dataset_name", "array('total_amount', 'region', 'start_date') as required_columns",
        "map('total_amount', 'numeric', 'start_date', 'text', 'nowhere', 'text') as expected_types",
        "cast(map() as map<string,array<string>>) as allowed_values",
        "map('total_amount', struct(cast(null as double) as min, 450000D as max)) as numeric_ranges",
        "array(struct(1L as rule_id, 'Amount present' as name, 'required' as rule_type, 'total_amount' as column),"
        " struct(2L as rule_id, 'Dates in order' as name, 'expected_type' as rule_type, 'end_date' as column),"
        " struct(3L as rule_id, 'Amount limit' as name, 'numeric_range' as rule_type, 'total_amount' as column)) as assigned_rules",
    )


def _history_profiles(spark, sf_dir):
    return view(spark, sf_dir, "audits").selectExpr(
        "audit_id", "inline(array(struct('total_amount' as column, 'numeric' as inferred_type), struct('start_date' as column, 'datetime' as inferred_type)))"
    )


_CHOSEN = """(select * from (select *, row_number() over (partition by dataset_name order by coalesce(dataset_version, -1) desc, created_at desc, audit_id desc) as rn
 from audits) where rn = 1)"""
_SCHEMA_BROKEN = f"""(select dataset_name, audit_id, 'required_column' as kind, 'region' as column_name, 'missing' as observed, row_count as affected_rows from {_CHOSEN}
 union all select dataset_name, audit_id, 'expected_type', 'start_date', 'datetime', row_count from {_CHOSEN})"""
_RULE_BROKEN = f"""(select a.dataset_name, a.audit_id, case when e.rule_id is null then 'rule_not_executed' else 'assigned_rule' end as kind, r.id as rule_id,
 case when e.rule_id is null then case r.id when 1 then 'required' when 2 then 'expected_type' else 'numeric_range' end
  else case r.id when 1 then 'value present' when 2 then 'expected_type' else '<= 450000.0' end end as expected,
 case when e.rule_id is null then 'not executed' else concat(e.affected_rows, ' affected row(s)') end as observed, coalesce(e.affected_rows, 0) as affected_rows
 from {_CHOSEN} a cross join (select id from quality_rules where id <= 3) r left join executions e on e.audit_id = a.audit_id and e.rule_id = r.id
 where e.rule_id is null or e.outcome = 'failed')"""


@register("contract_schema_violations", with_views(["audits"], f"select * from {_SCHEMA_BROKEN}"))
def contract_schema_violations(spark, sf_dir):
    chosen = contracts.audit_to_validate(view(spark, sf_dir, "audits"))
    found = contracts.schema_violations(_contract_rows(spark, sf_dir), chosen, _history_profiles(spark, sf_dir))
    return found.selectExpr("dataset_name", "audit_id", "kind", "column as column_name", "observed", "affected_rows")


@register("contract_rule_violations", with_views(["audits", "executions", "quality_rules"], f"select * from {_RULE_BROKEN}"))
def contract_rule_violations(spark, sf_dir):
    chosen = contracts.audit_to_validate(view(spark, sf_dir, "audits"))
    found = contracts.rule_violations(_contract_rows(spark, sf_dir), chosen, view(spark, sf_dir, "executions"))
    return found.select("dataset_name", "audit_id", "kind", "rule_id", "expected", "observed", "affected_rows")


@register("contract_validation", with_views(["audits", "executions", "quality_rules"], f"""select a.dataset_name, a.audit_id, 2 + coalesce(k, 0) as violation_count,
 cast(1 as bigint) as missing_columns, cast(1 as bigint) as type_mismatches, coalesce(k, 0) as rule_violations, 'failed' as validation_status
 from {_CHOSEN} a left join (select dataset_name, count(*) as k from {_RULE_BROKEN} group by dataset_name) r on r.dataset_name = a.dataset_name"""))
def contract_validation(spark, sf_dir):
    found = contracts.validate(
        _contract_rows(spark, sf_dir), view(spark, sf_dir, "audits"), _history_profiles(spark, sf_dir), view(spark, sf_dir, "executions")
    )
    return found.drop("dataset_version")


@register("contract_versions", with_views(["contracts"], """select dataset_name, max(version) + 2 as version, 'archived' as status, arg_max(name, version) as name from contracts group by dataset_name"""))
def contract_versions(spark, sf_dir):
    stored = view(spark, sf_dir, "contracts").selectExpr("dataset_name", "version", "name", "status", "'{}' as contract_json", "updated_at as created_at")
    changes = stored.select("dataset_name").distinct().selectExpr(
        "dataset_name", "cast(null as string) as name", "cast(null as string) as contract_json",
        "inline(array(struct('published' as status, timestamp'2024-01-01' as changed_at), struct('archived' as status, timestamp'2024-01-02' as changed_at)))",
    )
    return contracts.latest_versions(contracts.append_versions(stored, changes)).select("dataset_name", "version", "status", "name")


# --- lifecycle -------------------------------------------------------------------------------------
def _judged(spark, sf_dir):
    return lifecycle.judge_changes(issues(spark, sf_dir), view(spark, sf_dir, "issue_changes"))


_WHO = "partition by audit_id, issue_id order by changed_at, change_id"
_BEFORE = f"over ({_WHO} rows between unbounded preceding and 1 preceding)"
_VERDICT = f"""(with a as (
 select c.*, i.category, i.status as old_status, i.recommendation, i.id is not null as known, i.owner as old_owner, i.severity as old_severity, i.resolution_note as old_note,
  i.resolution_evidence as old_proof from issue_changes c left join issue_rows i on i.audit_id = c.audit_id and i.id = c.issue_id),
 b as (select *, coalesce(last_value(resolution_note ignore nulls) over ({_WHO}), old_note) as note_now from a),
 c as (select *, kind = 'update' and (status is null or status not in ('resolved', 'fixed') or note_now is not null) as sound from b),
 d as (select *, coalesce(last_value(case when sound then resolution_evidence end ignore nulls) over ({_WHO}), old_proof) as proof_now,
  coalesce(last_value(case when sound then status end ignore nulls) {_BEFORE}, old_status) as s1 from c),
 e as (select *, case when category = 'privacy' then kind = 'apply' and note_now is not null and proof_now is not null
  else bool_or(kind = 'apply' and s1 <> 'fixed') over ({_WHO}) end as gate from d),
 f as (select *, sound or (kind = 'update' and category <> 'privacy' and gate) as fine from e),
 g as (select *, coalesce(last_value(case when kind = 'apply' and gate then 'fixed' when kind = 'update' and fine then status end ignore nulls) {_BEFORE}, old_status) as status_then from f)
 select *, case when not known then 'unknown issue' when kind = 'apply' and status_then = 'fixed' then 'already applied'
  when kind = 'apply' and category = 'privacy' and not gate then 'privacy control needs a note and evidence'
  when kind = 'update' and not fine then 'a resolution note is required' end as rejected from g)"""


@register("lifecycle_rejected", with_views(["issue_changes"], f"select change_id, audit_id, issue_id, rejected from {_VERDICT} where rejected is not null"))
def lifecycle_rejected(spark, sf_dir):
    return lifecycle.rejected_changes(_judged(spark, sf_dir))


# Every change of an issue in turn, from the state before it: an independent fold.
_FOLD = """with recursive n as (select c.*, i.category, i.recommendation, row_number() over (partition by c.audit_id, c.issue_id order by changed_at, change_id) as k
  from issue_changes c join issue_rows i on i.audit_id = c.audit_id and i.id = c.issue_id),
 s as (select audit_id, id, 0 as k, status as st, owner as ow, severity as sev, resolution_note as note, resolution_evidence as ev, false as applied,
   false as ok, false as reopened, cast(null as varchar) as kind, cast(null as varchar) as p_st, cast(null as varchar) as p_ow, cast(null as varchar) as p_sev,
   cast(null as varchar) as p_note, cast(null as varchar) as p_ev, cast(null as varchar) as set_st from issue_rows
  union all
  select audit_id, id, k, case when not ok then st when kind = 'apply' then 'fixed' when reopened then 'open' else coalesce(new_st, st) end,
   case when not ok then ow when kind = 'apply' then actor_name else coalesce(new_ow, ow) end, case when ok and kind = 'update' then coalesce(new_sev, sev) else sev end,
   case when not ok then note when kind = 'update' then coalesce(new_note, note) when category = 'privacy' then note else 'Applied recommendation: ' || recommendation end,
   case when ok and kind = 'update' then coalesce(new_ev, ev) else ev end, applied or (ok and kind = 'apply'), ok, reopened, kind, st, ow, sev, note, ev,
   case when kind = 'apply' then 'fixed' when new_st is not null then new_st when reopened then 'reopened' else st end
  from (select *, ok and kind = 'update' and coalesce(new_st, new_ow, new_sev, new_note, new_ev) is not null and coalesce(new_st, st) = 'reopened' as reopened from (
   select s.audit_id, s.id, n.k, s.st, s.ow, s.sev, s.note, s.ev, s.applied, n.kind, n.category, n.recommendation, n.actor_name, n.status as new_st, n.owner as new_ow,
    n.severity as new_sev, n.resolution_note as new_note, n.resolution_evidence as new_ev,
    case when n.kind = 'apply' then s.st <> 'fixed' and (n.category <> 'privacy' or (s.note is not null and s.ev is not null))
     else coalesce(n.status, '') not in ('resolved', 'fixed') or coalesce(n.resolution_note, s.note) is not null end as ok
   from s join n on n.audit_id = s.audit_id and n.issue_id = s.id and n.k = s.k + 1)))"""


@register("lifecycle_activities", with_views(["issue_changes"], f"""select * from ({_FOLD} select action, field_name, previous_value, new_value, count(*) as n from (
 select 'recommendation_applied' as action, 'status' as field_name, 'open' as previous_value, 'fixed' as new_value from s where ok and kind = 'apply'
 union all select 'reopened', 'status', null, 'open' from s where reopened
 union all select 'field_updated', 'status', p_st, set_st from s where ok and kind = 'update' and set_st is distinct from p_st
 union all select 'field_updated', 'owner', p_ow, ow from s where ok and kind = 'update' and ow is distinct from p_ow
 union all select 'field_updated', 'severity', p_sev, sev from s where ok and kind = 'update' and sev is distinct from p_sev
 union all select 'field_updated', 'resolution_note', p_note, note from s where ok and kind = 'update' and note is distinct from p_note
 union all select 'field_updated', 'resolution_evidence', p_ev, ev from s where ok and kind = 'update' and ev is distinct from p_ev
 ) group by all)"""))
def lifecycle_activities(spark, sf_dir):
    history = lifecycle.activity_history(lifecycle.change_activities(_judged(spark, sf_dir)))
    return history.groupBy("action", "field_name", "previous_value", "new_value").count().withColumnRenamed("count", "n")


@register("lifecycle_state", with_views(["issue_changes"], f"""select * from ({_FOLD} select s.audit_id, s.id, s.st as status, s.sev as severity, s.ow as owner, s.note as resolution_note,
 s.ev as resolution_evidence, case when s.applied then 0 else i.affected_rows end as affected_rows
 from s join (select audit_id, id, max(k) as k from s group by 1, 2) m on m.audit_id = s.audit_id and m.id = s.id and m.k = s.k
 join issue_rows i on i.audit_id = s.audit_id and i.id = s.id)"""))
def lifecycle_state(spark, sf_dir):
    found = lifecycle.current_issues(issues(spark, sf_dir), _judged(spark, sf_dir))
    return found.select("audit_id", "id", "status", "severity", "owner", "resolution_note", "resolution_evidence", "affected_rows")


# --- alerts ---------------------------------------------------------------------------------------------
_NEWEST = "(select * from (select *, row_number() over (partition by workspace_id, dataset_name order by created_at desc, audit_id desc) as rn from audits) where rn = 1)"
_SCORE = f"(select workspace_id, concat('score:', audit_id, ':80') as fingerprint, 'score_threshold' as alert_type, case when score < 65 then 'critical' else 'high' end as severity, dataset_name, audit_id from {_NEWEST} where score < 80)"
_ISSUE = f"""(select a.workspace_id, concat('issues:', a.audit_id) as fingerprint, 'high_severity_issue' as alert_type, case when bool_or(i.severity = 'critical') then 'critical' else 'high' end as severity,
 a.dataset_name, a.audit_id from {_NEWEST} a join issue_rows i on i.audit_id = a.audit_id where i.severity in ('critical', 'high') and i.status <> 'resolved' group by a.workspace_id, a.audit_id, a.dataset_name)"""
_RULE = """(select a.workspace_id, concat('rule:', e.execution_id) as fingerprint, 'rule_failure' as alert_type, coalesce(r.severity, 'medium') as severity, a.dataset_name, e.audit_id
 from executions e join audits a on a.audit_id = e.audit_id left join quality_rules r on r.id = e.rule_id where e.outcome = 'failed')"""
_CONTRACT = "(select workspace_id, concat('contract:', contract_key, ':', version) as fingerprint, 'contract_violation' as alert_type, 'high' as severity, dataset_name, source_audit_id as audit_id from contracts where validation_status = 'failed')"
_RUN = "(select workspace_id, concat('schedule:', run_id) as fingerprint, 'scheduled_audit_failure' as alert_type, 'critical' as severity, dataset_name, audit_id from runs where status = 'failed')"
_SHAPE = ["workspace_id", "fingerprint", "alert_type", "severity", "dataset_name", "audit_id"]
_HISTORY = ["audits", "issue_rows", "executions", "contracts", "runs", "quality_rules"]


@register("alerts_score", with_views(["audits"], f"select * from {_SCORE}"))
def alerts_score(spark, sf_dir):
    return alerts.score_alerts(view(spark, sf_dir, "audits")).select(*_SHAPE)


@register("alerts_issues", with_views(["audits", "issue_rows"], f"select * from {_ISSUE}"))
def alerts_issues(spark, sf_dir):
    return alerts.issue_alerts(view(spark, sf_dir, "audits"), issues(spark, sf_dir)).select(*_SHAPE)


@register("alerts_rules", with_views(["audits", "executions", "quality_rules"], f"select * from {_RULE}"))
def alerts_rules(spark, sf_dir):
    found = alerts.rule_alerts(view(spark, sf_dir, "executions"), view(spark, sf_dir, "audits"), view(spark, sf_dir, "quality_rules"))
    return found.select(*_SHAPE)


@register("alerts_contracts", with_views(["contracts"], f"select * from {_CONTRACT}"))
def alerts_contracts(spark, sf_dir):
    return alerts.contract_alerts(view(spark, sf_dir, "contracts")).select(*_SHAPE)


@register("alerts_runs", with_views(["runs"], f"select * from {_RUN}"))
def alerts_runs(spark, sf_dir):
    return alerts.run_alerts(view(spark, sf_dir, "runs")).select(*_SHAPE)


@register("alerts_drift", with_views(["order_versions"], f"""select cast(1 as bigint) as workspace_id, concat('drift:', dataset, ':', candidate, ':', drift_type, ':', subject) as fingerprint,
 'schema_drift' as alert_type, severity, dataset as dataset_name, concat(dataset, '/', candidate) as audit_id from {_DRIFT} where status <> 'resolved'"""))
def alerts_drift(spark, sf_dir):
    dated = view(spark, sf_dir, "order_versions").selectExpr(
        "1L as workspace_id", "dataset", "version", "concat(dataset, '/', version) as audit_id", "make_timestamp(2000 + version, 1, 1, 0, 0, 0) as detected_at").distinct()
    return alerts.drift_alerts(_drift(spark, sf_dir), dated).select(*_SHAPE)


def _found_alerts(spark, sf_dir):
    audits = pin(view(spark, sf_dir, "audits"))
    newest = pin(alerts.latest_audits(audits))
    return alerts.all_alerts(
        alerts.score_alerts(audits, newest=newest), alerts.issue_alerts(audits, issues(spark, sf_dir), newest),
        alerts.rule_alerts(view(spark, sf_dir, "executions"), audits, view(spark, sf_dir, "quality_rules")),
        alerts.contract_alerts(view(spark, sf_dir, "contracts")), alerts.run_alerts(view(spark, sf_dir, "runs")),
    )


_FOUND = f"({' union all '.join('select * from ' + part for part in (_SCORE, _ISSUE, _RULE, _CONTRACT, _RUN))})"
# Stored before: run alerts (older severity, acknowledged) and some audits' score alerts that are no longer raised.
_STORED = """(select workspace_id, concat('schedule:', run_id) as fingerprint, 'scheduled_audit_failure' as alert_type, 'low' as severity, 'acknowledged' as status, dataset_name, audit_id from runs where status = 'failed'
 union all select workspace_id, concat('score:', audit_id, ':70'), 'score_threshold', 'high', case when score % 2 = 0 then 'resolved' else 'dismissed' end, dataset_name, audit_id from audits where score < 55)"""


def _stored_alerts(spark, sf_dir):
    frames = {"runs": view(spark, sf_dir, "runs"), "audits": view(spark, sf_dir, "audits")}
    sql = _STORED.replace("from runs", "from {runs}").replace("from audits", "from {audits}")
    base = spark.sql(f"select * from {sql}", **frames)
    return base.selectExpr(
        "*", "'t' as title", "'d' as description", "cast(null as bigint) as rule_id", "timestamp'2023-12-01' as detected_at", "timestamp'2023-12-01' as updated_at"
    )


_MERGED = f"""(select coalesce(f.workspace_id, s.workspace_id) as workspace_id, coalesce(f.fingerprint, s.fingerprint) as fingerprint,
 coalesce(s.alert_type, f.alert_type) as alert_type, coalesce(f.severity, s.severity) as severity, coalesce(s.status, 'new') as status,
 coalesce(s.dataset_name, f.dataset_name) as dataset_name from {_STORED} s full outer join {_FOUND} f on s.workspace_id = f.workspace_id and s.fingerprint = f.fingerprint)"""


def _snapshot(spark, sf_dir):
    return alerts.upsert(_stored_alerts(spark, sf_dir), _found_alerts(spark, sf_dir), AS_OF)


@register("alerts_upsert", with_views(_HISTORY, f"select * from {_MERGED}"))
def alerts_upsert(spark, sf_dir):
    return _snapshot(spark, sf_dir).select("workspace_id", "fingerprint", "alert_type", "severity", "status", "dataset_name")


@register("alert_counters", with_views(_HISTORY, f"""select count_if(severity = 'critical' and status not in ('resolved', 'dismissed')) as critical,
 count_if(severity = 'high' and status not in ('resolved', 'dismissed')) as high, count_if(status = 'new') as unread, count_if(status = 'resolved') as resolved,
 count(*) as total, count_if(status = 'acknowledged') as acknowledged, count_if(status = 'dismissed') as dismissed from {_MERGED}"""))
def alert_counters(spark, sf_dir):
    return alerts.alert_counters(_snapshot(spark, sf_dir))


@register("alert_page", with_views(["runs"], f"""select fingerprint, severity from (select r.fingerprint, r.severity, u.started_at from {_RUN} r join runs u on concat('schedule:', u.run_id) = r.fingerprint)
 order by started_at desc, fingerprint limit 5 offset 5"""))
def alert_page(spark, sf_dir):
    found = alerts.run_alerts(view(spark, sf_dir, "runs")).withColumn("status", F.lit("new"))
    return alerts.alert_page(found, search="AUDIT", severity="critical", page=2, page_size=5).select("fingerprint", "severity")


_ACTED = """(select a.audit_id, a.score, l.last_action, l.last_at, r.read_last from audits a
 left join (select fingerprint, arg_max(action, acted_at) as last_action, max(acted_at) as last_at from alert_actions where action <> 'read' group by 1) l on l.fingerprint = concat('score:', a.audit_id, ':80')
 left join (select fingerprint, max(acted_at) as read_last from alert_actions where action = 'read' group by 1) r on r.fingerprint = concat('score:', a.audit_id, ':80'))"""


@register("alert_actions", with_views(["alert_actions"], f"""select audit_id, case when coalesce(last_action, 'reopen') in ('unread', 'reopen') and read_last is not null and (last_at is null or read_last > last_at) then 'read'
 else case coalesce(last_action, 'reopen') when 'acknowledge' then 'acknowledged' when 'resolve' then 'resolved' when 'dismiss' then 'dismissed' else 'new' end end as status,
 last_action is not distinct from 'resolve' as is_resolved from {_ACTED}"""))
def alert_actions(spark, sf_dir):
    base = view(spark, sf_dir, "audits").selectExpr("workspace_id", "concat('score:', audit_id, ':80') as fingerprint", "audit_id", "'new' as status")
    found = alerts.apply_actions(base, view(spark, sf_dir, "alert_actions"))
    return found.selectExpr("audit_id", "status", "resolved_at is not null as is_resolved")


# --- reports ------------------------------------------------------------------------------------------------
@register("report_score_delta", with_views(["audits"], f"""select c.s as score, p.s as previous_score, c.s - p.s as score_delta from
 (select cast(round_even(avg(score), 0) as bigint) as s from {_NEWEST}) c, (select cast(round_even(avg(score), 0) as bigint) as s from
 (select *, row_number() over (partition by workspace_id, dataset_name order by created_at desc, audit_id desc) as rn from audits where created_at < timestamp '{SINCE}' - interval 7 day) where rn = 1) p"""))
def report_score_delta(spark, sf_dir):
    return reports.score_now_and_before(view(spark, sf_dir, "audits"), SINCE)


_CURRENT = f"(select i.* from issue_rows i join {_NEWEST} n on n.audit_id = i.audit_id)"


@register("report_severity", with_views(["audits", "issue_rows"], f"select severity, count(*) as issues from {_CURRENT} where status not in {CLOSED} group by severity"))
def report_severity(spark, sf_dir):
    return reports.severity_counts(reports.current_issues(view(spark, sf_dir, "audits"), issues(spark, sf_dir)))


@register("report_lifecycle", with_views(["issue_rows"], f"""select case when status in {CLOSED} then 'resolved' when status in ('in_progress', 'reopened') then status else 'new' end as bucket,
 count_if(severity = 'critical') as critical, count_if(severity = 'high') as high, count_if(severity = 'medium') as medium, count_if(severity = 'low') as low, count(*) as total
 from issue_rows group by 1"""))
def report_lifecycle(spark, sf_dir):
    return reports.lifecycle_matrix(issues(spark, sf_dir))


@register("report_rule_failures", with_views(["executions"], """select count(*) as executions, count_if(outcome = 'failed') as failed_rules,
 cast(round_even(count_if(outcome = 'failed') * 100.0::double / count(*), 0) as bigint) as rule_failure_rate from executions"""))
def report_rule_failures(spark, sf_dir):
    return reports.rule_failures(view(spark, sf_dir, "executions"))


@register("report_contract_failures", with_views(["contracts"], """select cast(coalesce(sum(case when validation_status = 'failed' then violation_count else 0 end), 0) as bigint) as contract_violations,
 count_if(validation_status = 'failed') as contracts_impacted, count(*) as contracts from (select *, row_number() over (partition by contract_key order by version desc) as rn from contracts) where rn = 1"""))
def report_contract_failures(spark, sf_dir):
    return reports.contract_failures(view(spark, sf_dir, "contracts"))


@register("report_drift_datasets", with_views(["order_versions"], f"select count(distinct dataset) as drift_datasets, count(*) as open_drift_alerts from {_DRIFT} where status <> 'resolved'"))
def report_drift_datasets(spark, sf_dir):
    dated = view(spark, sf_dir, "order_versions").selectExpr(
        "1L as workspace_id", "dataset", "version", "concat(dataset, '/', version) as audit_id", "timestamp'2024-01-01' as detected_at").distinct()
    found = alerts.drift_alerts(_drift(spark, sf_dir), dated).withColumn("status", F.lit("new"))
    return reports.drift_datasets(found)


@register("report_actions", with_views(["action_points"], """select count_if(status not in ('resolved', 'completed', 'closed')) as open_remediations,
 count_if(status not in ('resolved', 'completed', 'closed') and priority = 'critical') as overdue_remediations from action_points"""))
def report_actions(spark, sf_dir):
    return reports.action_counts(view(spark, sf_dir, "action_points"))


@register("report_run_health", with_views(["runs"], f"""select count_if(status = 'completed') as completed_runs, count_if(status = 'failed') as failed_runs,
 cast(round_even(count_if(status = 'completed') * 100.0::double / greatest(count(*), 1), 0) as bigint) as success_rate,
 coalesce(round(avg(case when status = 'completed' then duration_ms end) / 1000, 1), 0) as average_seconds
 from runs where started_at >= timestamp '{SINCE}' - interval 90 day and status in ('completed', 'failed')"""))
def report_run_health(spark, sf_dir):
    return reports.run_health(view(spark, sf_dir, "runs"), SINCE, 90)


@register("report_activity", with_views(["audits", "executions", "contracts", "datasets"], f"""select kind, title, status from (
 (select 'audit' as kind, concat('Audit completed: ', dataset_name) as title, created_at as t, 'success' as status from audits order by created_at desc, audit_id limit 5)
 union all (select 'rule', concat('Rule evaluation ', outcome, ': ', left(message, 70)), executed_at, case when outcome = 'passed' then 'success' else 'warning' end
  from executions where audit_id in (select audit_id from {_NEWEST}) order by executed_at desc, audit_id, rule_id limit 4)
 union all (select 'contract', concat('Contract ', validation_status, ': ', name), updated_at, case when validation_status = 'passed' then 'success' else 'warning' end
  from (select *, row_number() over (partition by contract_key order by version desc) as rn from contracts) where rn = 1 order by updated_at desc, contract_key limit 3)
 union all (select 'dataset', concat('Dataset updated: ', name), updated_at, 'info' from datasets order by updated_at desc, id limit 3)) order by t desc, kind, title limit 7"""))
def report_activity(spark, sf_dir):
    found = reports.activity_feed(*[view(spark, sf_dir, v) for v in ("audits", "executions", "contracts", "datasets")])
    return found.select("kind", "title", "status")


@register("report_columns", with_views(["issue_rows"], f"select c as column_name, count(*) as issues from (select unnest(string_split(column_list, ',')) as c from issue_rows where status not in {CLOSED}) group by c order by 2 desc, 1 limit 10"))
def report_columns(spark, sf_dir):
    return reports.affected_columns(issues(spark, sf_dir)).withColumnRenamed("column", "column_name")


@register("report_registry_totals", with_views(["audits", "datasets"], f"select (select count(*) from datasets) as datasets, (select count(distinct nullif(domain, '')) from datasets) as domains, (select count(*) from {_LINEAGE}) as versions"))
def report_registry_totals(spark, sf_dir):
    return reports.registry_totals(view(spark, sf_dir, "datasets"), versions.lineage(view(spark, sf_dir, "audits")))


@register("report_daily_scores", with_views(["audits"], "select strftime(created_at, '%Y-%m-%d') as day, round_even(avg(score), 1) as score, count(*) as audits from audits group by 1"))
def report_daily_scores(spark, sf_dir):
    return reports.daily_scores(view(spark, sf_dir, "audits")).selectExpr("cast(day as string) as day", "score", "audits")


@register("report_categories", with_views(["issue_rows"], "select category, count(*) as issues from issue_rows group by category"))
def report_categories(spark, sf_dir):
    return reports.category_counts(issues(spark, sf_dir))


@register("rule_pass_rate_daily", with_views(["executions"], """select strftime(executed_at, '%Y-%m-%d') as day, count(*) as executions,
 round_even(count_if(outcome = 'passed') * 100.0::double / count(*), 1) as pass_rate from executions group by 1"""))
def rule_pass_rate_daily(spark, sf_dir):
    return reports.daily_pass_rate(view(spark, sf_dir, "executions")).selectExpr("cast(day as string) as day", "executions", "pass_rate")


@register("report_ranking", with_views(["audits"], f"select dataset_name, score from {_NEWEST} order by score desc, dataset_name limit 10"))
def report_ranking(spark, sf_dir):
    return reports.dataset_ranking(view(spark, sf_dir, "audits"))


@register("report_scatter", with_views(["audits"], f"select dataset_name, score, issue_count as issues from {_NEWEST}"))
def report_scatter(spark, sf_dir):
    return reports.score_issue_scatter(view(spark, sf_dir, "audits"))


@register("report_remediation_impact", with_views(["audits"], """select c.dataset_name, s.score as before, c.score as after, c.score - s.score as change from audits c join audits s on s.audit_id = c.source_audit_id"""))
def report_remediation_impact(spark, sf_dir):
    return reports.remediation_impact(view(spark, sf_dir, "audits"))


_PERIOD = "(select * from audits where created_at >= timestamp '1997-01-01' and created_at <= timestamp '1998-12-31')"


@register("report_period", with_views(_HISTORY, f"""select (select round(avg(score), 1) from (select *, row_number() over (partition by workspace_id, dataset_name order by created_at desc, audit_id desc) as rn from {_PERIOD}) where rn = 1) as score,
 (select count(distinct dataset_name) from {_PERIOD}) as datasets, (select count(*) from issue_rows where status not in {CLOSED} and audit_id in (select audit_id from {_PERIOD})) as active_issues,
 (select count(*) from executions where outcome = 'failed' and audit_id in (select audit_id from {_PERIOD})) as failed_rules,
 (select count(*) from contracts where validation_status = 'failed') as contract_violations,
 (select count(*) from runs where status = 'failed' and audit_id in (select audit_id from {_PERIOD})) as drift_events"""))
def report_period(spark, sf_dir):
    scope = reports.in_scope(view(spark, sf_dir, "audits"), "1997-01-01", "1998-12-31")
    drifted = view(spark, sf_dir, "runs").where("status = 'failed'").select("audit_id")
    return reports.period_dashboard(scope, issues(spark, sf_dir), view(spark, sf_dir, "executions"), view(spark, sf_dir, "contracts"), drifted)


@register("report_rules", with_views(["quality_rules", "assignments", "executions"], """select r.id as rule_id, r.name, r.is_active,
 (select count(*) from assignments a where a.rule_id = r.id and a.is_active) as assignment_count, (select count(*) from executions e where e.rule_id = r.id) as executions,
 (select count(*) from executions e where e.rule_id = r.id and outcome = 'failed') as failures,
 cast((select max(executed_at) from executions e where e.rule_id = r.id) as varchar) as last_executed_at from quality_rules r"""))
def report_rules(spark, sf_dir):
    found = reports.rules_dashboard(*[view(spark, sf_dir, v) for v in ("quality_rules", "assignments", "executions")])
    return found.drop("failure_rate").withColumn("last_executed_at", F.expr("cast(last_executed_at as string)"))


@register("report_recent_executions", with_views(["executions", "quality_rules"], """select e.audit_id, e.rule_id, r.name as rule_name, e.outcome from executions e join quality_rules r on r.id = e.rule_id
 order by e.executed_at desc, e.rule_id, e.audit_id limit 30"""))
def report_recent_executions(spark, sf_dir):
    found = reports.recent_executions(view(spark, sf_dir, "executions"), view(spark, sf_dir, "quality_rules"))
    return found.select("audit_id", "rule_id", "rule_name", "outcome")


_EXECUTED = "select e.rule_id, r.name as rule_name, a.dataset_name, e.audit_id, e.outcome, round(e.affected_rate * 100, 2) as affected_percentage from executions e join quality_rules r on r.id = e.rule_id join audits a on a.audit_id = e.audit_id"


@register("execution_history", with_views(["executions", "quality_rules", "audits"], f"{_EXECUTED} where e.outcome = 'failed' and contains(lower(r.name), 'amount')"))
def execution_history(spark, sf_dir):
    found = reports.execution_history(*[view(spark, sf_dir, v) for v in ("executions", "quality_rules", "audits")], outcome="failed", search=" Amount ")
    return found.select("rule_id", "rule_name", "dataset_name", "audit_id", "outcome", "affected_percentage")


@register("execution_history_page", with_views(["executions", "quality_rules", "audits"], f"{_EXECUTED} where e.rule_id = 2 order by e.executed_at desc, e.rule_id, e.audit_id limit 25 offset 25"))
def execution_history_page(spark, sf_dir):
    found = reports.execution_history(*[view(spark, sf_dir, v) for v in ("executions", "quality_rules", "audits")], rule_id=2, page=2)
    return found.select("rule_id", "rule_name", "dataset_name", "audit_id", "outcome", "affected_percentage")


def _registry(spark, sf_dir):
    audits = view(spark, sf_dir, "audits")
    active = issues(spark, sf_dir).groupBy("audit_id").agg(F.expr(f"{score.active_count()} as active_issues"))
    return reports.dataset_registry(view(spark, sf_dir, "datasets"), audits, audits, active)


_REGISTRY = f"""(select d.id, d.name, d.environment, n.audit_id as latest_audit_id, n.row_count as record_count, n.score as quality_score, coalesce(k, 0) as issue_count,
 case when n.score >= 80 then 'healthy' when n.score >= 60 then 'warning' else 'review_needed' end as status, n.created_at as updated_at from datasets d join {_NEWEST} n on n.dataset_name = d.name
 left join (select audit_id, count_if(status not in {INACTIVE}) as k from issue_rows group by audit_id) i on i.audit_id = n.audit_id)"""


@register("dataset_registry", with_views(["datasets", "audits", "issue_rows"], f"select id, name, latest_audit_id, record_count, quality_score, issue_count, status from {_REGISTRY} where environment = 'production' and contains(name, 'orders_1')"))
def dataset_registry(spark, sf_dir):
    found = reports.find_datasets(_registry(spark, sf_dir), "Orders_1", "production")
    return found.select("id", "name", "latest_audit_id", "record_count", "quality_score", "issue_count", "status")


@register("dataset_registry_summary", with_views(["datasets", "audits", "issue_rows"], f"""select count(*) as registered, count(latest_audit_id) as monitored, count_if(issue_count > 0) as active_issues,
 count_if(updated_at > timestamp '{SINCE}' - interval 8 day) as recently_updated from {_REGISTRY}"""))
def dataset_registry_summary(spark, sf_dir):
    return reports.registry_summary(_registry(spark, sf_dir), SINCE)


@register("dataset_score_history", with_views(["audits"], """select dataset_name, cast(created_at as varchar) as created_at, score from (select *, row_number() over (partition by dataset_name order by created_at desc, audit_id desc) as rn
 from audits) where rn <= 14"""))
def dataset_score_history(spark, sf_dir):
    return reports.score_history(view(spark, sf_dir, "audits")).selectExpr("dataset_name", "cast(created_at as string) as created_at", "score")


@register("report_evidence", with_views(["audits", "issue_rows", "executions"], f"""select n.dataset_name, n.audit_id, n.previous_audit_id, n.score - n.previous_score as score_change,
 (select count(*) from issue_rows i where i.audit_id = n.audit_id and severity = 'critical' and status not in {CLOSED}) as critical,
 (select count(*) from issue_rows i where i.audit_id = n.audit_id and severity = 'medium' and status not in {CLOSED}) as medium,
 (select count(*) from executions e where e.audit_id = n.audit_id and outcome = 'failed') as failed_rules from (
 select *, lag(score) over w as previous_score, lag(audit_id) over w as previous_audit_id, row_number() over (partition by dataset_name order by created_at desc, audit_id desc) as rn
 from audits window w as (partition by dataset_name order by created_at, audit_id)) n where rn = 1"""))
def report_evidence(spark, sf_dir):
    found = reports.evidence(view(spark, sf_dir, "audits"), issues(spark, sf_dir), view(spark, sf_dir, "executions"))
    return found.select("dataset_name", "audit_id", "previous_audit_id", "score_change", "critical", "medium", "failed_rules")


@register("rule_builder_context", with_views(["order_versions"], f"select col as column_name, kind as inferred_type, gaps as missing_rate from {_PROFILES} where dataset = 'orders_2' and version = 3"))
def rule_builder_context(spark, sf_dir):
    found = profile.schema_profile(view(spark, sf_dir, "order_versions"), ["dataset", "version"], OPTIONS)
    stored = found.where("inferred_type <> 'empty'").withColumn("audit_id", F.expr("concat(dataset, '/', version)"))
    return reports.builder_context(stored, "orders_2/3").selectExpr("column as column_name", "inferred_type", "missing_rate")


@register("audit_purge", with_views(["audits", "runs"], "select audit_id, audit_id in (select audit_id from runs where status = 'completed') as kept from audits"))
def audit_purge(spark, sf_dir):
    snapshots = view(spark, sf_dir, "runs").where("status = 'completed'")
    kept, dropped = reports.purge_stale(view(spark, sf_dir, "audits"), snapshots)
    return kept.selectExpr("audit_id", "true as kept").unionByName(dropped.selectExpr("audit_id", "false as kept"))


@register("audit_purge_pointers", with_views(["audits", "runs", "datasets"], """select d.name as dataset_name, a.audit_id as latest_audit_id, coalesce(a.row_count, 0) as record_count,
 coalesce(a.column_count, 0) as column_count, a.score as quality_score, coalesce(a.issue_count, 0) as issue_count, case when a.audit_id is null then 'registered' else 'audited' end as status
 from datasets d left join (select * from audits where audit_id in (select audit_id from runs where status = 'completed')
  qualify row_number() over (partition by dataset_name order by created_at desc, audit_id desc) = 1) a on a.dataset_name = d.name"""))
def audit_purge_pointers(spark, sf_dir):
    kept, _ = reports.purge_stale(view(spark, sf_dir, "audits"), view(spark, sf_dir, "runs").where("status = 'completed'"))
    known = view(spark, sf_dir, "datasets").selectExpr("name as dataset_name", "'audited' as status")
    return reports.refresh_pointers(known, kept)


@register("privacy_safe_issues", with_views(["issue_rows"], """select i.audit_id, t.id, t.place, c.by_severity, c.by_category from
 (select audit_id, array_to_string(list_sort(list(severity || '=' || n) filter (severity is not null)), ',') as by_severity from (select audit_id, severity, count(*) as n from issue_rows group by 1, 2) group by 1) i
 join (select a.audit_id, a.by_severity, b.by_category from
  (select audit_id, array_to_string(list_sort(list(severity || '=' || n)), ',') as by_severity from (select audit_id, severity, count(*) as n from issue_rows group by 1, 2) group by 1) a
  join (select audit_id, array_to_string(list_sort(list(category || '=' || n)), ',') as by_category from (select audit_id, category, count(*) as n from issue_rows group by 1, 2) group by 1) b
  on a.audit_id = b.audit_id) c on c.audit_id = i.audit_id
 join (select audit_id, id, cast(row_number() over (partition by audit_id order by case severity when 'critical' then 4 when 'high' then 3 when 'medium' then 2 else 1 end desc, id) as int) as place from issue_rows
  qualify place <= 8) t on t.audit_id = i.audit_id"""))
def privacy_safe_issues(spark, sf_dir):
    counts, top = score.privacy_safe_issues(issues(spark, sf_dir), ["audit_id"])
    shown = lambda c: f"array_join(array_sort(transform(map_entries({c}), e -> concat(e.key, '=', e.value))), ',') as {c}"
    return top.select("audit_id", "id", "place").join(counts.selectExpr("audit_id", shown("by_severity"), shown("by_category")), "audit_id")


@register("audit_export", with_views(["audits"], """select dataset_name as "Dataset", audit_id as "Audit ID", score as "Score", issue_count as "Issues", risk_level as "Risk" from audits"""))
def audit_export(spark, sf_dir):
    return store.export_view(view(spark, sf_dir, "audits"), "audits").drop("Generated At")
