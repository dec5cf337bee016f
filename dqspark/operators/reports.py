"""Operational analytics over audit history."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions import fixed
from ..functions.values import items, lit, py_round
from .alerts import latest_audits
from .history import latest, page_after, query
from .score import health

CLOSED = items(fixed.CLOSED_STATUSES)


def in_scope(audits: DataFrame, date_from: str | None = None, date_to: str | None = None, dataset: str | None = None) -> DataFrame:
    """Audits of a period and dataset (O18); the filters reach the partitions."""
    if date_from:
        audits = audits.where(f"created_at >= cast({lit(date_from)} as timestamp)")
    if date_to:
        audits = audits.where(f"created_at <= cast({lit(date_to)} as timestamp)")
    return audits.where(f"dataset_name = {lit(dataset)}") if dataset else audits


def score_now_and_before(audits: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Mean latest score, and the same as it stood some days ago."""
    cut = f"cast({lit(as_of)} as timestamp) - interval {int(days)} days"
    return query(
        f"""select score, previous_score, score - previous_score as score_delta from
              (select (select {py_round('avg(score)')} from {{newest}}) as score,
                      (select {py_round('avg(score)')} from {{older}}) as previous_score)""",
        newest=latest_audits(audits), older=latest_audits(audits.where(f"created_at < {cut}")),
    )


def current_issues(audits: DataFrame, issues: DataFrame) -> DataFrame:
    """Issues of the newest audit of each dataset."""
    return issues.join(latest_audits(audits).select("audit_id"), "audit_id", "left_semi")


def severity_counts(issues: DataFrame) -> DataFrame:
    """Active issues per severity."""
    return issues.where(f"status not in ({CLOSED})").groupBy("severity").count().withColumnRenamed("count", "issues")


def lifecycle_matrix(issues: DataFrame) -> DataFrame:
    """Issues per lifecycle bucket and severity."""
    bucket = (
        f"case when status in ({CLOSED}) then 'resolved' when status in ('in_progress', 'reopened') then status"
        " else 'new' end as bucket"
    )
    return (
        issues.selectExpr(bucket, "severity").groupBy("bucket").pivot("severity", list(fixed.SEVERITIES)).count().fillna(0)
        .selectExpr("bucket", *fixed.SEVERITIES, f"{' + '.join(fixed.SEVERITIES)} as total")
    )


def rule_failures(executions: DataFrame) -> DataFrame:
    """Failed executions and their share."""
    share = py_round("count_if(outcome = 'failed') * 100D / greatest(count(1), 1)")
    return executions.selectExpr(
        "count(1) as executions", "count_if(outcome = 'failed') as failed_rules", f"{share} as rule_failure_rate"
    )


def contract_failures(contracts: DataFrame) -> DataFrame:
    """Violations and impacted contracts among the newest versions."""
    newest = latest(contracts, ["workspace_id", "contract_key"], ["version", "updated_at"])
    failed = "validation_status in ('failed', 'violation') or status = 'violation'"
    return newest.selectExpr(
        f"coalesce(sum(if({failed}, violation_count, 0L)), 0L) as contract_violations",
        f"count_if({failed}) as contracts_impacted", "count(1) as contracts",
    )


def drift_datasets(alerts: DataFrame) -> DataFrame:
    """Datasets with an open drift alert."""
    live = alerts.where("alert_type = 'schema_drift' and status not in ('resolved', 'dismissed')")
    return live.selectExpr("count(distinct dataset_name) as drift_datasets", "count(1) as open_drift_alerts")


def action_counts(actions: DataFrame) -> DataFrame:
    """Open and overdue action points (O13); a critical one counts as overdue."""
    live = "status not in ('resolved', 'completed', 'closed')"
    return actions.selectExpr(
        f"count_if({live}) as open_remediations", f"count_if({live} and priority = 'critical') as overdue_remediations"
    )


def run_health(runs: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Success rate and mean duration of recent runs."""
    cut = f"cast({lit(as_of)} as timestamp) - interval {int(days)} days"
    return runs.where(f"started_at >= {cut} and status in ('completed', 'failed')").selectExpr(
        "count_if(status = 'completed') as completed_runs", "count_if(status = 'failed') as failed_runs",
        f"{py_round('count_if(status = ' + lit('completed') + ') * 100D / greatest(count(1), 1)')} as success_rate",
        f"coalesce({py_round('avg(if(status = ' + lit('completed') + ', coalesce(duration_ms, 0), null)) / 1000D', 1)}, 0D)"
        " as average_seconds",
    )


def activity_feed(
    audits: DataFrame, executions: DataFrame, contracts: DataFrame, datasets: DataFrame, k: int = 7
) -> DataFrame:
    """Newest events over four sources.

    Each source is cut to its newest few before the union, so four small top-k sorts feed one.
    """
    newest = latest_audits(audits)
    current = executions.join(newest.select("audit_id"), "audit_id", "left_semi")
    return query(
        f"""select * from (
              (select 'audit' as kind, concat('Audit completed: ', dataset_name) as title, created_at as happened_at,
                 'success' as status, audit_id as reference from {{audits}} order by happened_at desc, reference limit 5)
              union all
              (select 'rule', concat('Rule evaluation ', outcome, ': ', left(message, 70)), executed_at,
                 if(outcome = 'passed', 'success', 'warning'), audit_id from {{current}} order by executed_at desc, audit_id, rule_id limit 4)
              union all
              (select 'contract', concat('Contract ', validation_status, ': ', name), updated_at,
                 if(validation_status = 'passed', 'success', 'warning'), source_audit_id from {{contracts}} order by updated_at desc, contract_key limit 3)
              union all
              (select 'dataset', concat('Dataset updated: ', name), updated_at, 'info', cast(id as string) from {{datasets}}
                 order by updated_at desc, id limit 3))
            order by happened_at desc, kind, title limit {int(k)}""",
        audits=audits, current=current, datasets=datasets,
        contracts=latest(contracts, ["workspace_id", "contract_key"], ["version", "updated_at"]),
    )


def affected_columns(issues: DataFrame, k: int = 10) -> DataFrame:
    """Columns named by most active issues."""
    named = issues.where(f"status not in ({CLOSED})").selectExpr("explode(columns) as column")
    return named.groupBy("column").count().withColumnRenamed("count", "issues").orderBy(
        "issues", "column", ascending=[False, True]
    ).limit(k)


def registry_totals(datasets: DataFrame, versions: DataFrame) -> DataFrame:
    """Datasets, domains and versions (O16).  ``versions``: output of the lineage query."""
    return query(
        """select count(1) as datasets, count(distinct nullif(domain, '')) as domains,
             (select count(1) from {versions}) as versions from {datasets}""",
        datasets=datasets, versions=versions,
    )


def daily_scores(audits: DataFrame) -> DataFrame:
    """Mean score per day (O17); grouped by date, so years stay apart."""
    return query(
        f"select to_date(created_at) as day, {py_round('avg(score)', 1)} as score, count(1) as audits from {{audits}} group by to_date(created_at)",
        audits=audits,
    )


def category_counts(issues: DataFrame) -> DataFrame:
    """Issues per category."""
    return issues.groupBy("category").count().withColumnRenamed("count", "issues")


def daily_pass_rate(executions: DataFrame) -> DataFrame:
    """Share of passed executions per day."""
    rate = py_round("count_if(outcome = 'passed') * 100D / count(1)", 1)
    return query(
        f"select to_date(executed_at) as day, count(1) as executions, {rate} as pass_rate from {{executions}} group by to_date(executed_at)",
        executions=executions,
    )


def dataset_ranking(audits: DataFrame, k: int = 10) -> DataFrame:
    """Best latest scores."""
    return latest_audits(audits).select("dataset_name", "score").orderBy("score", "dataset_name", ascending=[False, True]).limit(k)


def score_issue_scatter(audits: DataFrame) -> DataFrame:
    """Latest score against issue count."""
    return latest_audits(audits).selectExpr("dataset_name", "score", "issue_count as issues")


def remediation_impact(audits: DataFrame) -> DataFrame:
    """Score before and after cleaning (O17): a cleaned audit next to its source audit.

    ``audits`` has ``source_audit_id`` on audits of cleaned tables.
    """
    return query(
        """select c.dataset_name, s.score as before, c.score as after, c.score - s.score as change
           from {audits} c join {audits} s on s.audit_id = c.source_audit_id""",
        audits=audits,
    )


def period_dashboard(audits: DataFrame, issues: DataFrame, executions: DataFrame, contracts: DataFrame, drift: DataFrame) -> DataFrame:
    """Figures of the audits in scope (O19).  Drift counts real events, by candidate audit."""
    return query(
        f"""select {py_round('avg(score)', 1)} as score, count(1) as datasets,
              (select count(1) from {{issues}} i left semi join {{audits}} a on a.audit_id = i.audit_id
               where i.status not in ({CLOSED})) as active_issues,
              (select count(1) from {{executions}} e left semi join {{audits}} a on a.audit_id = e.audit_id
               where e.outcome = 'failed') as failed_rules,
              (select count(1) from {{contracts}} where validation_status = 'failed') as contract_violations,
              (select count(1) from {{drift}} d left semi join {{audits}} a on a.audit_id = d.audit_id) as drift_events
            from {{newest}}""",
        newest=latest_audits(audits), audits=audits, issues=issues, executions=executions, contracts=contracts, drift=drift,
    )


def rules_dashboard(rules: DataFrame, assignments: DataFrame, executions: DataFrame) -> DataFrame:
    """Per rule: assignments, runs, failures, last run."""
    return query(
        f"""select r.id as rule_id, r.name, r.is_active, coalesce(a.datasets, 0L) as assignment_count,
              coalesce(e.runs, 0L) as executions, coalesce(e.failures, 0L) as failures, e.last_executed_at,
              coalesce({py_round('e.failures * 100D / e.runs', 1)}, 0D) as failure_rate
            from {{rules}} r
            left join (select rule_id, count(1) as datasets from {{assignments}} where is_active group by rule_id) a on a.rule_id = r.id
            left join (select rule_id, count(1) as runs, count_if(outcome = 'failed') as failures, max(executed_at) as last_executed_at
                       from {{executions}} group by rule_id) e on e.rule_id = r.id""",
        rules=rules, assignments=assignments, executions=executions,
    )


def recent_executions(executions: DataFrame, rules: DataFrame, k: int = 30) -> DataFrame:
    """Newest executions with their rule's name."""
    return executions.join(rules.selectExpr("id as rule_id", "name as rule_name"), "rule_id").orderBy(
        "executed_at", "rule_id", "audit_id", ascending=[False, True, True]
    ).limit(k)


def execution_history(
    executions: DataFrame, rules: DataFrame, audits: DataFrame, outcome: str | None = None, rule_id: int | None = None,
    dataset: str | None = None, search: str = "", page: int | None = None, page_size: int = 25,
    after: dict | None = None,
) -> DataFrame:
    """Executions with rule and dataset names, filtered, newest first (O21, O22); a page by its number, or the one that follows ``after``."""
    found = query(
        f"""select e.rule_id, r.name as rule_name, a.dataset_name, e.audit_id, e.outcome, e.affected_rows, e.affected_rate,
              {py_round('e.affected_rate * 100D', 2)} as affected_percentage, e.message, e.executed_at
            from {{executions}} e join {{rules}} r on r.id = e.rule_id join {{audits}} a on a.audit_id = e.audit_id""",
        executions=executions, rules=rules, audits=audits,
    )
    if outcome and outcome != "all":
        found = found.where(f"outcome = {lit(outcome)}")
    if rule_id:
        found = found.where(f"rule_id = {int(rule_id)}")
    if dataset:
        found = found.where(f"dataset_name = {lit(dataset)}")
    if search.strip():
        found = found.where(f"contains(lower(rule_name), {lit(search.strip().lower())})")
    if after is not None:
        return page_after(found, [("executed_at", True), ("rule_id", False), ("audit_id", False)], page_size, after)
    if page is None:
        return found
    ordered = found.orderBy("executed_at", "rule_id", "audit_id", ascending=[False, True, True])
    return ordered.offset((page - 1) * page_size).limit(page_size)


def dataset_registry(datasets: DataFrame, audits: DataFrame, shapes: DataFrame, active: DataFrame) -> DataFrame:
    """Registry refreshed from each dataset's newest audit.

    ``shapes``: audit_id, row_count, column_count; ``active``: audit_id, active_issues.
    """
    return query(
        f"""select d.id, d.name, d.domain, d.environment, d.workspace_id, a.audit_id as latest_audit_id,
              coalesce(s.row_count, 0L) as record_count, coalesce(s.column_count, 0L) as column_count, a.score as quality_score,
              coalesce(i.active_issues, 0L) as issue_count,
              case when a.audit_id is null then 'registered' else {health('a.score')} end as status,
              coalesce(a.created_at, d.updated_at) as updated_at
            from {{datasets}} d left join {{newest}} a on a.dataset_name = d.name and a.workspace_id = d.workspace_id
            left join {{shapes}} s on s.audit_id = a.audit_id left join {{active}} i on i.audit_id = a.audit_id""",
        datasets=datasets, newest=latest_audits(audits), shapes=shapes, active=active,
    )


def find_datasets(registry: DataFrame, search: str = "", environment: str | None = None) -> DataFrame:
    """Registry rows by name and environment."""
    if search.strip():
        registry = registry.where(f"contains(lower(name), {lit(search.strip().lower())})")
    return registry.where(f"environment = {lit(environment)}") if environment and environment != "all" else registry


def registry_summary(registry: DataFrame, as_of: str) -> DataFrame:
    """Registered, monitored, with issues, updated within 7 days."""
    return registry.selectExpr(
        "count(1) as registered", "count(latest_audit_id) as monitored", "count_if(issue_count > 0) as active_issues",
        f"count_if(updated_at > cast({lit(as_of)} as timestamp) - interval 8 days) as recently_updated",
    )


def score_history(audits: DataFrame, k: int = 14) -> DataFrame:
    """Last k scores per dataset, oldest first."""
    return query(
        f"""select dataset_name, created_at, score from
              (select *, row_number() over (partition by dataset_name order by created_at desc, audit_id desc) as place from {{audits}})
            where place <= {int(k)}""",
        audits=audits,
    )


def evidence(audits: DataFrame, issues: DataFrame, executions: DataFrame) -> DataFrame:
    """Latest against previous audit per dataset."""
    return query(
        f"""with newest_two as (
              select * from (select dataset_name, audit_id, score,
                row_number() over (partition by dataset_name order by created_at desc, audit_id desc) as place from {{audits}})
              where place <= 2
            ), newest as (
              select dataset_name, max(if(place = 1, audit_id, null)) as audit_id, max(if(place = 2, audit_id, null)) as previous_audit_id,
                max(if(place = 1, score, null)) as score, max(if(place = 2, score, null)) as previous_score
              from newest_two group by dataset_name
            ),
            open_issues as (
              select audit_id, count_if(severity = 'critical') as critical, count_if(severity = 'high') as high,
                count_if(severity = 'medium') as medium, count_if(severity = 'low') as low
              from {{issues}} where status not in ({CLOSED}) group by audit_id
            ), failed as (select audit_id, count(1) as failed_rules from {{executions}} where outcome = 'failed' group by audit_id)
            select n.dataset_name, n.audit_id, n.previous_audit_id, n.score, n.previous_score, n.score - n.previous_score as score_change,
              coalesce(o.critical, 0L) as critical, coalesce(o.high, 0L) as high, coalesce(o.medium, 0L) as medium,
              coalesce(o.low, 0L) as low, coalesce(f.failed_rules, 0L) as failed_rules
            from newest n left join open_issues o on o.audit_id = n.audit_id left join failed f on f.audit_id = n.audit_id""",
        audits=audits, issues=issues, executions=executions,
    )


def builder_context(profiles: DataFrame, audit_id: str) -> DataFrame:
    """Columns a rule can be written for."""
    return profiles.where(f"audit_id = {lit(audit_id)}").select("column", "inferred_type", "missing_rate", "unique_rate")


def purge_stale(audits: DataFrame, snapshots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped) audits by whether their source snapshot still exists."""
    live = snapshots.select("audit_id").distinct()
    return audits.join(live, "audit_id", "left_semi"), audits.join(live, "audit_id", "left_anti")


def refresh_pointers(datasets: DataFrame, kept: DataFrame) -> DataFrame:
    """Datasets with their newest audit left, or reset to ``registered`` when none is.

    ``datasets``: dataset_name, status.  ``kept``: audits after a purge.
    """
    return query(
        """with newest as (
             select dataset_name, max_by(struct(audit_id, row_count, column_count, score, issue_count), struct(created_at, audit_id)) as a
             from {kept} group by dataset_name
           )
           select d.dataset_name, a.audit_id as latest_audit_id, coalesce(a.row_count, 0L) as record_count, coalesce(a.column_count, 0L) as column_count,
             a.score as quality_score, coalesce(a.issue_count, 0L) as issue_count, if(a.audit_id is null, 'registered', d.status) as status
           from {datasets} d left join newest n on n.dataset_name = d.dataset_name""",
        datasets=datasets, kept=kept,
    )
