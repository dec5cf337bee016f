"""Alerts from audit history.

Each source gives rows of the same shape; ``upsert`` merges them into the stored alerts by
(workspace, fingerprint).  Full tables are read, not the newest few rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

from ..functions.values import items, lit
from .history import latest, page_after, query

DEFAULT_THRESHOLD = 80
ALERT_KEYS = ("workspace_id", "fingerprint")
CLOSED = ("resolved", "dismissed")


def latest_audits(audits: DataFrame) -> DataFrame:
    """Newest audit per dataset."""
    return latest(audits, ["workspace_id", "dataset_name"], ["created_at", "audit_id"])


def _shape(sql: str, **tables: DataFrame) -> DataFrame:
    return query(sql, **tables).selectExpr(
        "workspace_id", "fingerprint", "alert_type", "severity", "title", "description", "dataset_name", "audit_id",
        "cast(rule_id as bigint) as rule_id", "detected_at",
    )


def score_alerts(audits: DataFrame, threshold: int = DEFAULT_THRESHOLD, newest: DataFrame | None = None) -> DataFrame:
    """Latest score below the threshold (O1).  ``newest``: ``latest_audits`` where it is at hand."""
    t = int(threshold)
    return _shape(
        f"""select workspace_id, concat('score:', audit_id, ':{t}') as fingerprint, 'score_threshold' as alert_type,
              if(score < {max(60, t - 15)}, 'critical', 'high') as severity,
              'Reliability score below threshold ({t}%)' as title,
              concat('The latest score is ', score, '; the threshold is {t}.') as description,
              dataset_name, audit_id, null as rule_id, created_at as detected_at
            from {{newest}} where score < {t}""",
        newest=latest_audits(audits) if newest is None else newest,
    )


def issue_alerts(audits: DataFrame, issues: DataFrame, newest: DataFrame | None = None) -> DataFrame:
    """Critical or high issues left in the latest audit (O2).  ``newest`` as in ``score_alerts``."""
    return _shape(
        """select a.workspace_id, concat('issues:', a.audit_id) as fingerprint, 'high_severity_issue' as alert_type,
             if(bool_or(i.severity = 'critical'), 'critical', 'high') as severity,
             'High severity issues detected' as title,
             concat(count(1), ' critical or high issues need review.') as description,
             a.dataset_name, a.audit_id, null as rule_id, a.created_at as detected_at
           from {newest} a join {issues} i on i.audit_id = a.audit_id
           where i.severity in ('critical', 'high') and i.status <> 'resolved'
           group by a.workspace_id, a.audit_id, a.dataset_name, a.created_at""",
        newest=latest_audits(audits) if newest is None else newest, issues=issues,
    )


def rule_alerts(executions: DataFrame, audits: DataFrame, rules: DataFrame) -> DataFrame:
    """Failed rule executions (O3)."""
    return _shape(
        """select a.workspace_id, concat('rule:', e.execution_id) as fingerprint, 'rule_failure' as alert_type,
             coalesce(r.severity, 'medium') as severity, 'Quality rule failed' as title, e.message as description,
             a.dataset_name, e.audit_id, e.rule_id, e.executed_at as detected_at
           from {executions} e join {audits} a on a.audit_id = e.audit_id left join {rules} r on r.id = e.rule_id
           where e.outcome = 'failed'""",
        executions=executions, audits=audits, rules=rules,
    )


def contract_alerts(contracts: DataFrame) -> DataFrame:
    """Contracts that failed validation."""
    return _shape(
        """select workspace_id, concat('contract:', contract_key, ':', version) as fingerprint,
             'contract_violation' as alert_type, 'high' as severity, 'Data contract violation' as title,
             concat(name, ' version ', version, ' failed validation.') as description,
             dataset_name, source_audit_id as audit_id, null as rule_id, updated_at as detected_at
           from {contracts} where validation_status = 'failed'""",
        contracts=contracts,
    )


def drift_alerts(events: DataFrame, versions: DataFrame) -> DataFrame:
    """Drift events that are not resolved (O5).  ``versions``: workspace_id, dataset, version, audit_id, detected_at."""
    return _shape(
        """select v.workspace_id, concat('drift:', e.event_id) as fingerprint, 'schema_drift' as alert_type, e.severity,
             'Schema drift detected' as title, concat(e.drift_type, ': ', e.subject) as description,
             e.dataset as dataset_name, v.audit_id, null as rule_id, v.detected_at
           from {events} e join {versions} v on v.dataset = e.dataset and v.version = e.candidate
           where e.status <> 'resolved'""",
        events=events, versions=versions,
    )


def run_alerts(runs: DataFrame) -> DataFrame:
    """Failed runs in a run log."""
    return _shape(
        """select workspace_id, concat('schedule:', run_id) as fingerprint, 'scheduled_audit_failure' as alert_type,
             'critical' as severity, 'Scheduled audit failed' as title,
             coalesce(error_message, 'The scheduled audit did not complete.') as description,
             dataset_name, audit_id, null as rule_id, started_at as detected_at
           from {runs} where status = 'failed'""",
        runs=runs,
    )


def all_alerts(*sources: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, sources)


def upsert(stored: DataFrame, found: DataFrame, as_of: str) -> DataFrame:
    """New alerts snapshot.

    A known alert gets the fresh severity, title and description and keeps its status and
    first detection; an unknown one starts as ``new``; alerts not found again stay as they are.
    """
    now = f"cast({lit(as_of)} as timestamp)"
    return query(
        f"""select coalesce(f.workspace_id, s.workspace_id) as workspace_id, coalesce(f.fingerprint, s.fingerprint) as fingerprint,
              coalesce(s.alert_type, f.alert_type) as alert_type, coalesce(f.severity, s.severity) as severity,
              coalesce(s.status, 'new') as status, coalesce(f.title, s.title) as title,
              coalesce(f.description, s.description) as description, coalesce(s.dataset_name, f.dataset_name) as dataset_name,
              coalesce(s.audit_id, f.audit_id) as audit_id, coalesce(s.rule_id, f.rule_id) as rule_id,
              coalesce(s.detected_at, f.detected_at, {now}) as detected_at,
              if(f.fingerprint is null, s.updated_at, {now}) as updated_at
            from {{stored}} s full outer join {{found}} f
              on s.workspace_id = f.workspace_id and s.fingerprint = f.fingerprint""",
        stored=stored, found=found,
    )


def apply_actions(alerts: DataFrame, actions: DataFrame) -> DataFrame:
    """Status after user actions, in order.

    ``actions``: workspace_id, fingerprint, action, acted_at, action_id.  ``read`` only matters
    while an alert is new, so the last other action decides, and a later ``read`` turns
    ``new`` into ``read``.
    """
    return query(
        """with ordered as (
             select *, struct(acted_at, action_id) as at from {actions}
           ), state as (
             select workspace_id, fingerprint,
               max_by(action, at) filter (where action <> 'read') as last_action,
               max(at) filter (where action <> 'read') as last_at,
               max(at) filter (where action = 'read') as read_last,
               max_by(acted_at, at) filter (where action in ('acknowledge', 'reopen')) as ack_at,
               max_by(action, at) filter (where action in ('acknowledge', 'reopen')) as ack,
               max_by(acted_at, at) filter (where action in ('resolve', 'reopen')) as res_at,
               max_by(action, at) filter (where action in ('resolve', 'reopen')) as res,
               max_by(acted_at, at) filter (where action in ('dismiss', 'reopen')) as dis_at,
               max_by(action, at) filter (where action in ('dismiss', 'reopen')) as dis,
               max_by(acted_at, at) filter (where action in ('read', 'unread')) as seen_at,
               max_by(action, at) filter (where action in ('read', 'unread')) as seen
             from ordered group by workspace_id, fingerprint
           ), settled as (
             select *, case last_action when 'acknowledge' then 'acknowledged' when 'resolve' then 'resolved'
               when 'dismiss' then 'dismissed' when 'unread' then 'new' when 'reopen' then 'new' end as last_status
             from state
           )
           select a.* except (status),
             case when s.fingerprint is null then a.status
               when coalesce(s.last_status, a.status) = 'new' and s.read_last is not null
                 and (s.last_at is null or s.read_last > s.last_at) then 'read'
               else coalesce(s.last_status, a.status) end as status,
             if(s.ack = 'acknowledge', s.ack_at, null) as acknowledged_at, if(s.res = 'resolve', s.res_at, null) as resolved_at,
             if(s.dis = 'dismiss', s.dis_at, null) as dismissed_at, if(s.seen = 'read', s.seen_at, null) as read_at
           from {alerts} a left join settled s on s.workspace_id = a.workspace_id and s.fingerprint = a.fingerprint""",
        alerts=alerts, actions=actions,
    )


def alert_page(
    alerts: DataFrame, search: str | None = None, severity: str | None = None, status: str | None = None,
    alert_type: str | None = None, dataset_name: str | None = None, date_from: str | None = None, date_to: str | None = None,
    page: int = 1, page_size: int = 8, after: dict | None = None,
) -> DataFrame:
    """Filtered alerts, newest first, one page (O9): the one that follows ``after``, or by its number."""
    if search:
        term = lit("%" + search.strip() + "%")
        alerts = alerts.where(f"title ilike {term} or dataset_name ilike {term} or description ilike {term}")
    for column, wanted in (("severity", severity), ("status", status), ("alert_type", alert_type), ("dataset_name", dataset_name)):
        if wanted and wanted != "all":
            alerts = alerts.where(f"{column} = {lit(wanted)}")
    if date_from:
        alerts = alerts.where(f"detected_at >= cast({lit(date_from)} as timestamp)")
    if date_to:
        alerts = alerts.where(f"detected_at <= cast({lit(date_to)} as timestamp)")
    if after is not None:
        return page_after(alerts, [("detected_at", True), ("fingerprint", False)], page_size, after)
    ordered = alerts.orderBy("detected_at", "fingerprint", ascending=[False, True])
    return ordered.offset((page - 1) * page_size).limit(page_size)


def alert_counters(alerts: DataFrame) -> DataFrame:
    """Totals shown above the alert list."""
    live = f"status not in ({items(CLOSED)})"
    return alerts.selectExpr(
        f"count_if(severity = 'critical' and {live}) as critical", f"count_if(severity = 'high' and {live}) as high",
        "count_if(status = 'new') as unread", "count_if(status = 'resolved') as resolved", "count(1) as total",
        "count_if(status = 'acknowledged') as acknowledged", "count_if(status = 'dismissed') as dismissed",
    )
