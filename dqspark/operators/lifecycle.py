"""Issue lifecycle from events (L1-L4)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.values import lit
from .history import query

FIELDS = ("status", "owner", "severity", "resolution_note", "resolution_evidence")
ACTIVITY = (
    "audit_id string, issue_id string, action string, field_name string, previous_value string, new_value string,"
    " note string, actor_name string, created_at timestamp"
)


def activity_history(activities: DataFrame, audit_id: str | None = None, issue_id: str | None = None) -> DataFrame:
    """Activities, newest first (L1, L2)."""
    if audit_id is not None:
        activities = activities.where(f"audit_id = {lit(audit_id)}")
    if issue_id is not None:
        activities = activities.where(f"issue_id = {lit(issue_id)}")
    return activities.orderBy("created_at", "audit_id", "issue_id", "field_name", ascending=[False, True, True, True])


def judge_changes(issues: DataFrame, changes: DataFrame) -> DataFrame:
    """Changes with ``rejected`` = the reason a change cannot be taken, else null (L3, L4).

    ``issues``: audit_id, id, category, status, resolution_note, resolution_evidence.
    ``changes``: change_id, audit_id, issue_id, kind (``update`` or ``apply``), the fields to
    set (null = leave), actor_name, changed_at.  What earlier accepted changes of the same issue
    did counts: a note, evidence, a status.
    """
    return query(
        """with joined as (
             select c.*, i.id is not null as known, i.category, i.status as old_status, i.resolution_note as old_note,
               i.resolution_evidence as old_evidence, i.severity as old_severity, i.owner as old_owner, i.recommendation
             from {changes} c left join {issues} i on i.audit_id = c.audit_id and i.id = c.issue_id
           ), noted as (
             select *, coalesce(last_value(resolution_note, true) over (partition by audit_id, issue_id order by changed_at, change_id),
               old_note) as note_so_far from joined
           ), noted_updates as (
             select *, kind = 'update' and (status is null or status not in ('resolved', 'fixed') or note_so_far is not null) as sound
             from noted
           ), early as (
             select *,
               coalesce(last_value(if(sound, resolution_evidence, null), true) over w, old_evidence) as evidence_so_far,
               coalesce(last_value(if(sound, status, null), true) over before, old_status) as status_without_applies
             from noted_updates
             window w as (partition by audit_id, issue_id order by changed_at, change_id),
               before as (partition by audit_id, issue_id order by changed_at, change_id rows between unbounded preceding and 1 preceding)
           ), gated as (
             -- Once a recommendation was applied a note exists; for privacy the note and evidence come first.
             select *, if(category = 'privacy', kind = 'apply' and note_so_far is not null and evidence_so_far is not null,
               max(kind = 'apply' and status_without_applies <> 'fixed') over (partition by audit_id, issue_id order by changed_at, change_id)) as gate
             from early
           ), settled as (
             select *, sound or (kind = 'update' and category <> 'privacy' and gate) as accepted_update from gated
           ), dated as (
             select *, coalesce(last_value(case when kind = 'apply' and gate then 'fixed' when kind = 'update' and accepted_update then status end, true)
               over (partition by audit_id, issue_id order by changed_at, change_id rows between unbounded preceding and 1 preceding),
               old_status) as status_before
             from settled
           )
           select *, case
             when not known then 'unknown issue'
             when kind = 'apply' and status_before = 'fixed' then 'already applied'
             when kind = 'apply' and category = 'privacy' and not gate then 'privacy control needs a note and evidence'
             when kind = 'update' and not accepted_update then 'a resolution note is required'
             end as rejected
           from dated""",
        issues=issues, changes=changes,
    )


# What an accepted change sets, one row per field and change, with the value before it.
_EVENTS = """with accepted as (
    select *, row_number() over (partition by audit_id, issue_id order by changed_at, change_id) as nth
    from {judged}
    where rejected is null and (kind = 'apply' or coalesce(status, owner, severity, resolution_note, resolution_evidence) is not null)
  ), events as (
    select audit_id, issue_id, change_id, changed_at, kind, actor_name, e.*
    from accepted lateral view inline(filter(array(
      named_struct('field_name', 'status', 'initial', old_status, 'value', case when kind = 'apply' then 'fixed' when status is not null then status
        when nth = 1 and old_status = 'reopened' then 'reopened' end),
      named_struct('field_name', 'owner', 'initial', old_owner, 'value', if(kind = 'apply', coalesce(actor_name, 'Workspace team'), owner)),
      named_struct('field_name', 'severity', 'initial', old_severity, 'value', if(kind = 'apply', null, severity)),
      named_struct('field_name', 'resolution_note', 'initial', old_note, 'value', if(kind = 'apply', if(category = 'privacy', null, concat('Applied recommendation: ', recommendation)), resolution_note)),
      named_struct('field_name', 'resolution_evidence', 'initial', old_evidence, 'value', if(kind = 'apply', null, resolution_evidence))
    ), x -> x.value is not null)) e
  ), stored as (
    select *, if(field_name = 'status' and value = 'reopened', 'open', value) as kept from events
  )
  select *, coalesce(lag(kept) over (partition by audit_id, issue_id, field_name order by changed_at, change_id), initial) as previous_value
  from stored"""


def field_events(judged: DataFrame) -> DataFrame:
    """Accepted changes by field: value set, value kept (``open`` for ``reopened``) and value before.

    An applied recommendation sets the status, the owner (who applied it) and, but for
    privacy, the note.  The first update of an issue stored as ``reopened`` opens it.
    """
    return query(_EVENTS, judged=judged)


def change_activities(judged: DataFrame) -> DataFrame:
    """Activity rows of the accepted changes (L1): one per field whose value an update changes.

    A reopened issue gets a second row, as it returns to ``open``; an applied
    recommendation has one row for all it sets.
    """
    return query(
        """select audit_id, issue_id, 'field_updated' as action, field_name, previous_value, value as new_value, cast(null as string) as note,
             actor_name, changed_at as created_at
           from {events} where kind = 'update' and value is distinct from previous_value
           union all
           select audit_id, issue_id, 'reopened', 'status', null, 'open', null, actor_name, changed_at
           from {events} where kind = 'update' and field_name = 'status' and value = 'reopened'
           union all
           select audit_id, issue_id, 'recommendation_applied', 'status', 'open', 'fixed',
             if(category = 'privacy', note_so_far, concat('Applied recommendation: ', recommendation)), actor_name, changed_at
           from {judged} where rejected is null and kind = 'apply'""",
        events=field_events(judged), judged=judged,
    )


def rejected_changes(judged: DataFrame) -> DataFrame:
    return judged.where("rejected is not null").select("change_id", "audit_id", "issue_id", "rejected")


def current_issues(issues: DataFrame, judged: DataFrame) -> DataFrame:
    """Issues after all accepted changes: the last value of each field wins (L3, L4).

    An applied recommendation clears the affected rows.
    """
    last = ", ".join(
        f"max_by(kept, struct(changed_at, change_id)) filter (where field_name = '{field}') as {field}" for field in FIELDS
    )
    return query(
        f"""with state as (
             select audit_id, issue_id, {last}, bool_or(kind = 'apply') as applied, max(changed_at) as updated_at
             from {{events}} group by audit_id, issue_id
           )
           select i.* except ({', '.join(FIELDS)}, affected_rows, affected_rate),
             {', '.join(f'coalesce(s.{field}, i.{field}) as {field}' for field in FIELDS)},
             if(coalesce(s.applied, false), 0L, i.affected_rows) as affected_rows,
             if(coalesce(s.applied, false), 0D, i.affected_rate) as affected_rate, s.updated_at
           from {{issues}} i left join state s on s.audit_id = i.audit_id and s.issue_id = i.id""",
        issues=issues, events=field_events(judged),
    )
