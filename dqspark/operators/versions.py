"""Dataset versions and audit comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions import fixed
from ..functions.values import items
from ..session import pin
from .history import query


def lineage(audits: DataFrame) -> DataFrame:
    """Audits that introduced a source version, numbered 1.. per dataset.

    ``audits``: dataset_name, audit_id, created_at, audit_kind, dataset_version, source.
    Explicit imports keep the first audit of each version and re-runs are left out.
    Older records carry no kind: there a new version starts when the source changes.
    With ``c`` = legacy versions so far, the running maximum version is
    ``c + max(0, explicit - c at that point)``, which gives the number without a loop.

    Running values are taken per dataset and day, then carried over a table of days, so a
    dataset that holds most of the history is still worked on by many tasks.
    """
    local = query(
        f"""with kept as (
              select dataset_name, audit_id, created_at, source, to_date(created_at) as day, cast(dataset_version as bigint) as wanted,
                coalesce(audit_kind in ({items(fixed.AUDIT_KINDS_VERSION)}) and dataset_version > 0, false) as explicit
              from {{audits}} where audit_kind is null or audit_kind not in ({items(fixed.AUDIT_KINDS_RERUN)})
            )
            select *, row_number() over w as place, last_value(source, true) over (partition by dataset_name, day
              order by created_at, audit_id rows between unbounded preceding and 1 preceding) as source_before
            from kept window w as (partition by dataset_name, day order by created_at, audit_id)""",
        audits=audits,
    )
    local = pin(local)
    started = query(
        """with days as (
             select dataset_name, day, max_by(source, struct(created_at, audit_id)) filter (where source is not null) as closing
             from {local} group by dataset_name, day
           ), carried as (
             select dataset_name, day, row_number() over (partition by dataset_name order by day) = 1 as first_day,
               last_value(closing, true) over (partition by dataset_name order by day rows between unbounded preceding and 1 preceding) as carry
             from days
           ), marked as (
             select l.*, not l.explicit and ((c.first_day and l.place = 1)
               or (l.source is not null and l.source is distinct from coalesce(l.source_before, c.carry))) as starts
             from {local} l join carried c on c.dataset_name = l.dataset_name and c.day = l.day
           ), counted as (
             select *, count_if(starts) over (partition by dataset_name, day order by created_at, audit_id) as c from marked
           )
           select *, max(if(explicit, wanted - c, null)) over (partition by dataset_name, day order by created_at, audit_id) as lead
           from counted""",
        local=local,
    )
    started = pin(started)
    return query(
        """with days as (
             select dataset_name, day, count_if(starts) as c, max(lead) as lead from {started} group by dataset_name, day
           ), summed as (
             select *, coalesce(sum(c) over (partition by dataset_name order by day rows between unbounded preceding and 1 preceding), 0L)
               as c_before from days
           ), carried as (
             select dataset_name, day, c_before, max(lead - c_before) over (partition by dataset_name order by day
               rows between unbounded preceding and 1 preceding) as lead_before from summed
           ), numbered as (
             select s.*, if(s.explicit, s.wanted,
               d.c_before + s.c + greatest(0L, coalesce(d.lead_before, 0L), coalesce(s.lead - d.c_before, 0L))) as number
             from {started} s join carried d on d.dataset_name = s.dataset_name and d.day = s.day
           ), firsts as (
             select dataset_name, number, min_by(struct(audit_id, created_at, source), struct(created_at, audit_id)) as row
             from numbered where explicit or starts group by dataset_name, number
           )
           select dataset_name, row.audit_id, row.created_at, row.source,
             row_number() over (partition by dataset_name order by number) as version
           from firsts""",
        started=started,
    )


def current_version(audits: DataFrame) -> DataFrame:
    """(dataset_name, current_version)."""
    return query(
        """select a.dataset_name, greatest(1L, coalesce(v.versions, 0L)) as current_version
           from (select distinct dataset_name from {audits}) a
           left join (select dataset_name, count(1) as versions from {versions} group by dataset_name) v
             on a.dataset_name = v.dataset_name""",
        audits=audits, versions=lineage(audits),
    )


def version_list(audits: DataFrame, shapes: DataFrame) -> DataFrame:
    """Every version with its shape and score (X11).  ``shapes``: audit_id, row_count, column_count."""
    return query(
        """select v.dataset_name, v.version, v.audit_id, v.created_at, v.source, a.score, a.risk_level, a.issue_count,
             s.row_count, s.column_count,
             v.version = max(v.version) over (partition by v.dataset_name) as is_latest
           from {versions} v join {audits} a on v.audit_id = a.audit_id left join {shapes} s on v.audit_id = s.audit_id""",
        versions=lineage(audits), audits=audits, shapes=shapes,
    )


def audit_pairs(audits: DataFrame) -> DataFrame:
    """(baseline_audit_id, candidate_audit_id) of consecutive versions."""
    return query(
        """select * from (select dataset_name, lag(audit_id) over (partition by dataset_name order by version) as
             baseline_audit_id, audit_id as candidate_audit_id, version from {versions})
           where baseline_audit_id is not null""",
        versions=lineage(audits),
    )


def compare_totals(pairs: DataFrame, totals: DataFrame) -> DataFrame:
    """Deltas per pair (X3).  ``totals``: audit_id, score, issue_count, row_count, column_count."""
    return query(
        """select p.baseline_audit_id, p.candidate_audit_id, c.score - b.score as score_delta,
             c.issue_count - b.issue_count as issue_count_delta, c.row_count - b.row_count as row_count_delta,
             c.column_count - b.column_count as column_count_delta
           from {pairs} p join {totals} b on b.audit_id = p.baseline_audit_id
             join {totals} c on c.audit_id = p.candidate_audit_id""",
        pairs=pairs, totals=totals,
    )


def _sides(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """Each audited row once per pair it belongs to, marked ``old`` or ``new``."""
    return query(
        """select p.baseline_audit_id, p.candidate_audit_id, p.side, r.*
           from (select baseline_audit_id, candidate_audit_id,
                   inline(array(struct(baseline_audit_id as audit_id, 'old' as side),
                                struct(candidate_audit_id as audit_id, 'new' as side))) from {pairs}) p
           join {rows} r on r.audit_id = p.audit_id""",
        pairs=pairs, rows=rows,
    )


def compare_issues(pairs: DataFrame, issues: DataFrame) -> DataFrame:
    """New, resolved and persistent issues by (title, columns)."""
    return query(
        """select baseline_audit_id, candidate_audit_id, title, columns,
             coalesce(max(if(side = 'new', category, null)), max(category)) as category,
             coalesce(max(if(side = 'new', severity, null)), max(severity)) as severity,
             case when count_if(side = 'old') = 0 then 'new' when count_if(side = 'new') = 0 then 'resolved'
               else 'persistent' end as change
           from {sides} group by baseline_audit_id, candidate_audit_id, title, columns""",
        sides=_sides(pairs, issues),
    )


def compare_columns(pairs: DataFrame, profiles: DataFrame) -> DataFrame:
    """Per shared or one-sided column: completeness change, presence and type change."""
    return query(
        """select baseline_audit_id, candidate_audit_id, `column`,
             case when old_n = 0 then 'added' when new_n = 0 then 'removed' else 'shared' end as presence,
             case when old_n = 0 or new_n = 0 then null when new_missing > old_missing then 'worsened'
               when new_missing < old_missing then 'improved' else 'same' end as completeness,
             old_type as type_before, new_type as type_after,
             old_n > 0 and new_n > 0 and old_type is distinct from new_type as type_changed
           from (select baseline_audit_id, candidate_audit_id, `column`,
               count_if(side = 'old') as old_n, count_if(side = 'new') as new_n,
               max(if(side = 'old', missing_rate, null)) as old_missing, max(if(side = 'new', missing_rate, null)) as new_missing,
               max(if(side = 'old', inferred_type, null)) as old_type, max(if(side = 'new', inferred_type, null)) as new_type
             from {sides} group by baseline_audit_id, candidate_audit_id, `column`)""",
        sides=_sides(pairs, profiles),
    )
