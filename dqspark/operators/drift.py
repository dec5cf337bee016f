"""Schema drift between consecutive versions."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.values import lit, py_round
from ..session import pin
from .history import query


def drift_events(profiles: DataFrame) -> DataFrame:
    """One row per drift event.

    ``profiles``: dataset, version, column, inferred_type, missing_rate, unique_count.
    A profile row is the new side of its own version and the old side of the next one,
    so both sides meet in one aggregate and no self join is needed.
    """
    # A row per column and version; read three times below.
    profiles = pin(profiles.select("dataset", "version", "column", "inferred_type", "missing_rate", "unique_count"))
    sided = query(
        """with steps as (
             select dataset, version, lag(version) over w as before, lead(version) over w as after,
               row_number() over w as place
             from (select distinct dataset, version from {profiles}) window w as (partition by dataset order by version)
           )
           select p.dataset, p.`column`, p.inferred_type, p.missing_rate, p.unique_count, e.*
           from {profiles} p join steps s on p.dataset = s.dataset and p.version = s.version
           lateral view inline(filter(array(
             if(s.before is not null, struct(s.before as baseline, s.version as candidate, s.place as place, true as fresh), null),
             if(s.after is not null, struct(s.version as baseline, s.after as candidate, s.place + 1 as place, false as fresh), null)
           ), x -> x is not null)) e""",
        profiles=profiles,
    )
    paired = query(
        """select dataset, baseline, candidate, place, `column`,
             count_if(not fresh) as olds, count_if(fresh) as news,
             max(if(fresh, null, inferred_type)) as old_type, max(if(fresh, inferred_type, null)) as new_type,
             coalesce(max(if(fresh, null, missing_rate)), 0D) as old_missing, coalesce(max(if(fresh, missing_rate, null)), 0D) as new_missing,
             max(if(fresh, null, unique_count)) as old_unique, max(if(fresh, unique_count, null)) as new_unique
           from {sided} group by dataset, baseline, candidate, place, `column`""",
        sided=sided,
    )
    events = query(
        """with changed as (
             select dataset, baseline, candidate, place, `column` as subject, inline(filter(array(
               if(old_type is distinct from new_type, struct('type_changed' as drift_type, 78L as impact,
                 coalesce(old_type, 'unknown') as before, coalesce(new_type, 'unknown') as after), null),
               if(abs(new_missing - old_missing) >= 0.1D, struct('nullability_changed' as drift_type,
                 least(90L, cast(25D + abs(new_missing - old_missing) * 100D as bigint)) as impact,
                 cast(old_missing as string) as before, cast(new_missing as string) as after), null),
               if(old_unique > 0 and new_unique > 0 and abs(new_unique - old_unique) / cast(old_unique as double) >= 0.3D,
                 struct('cardinality_shift' as drift_type,
                 least(85L, cast(20D + abs(cast(new_unique as double) - old_unique) / old_unique * 55D as bigint)) as impact,
                 cast(old_unique as string) as before, cast(new_unique as string) as after), null)
             ), x -> x is not null))
             from {paired} where olds > 0 and news > 0
           ), shaped as (
             select dataset, baseline, candidate, place, olds = 0 as added, count(1) as n,
               array_join(array_sort(collect_list(`column`)), ',') as subject,
               array_join(transform(array_sort(collect_list(struct(`column`, coalesce(old_type, new_type, 'unknown') as kind))), s -> s.kind), ',') as kinds
             from {paired} where olds = 0 or news = 0 group by dataset, baseline, candidate, place, olds = 0
           )
           select dataset, baseline, candidate, place, drift_type, subject, impact, before, after from changed
           union all
           select dataset, baseline, candidate, place, if(added, 'column_added', 'column_removed'), subject,
             if(added, least(96L, 40L + 14L * n), least(100L, 55L + 15L * n)), if(added, null, kinds), if(added, kinds, null)
           from shaped""",
        paired=paired,
    )
    # An event of the newest version persists if the version before had it too; an older
    # one persists if it comes back later.
    return query(
        """with last as (select dataset, count(distinct version) as newest from {profiles} group by dataset),
           near as (select *, lag(place) over w as earlier, lead(place) over w as later from {events}
             window w as (partition by dataset, drift_type, subject order by place))
           select e.dataset, e.baseline, e.candidate, e.drift_type, e.subject, e.before, e.after,
             greatest(1L, least(100L, e.impact)) as impact_score,
             case when e.impact >= 70 then 'high' when e.impact >= 35 then 'medium' else 'low' end as severity,
             case when e.place = l.newest then if(e.earlier = e.place - 1, 'persistent', 'new')
               when e.later is not null then 'persistent' else 'resolved' end as status,
             concat(e.dataset, ':', e.candidate, ':', e.drift_type, ':', e.subject) as event_id
           from near e join last l on e.dataset = l.dataset""",
        events=events, profiles=profiles,
    )


def drift_listing(
    events: DataFrame, dataset: str | None = None, drift_type: str | None = None, severity: str | None = None,
    status: str | None = None, search: str = "",
) -> DataFrame:
    """Filtered events."""
    for column, wanted in (("dataset", dataset), ("drift_type", drift_type), ("severity", severity), ("status", status)):
        if wanted is not None:
            events = events.where(f"{column} = {lit(wanted)}")
    if search.strip():
        needle = lit(search.strip().lower())
        events = events.where(f"contains(lower(concat_ws(' ', dataset, drift_type, subject)), {needle})")
    return events


def drift_summary(events: DataFrame) -> DataFrame:
    """Totals by severity and mean impact."""
    return events.selectExpr(
        "count(1) as total", "count_if(severity = 'high') as high", "count_if(severity = 'medium') as medium",
        "count_if(severity = 'low') as low", f"coalesce({py_round('avg(impact_score)')}, 0L) as average_impact",
    )


def drift_counts(events: DataFrame) -> DataFrame:
    """Events per type."""
    return events.groupBy("drift_type").count().withColumnRenamed("count", "events")


def drift_trend(events: DataFrame, versions: DataFrame) -> DataFrame:
    """Events per day (X10).  ``versions``: dataset, version, detected_at."""
    return query(
        """select to_date(v.detected_at) as day, count(1) as events from {events} e
           join {versions} v on e.dataset = v.dataset and e.candidate = v.version group by to_date(v.detected_at)""",
        events=events, versions=versions,
    )
