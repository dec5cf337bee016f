"""Data contracts: generate, compile, validate, version (K1-K7)."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

from ..functions.values import name
from .cells import aggregate, side_by_side
from .detect import Expectations
from .history import latest, query
from .profile import first_in_order
from .rules import Rule

MAX_ALLOWED = 20


def _entries(test: str, value: str) -> str:
    """map column -> value over the columns that pass the test, in table order."""
    return (
        f"map_from_entries(transform(array_sort(collect_list(if({test}, struct(ord, column, {value} as v), null))),"
        f" e -> struct(e.column, e.v)))"
    )


def _names(test: str) -> str:
    return f"transform(array_sort(collect_list(if({test}, struct(ord, column), null))), e -> e.column)"


def observed_values(counts: DataFrame, by: list[str]) -> DataFrame:
    """(by..., column, allowed): all values of columns with 2 to 20 distinct ones.

    ``counts``: by..., column, value, n.  At most 21 values per column are kept before they are
    gathered, which is enough to tell 20 from more.
    """
    counts = counts.where("value <> ''").select(*by, "column", "value", "n")
    kept = first_in_order(counts, [*by, "column"], "n desc, value", MAX_ALLOWED + 1)
    grouped = aggregate(kept, [*by, "column"], allowed="transform(array_sort(collect_list(struct(-n as n, value))), v -> v.value)")
    return grouped.where(f"size(allowed) between 2 and {MAX_ALLOWED}")


def contract_from_profile(profiles: DataFrame, counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One contract row per slice from what was observed (K1)."""
    by = by or []
    joined = profiles.join(observed_values(counts, by), [*by, "column"], "left")
    ranged = "min is not null and max is not null"
    dated = "first_timestamp is not null"
    stamp = "date_format({}, \"yyyy-MM-dd'T'HH:mm:ss\")"
    return aggregate(
        joined, by,
        required_columns=_names("missing_rate = 0"),
        unique_columns=_names("unique_rate >= 0.98D and missing_rate = 0"),
        expected_types=_entries("inferred_type <> 'empty'", "inferred_type"),
        allowed_values=_entries("inferred_type = 'text' and allowed is not null", "allowed"),
        numeric_ranges=_entries(f"inferred_type = 'numeric' and {ranged}", "struct(min, max)"),
        date_ranges=_entries(
            f"inferred_type = 'datetime' and {dated}",
            f"struct({stamp.format('first_timestamp')} as min, {stamp.format('last_timestamp')} as max)",
        ),
        pii_columns="array_sort(collect_list(if(sensitivity is not null, column, null)))",
    )


PARAMETERS = "values array<string>, pattern string, min double, max double, max_rate double, type string, days bigint"


def contract_from_rules(rules: DataFrame, profiles: DataFrame, by: list[str]) -> DataFrame:
    """One contract row per slice from its assigned rules; observed values stay out (K2).

    ``rules``: by..., id, name, rule_type, column_name, severity, parameters (JSON).
    Rules about columns the slice does not have are listed as sources but bind nothing.
    """
    known = profiles.selectExpr(*[name(c) for c in by], "column as column_name", "inferred_type")
    bound = rules.join(known, [*by, "column_name"], "left").selectExpr(
        *[name(c) for c in by], "id", "id as ord", "name", "rule_type", "column_name", "column_name as column", "severity",
        "inferred_type is not null as known", f"from_json(parameters, '{PARAMETERS}') as p",
    )
    of = lambda kind, more="true": f"known and rule_type = '{kind}' and {more}"
    last = _entries
    # A later rule on the same column replaces an earlier one.
    newest = first_in_order(bound.where("known and rule_type <> 'duplicate_rows'"), [*by, "rule_type", "column"], "ord desc", 1)
    terms = aggregate(
        newest, by,
        required_columns=_names(of("required")),
        unique_columns=_names(of("unique")),
        rule_types=last(of("expected_type", "p.type in ('numeric', 'datetime', 'text', 'boolean')"), "p.type"),
        allowed_values=last(of("allowed_values"), "p.values"),
        numeric_ranges=last(of("numeric_range"), "struct(p.min, p.max)"),
        length_ranges=last(of("length_range"), "struct(cast(p.min as bigint) as min, cast(p.max as bigint) as max)"),
        missing_thresholds=last(of("missing_threshold", "p.max_rate is not null"), "p.max_rate"),
        freshness_rules=last(of("stale_days", "p.days is not null"), "p.days"),
        email_columns=_names(of("email")),
        patterns=last(of("regex", "p.pattern is not null"), "p.pattern"),
    )
    sources = aggregate(
        bound, by,
        assigned_rules="array_sort(collect_list(struct(id as rule_id, name, rule_type, column_name as column, severity)))",
    )
    observed = aggregate(
        profiles, by,
        observed_types="map_from_entries(collect_list(if(inferred_type <> 'empty', struct(column, inferred_type), null)))",
        pii_columns="array_sort(collect_list(if(sensitivity is not null, column, null)))",
    )
    joined = side_by_side(by, observed, terms, sources).where("observed_types is not null")
    none = "cast(map() as map<string,string>)"
    return joined.selectExpr(
        "* except (observed_types, rule_types)",
        f"map_from_entries(transform(map_keys(observed_types), k -> struct(k, coalesce(coalesce(rule_types, {none})[k], observed_types[k])))) as expected_types",
    )


def to_expectations(contract) -> Expectations:
    """A contract row as inline expectations (K3)."""
    row = contract.asDict(recursive=True)
    pair = lambda bounds: (bounds.get("min"), bounds.get("max"))
    return Expectations(
        required_columns=list(row.get("required_columns") or []),
        unique_columns=list(row.get("unique_columns") or []),
        expected_types=dict(row.get("expected_types") or {}),
        allowed_values={k: list(v) for k, v in (row.get("allowed_values") or {}).items()},
        numeric_ranges={k: pair(v) for k, v in (row.get("numeric_ranges") or {}).items()},
        date_ranges={k: pair(v) for k, v in (row.get("date_ranges") or {}).items()},
        stale_after_days=dict(row.get("freshness_rules") or {}),
    )


def to_rules(contract, first_id: int = 1) -> list[Rule]:
    """Formats, lengths and missing limits of a contract as rules (K3)."""
    row = contract.asDict(recursive=True)
    made: list[tuple[str, str, dict]] = []
    made += [("email", c, {}) for c in row.get("email_columns") or []]
    made += [("regex", c, {"pattern": p}) for c, p in (row.get("patterns") or {}).items()]
    made += [("length_range", c, dict(b)) for c, b in (row.get("length_ranges") or {}).items()]
    made += [("missing_threshold", c, {"max_rate": r}) for c, r in (row.get("missing_thresholds") or {}).items()]
    return [
        Rule(first_id + i, f"{kind} of {column}", kind, column, parameters=params)
        for i, (kind, column, params) in enumerate(made)
    ]


def audit_to_validate(audits: DataFrame) -> DataFrame:
    """Per dataset the newest audit of the highest version, or the newest when none is versioned (K6)."""
    return latest(audits, ["dataset_name"], ["coalesce(dataset_version, -1)", "created_at", "audit_id"])


def schema_violations(contracts: DataFrame, audits: DataFrame, profiles: DataFrame) -> DataFrame:
    """Required columns that are gone, and columns of another type (K4).

    ``contracts``: dataset_name, required_columns, expected_types; ``audits``: dataset_name,
    audit_id, row_count; ``profiles``: audit_id, column, inferred_type.
    """
    return query(
        """with wanted as (
             select c.dataset_name, a.audit_id, a.row_count, t.kind, t.`column`, t.expected from {contracts} c
             join {audits} a on a.dataset_name = c.dataset_name
             lateral view inline(concat(
               transform(required_columns, r -> struct('required_column' as kind, r as `column`, 'column present' as expected)),
               transform(map_entries(expected_types), e -> struct('expected_type' as kind, e.key as `column`, e.value as expected)))) t
           )
           select w.dataset_name, w.audit_id, w.kind, cast(null as bigint) as rule_id, w.`column`, w.expected,
             coalesce(p.inferred_type, 'missing') as observed, w.row_count as affected_rows
           from wanted w left join {profiles} p on p.audit_id = w.audit_id and p.`column` = w.`column`
           where (w.kind = 'required_column' and p.`column` is null)
              or (w.kind = 'expected_type' and p.`column` is not null and p.inferred_type <> w.expected)""",
        contracts=contracts, audits=audits, profiles=profiles,
    )


def rule_violations(contracts: DataFrame, audits: DataFrame, executions: DataFrame) -> DataFrame:
    """Assigned rules that were not run or failed (K5).

    ``contracts`` also has assigned_rules, allowed_values, numeric_ranges.
    """
    bounds = "c.numeric_ranges[s.`column`]"
    shown = lambda side: f"cast({bounds}.{side} as string)"
    return query(
        f"""with assigned as (
             select c.dataset_name, a.audit_id, s.rule_id, s.name, s.rule_type, s.`column`,
               case s.rule_type when 'email' then 'valid email format' when 'required' then 'value present'
                 when 'unique' then 'unique values'
                 when 'allowed_values' then coalesce(array_join(c.allowed_values[s.`column`], ', '), 'configured allowed values')
                 when 'numeric_range' then case
                   when {bounds}.min is not null and {bounds}.max is not null then concat({shown('min')}, ' to ', {shown('max')})
                   when {bounds}.min is not null then concat('>= ', {shown('min')})
                   when {bounds}.max is not null then concat('<= ', {shown('max')}) else 'numeric_range' end
                 else s.rule_type end as expected
             from {{contracts}} c join {{audits}} a on a.dataset_name = c.dataset_name
             lateral view inline(assigned_rules) s
           )
           select g.dataset_name, g.audit_id, if(e.rule_id is null, 'rule_not_executed', 'assigned_rule') as kind, g.rule_id,
             g.`column`, if(e.rule_id is null, g.rule_type, g.expected) as expected,
             if(e.rule_id is null, 'not executed', concat(e.affected_rows, ' affected row(s)')) as observed,
             coalesce(e.affected_rows, 0L) as affected_rows
           from assigned g left join {{executions}} e on e.audit_id = g.audit_id and e.rule_id = g.rule_id
           where e.rule_id is null or e.outcome in ('failed', 'warning')""",
        contracts=contracts, audits=audits, executions=executions,
    )


def validate(contracts: DataFrame, audits: DataFrame, profiles: DataFrame, executions: DataFrame) -> DataFrame:
    """Verdict per dataset against its newest audit of the highest version (K6)."""
    chosen = audit_to_validate(audits)
    found = schema_violations(contracts, chosen, profiles).unionByName(rule_violations(contracts, chosen, executions))
    return query(
        """select c.dataset_name, a.audit_id, a.dataset_version, count(v.kind) as violation_count,
             count_if(v.kind = 'required_column') as missing_columns, count_if(v.kind = 'expected_type') as type_mismatches,
             count_if(v.kind in ('assigned_rule', 'rule_not_executed')) as rule_violations,
             if(count(v.kind) = 0, 'passed', 'failed') as validation_status
           from {contracts} c join {audits} a on a.dataset_name = c.dataset_name
           left join {found} v on v.dataset_name = c.dataset_name
           group by c.dataset_name, a.audit_id, a.dataset_version""",
        contracts=contracts, audits=chosen, found=found,
    )


def append_versions(stored: DataFrame, changes: DataFrame) -> DataFrame:
    """Stored contract versions plus one new version per change, in change order (K7).

    ``changes``: dataset_name, status, changed_at, and optionally name and contract_json;
    what a change leaves out is taken from the version before it.
    """
    return query(
        """with base as (
             select dataset_name, max(version) as top from {stored} group by dataset_name
           ), added as (
             select c.dataset_name, coalesce(b.top, 0) + row_number() over (partition by c.dataset_name order by c.changed_at) as version,
               c.name, c.status, c.contract_json, c.changed_at as created_at
             from {changes} c left join base b on b.dataset_name = c.dataset_name
           ), all_versions as (
             select dataset_name, cast(version as bigint) as version, name, status, contract_json, created_at from {stored}
             union all select dataset_name, cast(version as bigint), name, status, contract_json, created_at from added
           )
           select dataset_name, version, last_value(name, true) over w as name, last_value(status, true) over w as status,
             last_value(contract_json, true) over w as contract_json, created_at
           from all_versions window w as (partition by dataset_name order by version)""",
        stored=stored, changes=changes,
    )


def latest_versions(contracts: DataFrame, key: str = "dataset_name") -> DataFrame:
    """Newest version of each contract (K7)."""
    return latest(contracts, [key], ["version"])


def contract_json(contract) -> str:
    """A contract row as JSON text."""
    return json.dumps(contract.asDict(recursive=True), default=str, sort_keys=True)
