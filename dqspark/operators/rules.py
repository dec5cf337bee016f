"""Reusable quality rules (R1-R19): each rule becomes one SQL predicate, true = violation."""

from __future__ import annotations

import re
from functools import reduce
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions import fixed, values
from ..functions.patterns import UnsafePattern, refuse_unsafe
from ..functions.values import lit, name, py_round, ratio
from ..session import pin
from .cells import Layout, aggregate, counting_key, side_by_side, value_counts
from .detect import count_rows
from .duplicates import copies, duplicate_counts, row_digest
from .profile import DEFAULT, Options, distinct_measures

RULES_SCHEMA = (
    "id bigint, name string, description string, rule_type string, scope string, column_name string, category string,"
    " severity string, parameters string, recommendation string, is_active boolean"
)


class RuleError(ValueError):
    """A rule that cannot be compiled."""


@dataclass(frozen=True)
class Rule:
    id: int
    name: str
    rule_type: str
    column_name: str | None = None
    scope: str = "column"
    category: str = "validity"
    severity: str = "medium"
    parameters: dict = field(default_factory=dict)
    recommendation: str | None = None
    is_active: bool = True
    description: str | None = None


def validate_rule(rule: Rule) -> Rule:
    """Refuse rules that cannot run."""
    if rule.rule_type not in fixed.RULE_TYPES:
        raise RuleError(f"unknown rule type {rule.rule_type!r}")
    if rule.scope == "column" and not rule.column_name:
        raise RuleError("a column rule names its column")
    if rule.scope == "dataset" and rule.rule_type != "duplicate_rows":
        raise RuleError("duplicate_rows is the only dataset-level rule")
    wanted = fixed.REQUIRED_PARAMETER.get(rule.rule_type)
    if wanted and wanted not in rule.parameters:
        raise RuleError(f"{rule.rule_type} needs the parameter {wanted!r}")
    if rule.rule_type == "regex":
        java_pattern(str(rule.parameters["pattern"]))
    return rule


def java_pattern(pattern: str) -> str:
    """A user pattern as a full-match Java pattern; refuses syntax the two dialects do not share."""
    translated = re.sub(r"\(\?P<([A-Za-z]\w*)>", r"(?<\1>", pattern)
    translated = re.sub(r"\(\?P=([A-Za-z]\w*)\)", r"\\k<\1>", translated)
    if re.search(r"\(\?\(|\(\?P", translated):
        raise RuleError(f"unsupported pattern syntax in {pattern!r}")
    try:
        re.compile(pattern)
    except re.error as problem:
        raise RuleError(f"invalid pattern {pattern!r}: {problem}") from problem
    try:
        refuse_unsafe(pattern)
    except UnsafePattern as problem:
        raise RuleError(str(problem)) from problem
    return f"(?U)^(?:{translated})$"


def predicate(rule: Rule, types: dict[str, T.DataType], options: Options = DEFAULT) -> str | None:
    """Row predicate of a rule; None for rules that need more than one row (unique, duplicate_rows)."""
    params, kind = rule.parameters, rule.rule_type
    if kind == "duplicate_rows":
        return None
    if rule.column_name not in types:
        return "true"
    value, dtype = name(rule.column_name), types[rule.column_name]
    text = values.text_of(value, dtype)
    absent = values.missing_in(value, dtype)
    present = f"not {absent}"
    if kind == "unique":
        return None
    if kind in ("required", "missing_threshold"):
        return absent
    if kind == "email":
        return f"({present} and not {values.is_email(text)})"
    if kind == "allowed_values":
        return f"({present} and not {values.among(text, [str(v) for v in params.get('values', [])])})"
    if kind == "regex":
        return f"({present} and not {values.matches(text, java_pattern(str(params.get('pattern', '.*'))))})"
    if kind == "numeric_range":
        number = values.number_of(value, dtype)
        sides = [f"({number}) is null"]
        if params.get("min") is not None:
            sides.append(f"({number}) < {float(params['min'])!r}D")
        if params.get("max") is not None:
            sides.append(f"({number}) > {float(params['max'])!r}D")
        return f"({present} and ({' or '.join(sides)}))"
    if kind == "length_range":
        sides = []
        if params.get("min") is not None:
            sides.append(f"char_length({text}) < {int(params['min'])}")
        if params.get("max") is not None:
            sides.append(f"char_length({text}) > {int(params['max'])}")
        return f"({present} and ({' or '.join(sides)}))" if sides else "false"
    if kind == "expected_type":
        parsed = {
            "numeric": values.number_of(value, dtype),
            "datetime": values.timestamp_of(value, dtype),
            "boolean": f"nullif({values.in_tokens(text, fixed.RULE_BOOLEAN_TOKENS)}, false)",
        }.get(str(params.get("type", "text")))
        return f"({present} and ({parsed}) is null)" if parsed else "false"
    if kind == "stale_days":
        moment = values.timestamp_of(value, dtype)
        cut = values.days_back(options.now, int(params.get("days", 30)))
        return f"({present} and (({moment}) is null or ({moment}) < {cut}))"
    raise RuleError(f"unknown rule type {kind!r}")


def _message(rule: Rule, types: dict) -> str:
    """Text for an execution row, over ``affected_rows`` and ``counted_rate``."""
    column = rule.column_name or ""
    count = "cast(affected_rows as string)"
    said = lambda tail: f"concat({count}, {lit(tail)})"
    if rule.rule_type == "duplicate_rows":
        return said(" rows have a full copy.")
    if rule.column_name not in types:
        return lit(f"Column '{column}' is not in the dataset.")
    if rule.rule_type == "missing_threshold":
        limit = float(rule.parameters.get("max_rate", 0))
        over = (
            f"concat('Missing rate ', {values.percent_text('counted_rate', 2)},"
            f" {lit(f' is above the limit {limit:.2%} in {column}.')})"
        )
        return f"if(affected_rows = 0, {lit(f'Missing rate is within the limit {limit:.0%}.')}, {over})"
    tail = {
        "required": f" rows lack a value in {column}.",
        "unique": f" rows repeat a value in {column}.",
        "email": f" rows hold a malformed email in {column}.",
        "allowed_values": f" rows hold a value outside the allowed set in {column}.",
        "regex": f" rows do not match the pattern in {column}.",
        "numeric_range": f" rows are outside the numeric range in {column}.",
        "length_range": f" rows are outside the length range in {column}.",
        "expected_type": f" rows are not of the expected type in {column}.",
        "stale_days": f" rows are older than allowed in {column}.",
    }[rule.rule_type]
    return said(tail)


def execute_rules(
    df: DataFrame, rules: list[Rule], by: list[str] | None = None, options: Options = DEFAULT, with_rows: bool = False
) -> DataFrame:
    """One row per (slice and) rule: outcome, affected rows and rate, message.

    ``with_rows`` adds ``row_count``, the rows checked.  All row rules share one aggregate; unique rules share one value-frequency pass;
    duplicate-row rules share one digest pass.
    """
    layout = Layout.of(df, by or [])
    rules = [validate_rule(rule) for rule in rules]
    counted, keys = count_rows(df, layout, rule_predicates(rules, layout, options)), list(layout.by)
    unique = unique_columns(rules, layout)
    if unique:
        counted = side_by_side(keys, counted, repeated_rows(distinct_measures(df, layout, unique), layout, unique))
    if any(rule.rule_type == "duplicate_rows" for rule in rules):
        counted = side_by_side(keys, counted, duplicate_counts(df, layout))
    return rated_rules(counted, 0, layout, rules, options, with_rows)


def rule_predicates(rules: list[Rule], layout: Layout, options: Options = DEFAULT) -> list[str]:
    """One row predicate per rule; false for rules that need more than one row."""
    types = {c: layout.types[c] for c in layout.columns}
    return [predicate(rule, types, options) or "false" for rule in rules]


def unique_columns(rules: list[Rule], layout: Layout) -> list[str]:
    return sorted({r.column_name for r in rules if r.rule_type == "unique" and r.column_name in layout.columns})


def repeated_rows(measures: DataFrame, layout: Layout, columns: list[str]) -> DataFrame:
    """(by..., u<ord>...): rows that repeat a value of a column, one row per slice."""
    return aggregate(measures, list(layout.by), **{f"u{layout.ordinal(c)}": f"max(if(ord = {layout.ordinal(c)}, repeated_rows, null))" for c in columns})


def executions_from(
    checks: DataFrame, first: int, measures: DataFrame, duplicates: DataFrame, layout: Layout, rules: list[Rule], options: Options = DEFAULT
) -> DataFrame:
    """``execute_rules`` from what an audit has counted already: rule i's rows are column p<first + i> of ``checks``."""
    keys, unique, counted = list(layout.by), unique_columns(rules, layout), checks
    if unique:
        counted = side_by_side(keys, counted, repeated_rows(measures, layout, unique))
    if any(rule.rule_type == "duplicate_rows" for rule in rules):
        counted = side_by_side(keys, counted, duplicates)
    return rated_rules(counted, first, layout, rules, options, False)


def rated_rules(counted: DataFrame, first: int, layout: Layout, rules: list[Rule], options: Options, with_rows: bool) -> DataFrame:
    """Executions from one row of counts per slice."""
    types = {c: layout.types[c] for c in layout.columns}
    entries = []
    for place, rule in enumerate(rules):
        rows = f"p{first + place}"
        if rule.rule_type == "duplicate_rows":
            rows = "coalesce(rows_in_duplicate_groups, 0L)"
        elif rule.rule_type == "unique" and rule.column_name in types:
            rows = f"coalesce(u{layout.ordinal(rule.column_name)}, 0L)"
        elif rule.rule_type == "missing_threshold" and rule.column_name in types:
            rows = f"if({ratio(rows, 'row_count')} <= {float(rule.parameters.get('max_rate', 0))!r}D, 0L, {rows})"
        entries.append(
            f"struct({place} as nth, {rule.id}L as rule_id, {lit(rule.name)} as rule_name, {lit(rule.rule_type)} as rule_type,"
            f" {rows} as affected_rows)"
        )
    if not entries:
        raise RuleError("no rule to execute")
    melted = counted.selectExpr(*layout.slices, "row_count", f"inline(array({', '.join(entries)}))")
    rated = melted.selectExpr("*", f"{ratio('affected_rows', 'row_count')} as counted_rate")
    message = "case nth " + " ".join(f"when {i} then {_message(r, types)}" for i, r in enumerate(rules)) + " end"
    return rated.selectExpr(
        *layout.slices, "rule_id", "rule_name", "rule_type", "if(affected_rows > 0, 'failed', 'passed') as outcome",
        "affected_rows", f"{py_round('counted_rate', 4)} as affected_rate", f"{message} as message",
        f"{options.now} as executed_at", *(["row_count"] if with_rows else []),
    )


def rule_issues(executions: DataFrame, rules: list[Rule], columns: list[str], by: list[str] | None = None, first: str = "1") -> DataFrame:
    """Failed executions as issues (R13).  ``first`` is an expression for the first number."""
    by = by or []
    table = {rule.id: rule for rule in rules}
    pick = lambda get: "case rule_id " + " ".join(f"when {k}L then {get(r)}" for k, r in table.items()) + " end"
    place = "case rule_id " + " ".join(f"when {rule.id}L then {i}" for i, rule in enumerate(rules)) + " end"
    number = f"({place}) + {first}"
    all_columns = f"array({values.items(columns)})"
    return executions.where("outcome = 'failed'").selectExpr(
        *[name(c) for c in by],
        f"concat('QR-', lpad(cast({number} as string), greatest(3, length(cast({number} as string))), '0')) as id",
        f"{pick(lambda r: lit(r.category))} as category", f"{pick(lambda r: lit(r.severity))} as severity",
        "concat(rule_name, ' failed') as title",
        f"{pick(lambda r: f'array({lit(r.column_name)})' if r.column_name else all_columns)} as columns",
        "affected_rows", "affected_rate",
        f"{pick(lambda r: lit(r.recommendation or f'repair:{r.rule_type}'))} as recommendation",
        "1D as confidence", "'open' as status", "rule_id", "rule_name",
    )


def violations(df: DataFrame, rules: list[Rule], key: list[str], options: Options = DEFAULT) -> DataFrame:
    """(key..., rule_id): every row that breaks a rule, once per rule.

    Row rules are read off the row itself.  Repeated values and repeated rows are found
    by counting, then rows are flagged by a semi join on the repeated ones; no value is
    gathered, and a hot value's rows may be split by the adaptive skew join.
    """
    layout = Layout.of(df)
    types = dict(layout.types)
    keyed = [name(c) for c in key]
    rules = [validate_rule(r) for r in rules]
    tests = {r.id: predicate(r, types, options) for r in rules}
    shares = [r for r in rules if r.rule_type == "missing_threshold" and r.column_name in types]
    within = set()
    if shares:
        seen = df.selectExpr(*[f"coalesce(avg(if({tests[r.id]}, 1D, 0D)), 0D) as s{i}" for i, r in enumerate(shares)]).first()
        within = {r.id for r, share in zip(shares, seen, strict=True) if share <= float(r.parameters.get("max_rate", 0))}
    marks = [f"if({tests[r.id]}, {r.id}L, null)" for r in rules if tests[r.id] is not None and r.id not in within]
    parts = []
    if marks:
        parts.append(df.selectExpr(*keyed, f"explode(filter(array({', '.join(marks)}), r -> r is not null)) as rule_id"))
    unique = [r for r in rules if tests[r.id] is None and r.rule_type != "duplicate_rows"]
    if unique:
        # One pass counts the values of all unique columns, one more flags the rows that hold a repeated one.
        repeated = value_counts(df, layout, sorted({r.column_name for r in unique})).where("value <> '' and n > 1").select("ord", "value")
        held = ", ".join(
            f"struct({layout.ordinal(r.column_name)} as ord, {counting_key(values.text_of(name(r.column_name), types[r.column_name]))} as value, {r.id}L as rule_id)"
            for r in unique
        )
        flagged = df.selectExpr(*keyed, f"inline(array({held}))").join(repeated, ["ord", "value"], "left_semi")
        parts.append(flagged.selectExpr(*keyed, "rule_id"))
    for rule in rules:
        if rule.rule_type == "duplicate_rows":
            repeated = copies(df, layout).where("copies > 1").select("digest")
            flagged = df.selectExpr(*keyed, f"{row_digest(layout)} as digest").join(repeated, "digest", "left_semi")
            parts.append(flagged.selectExpr(*keyed, f"{rule.id}L as rule_id"))
    if not parts:
        return df.where("false").selectExpr(*keyed, "0L as rule_id")
    return reduce(DataFrame.unionByName, parts)


def dry_run(df: DataFrame, rule: Rule, options: Options = DEFAULT) -> DataFrame:
    """Try one rule without storing anything, with its estimated score impact."""
    weight = fixed.IMPACT_WEIGHT.get(rule.severity, 0.45)
    impact = py_round(f"affected_rate * 100D * {weight}D", 1)
    run = execute_rules(df, [rule], options=options, with_rows=True)
    return run.selectExpr(
        "outcome", "affected_rows", f"{py_round('affected_rate * 100D', 2)} as affected_percentage", "row_count as total_rows",
        "message", f"least(25D, {impact}) as estimated_score_impact",
    )


def rules_table(spark, rules: list[Rule]) -> DataFrame:
    """Rule definitions as a table."""
    import json

    rows = [
        (r.id, r.name, r.description, r.rule_type, r.scope, r.column_name, r.category, r.severity,
         json.dumps(r.parameters), r.recommendation, r.is_active)
        for r in rules
    ]
    return spark.createDataFrame(rows, RULES_SCHEMA)


def rules_from_table(table: DataFrame) -> list[Rule]:
    """Read active rules back; a rule set is small by nature."""
    import json

    return [
        Rule(r["id"], r["name"], r["rule_type"], r["column_name"], r["scope"], r["category"], r["severity"],
             json.loads(r["parameters"] or "{}"), r["recommendation"], r["is_active"], r["description"])
        for r in table.where("is_active").orderBy("id").collect()
    ]


def assigned_rules(rules: DataFrame, assignments: DataFrame, dataset_id: int | None = None) -> DataFrame:
    """Active rules with an active assignment, by rule id."""
    live = assignments.where("is_active").selectExpr("rule_id as id", "dataset_id")
    if dataset_id is not None:
        live = live.where(f"dataset_id = {int(dataset_id)}")
    return rules.where("is_active").join(live, "id").orderBy("dataset_id", "id")


def bulk_assign(
    assignments: DataFrame, rule_ids: list[int], datasets: DataFrame, action: str = "assign"
) -> DataFrame:
    """New assignments snapshot after (un)assigning the given rules to the given datasets.

    ``changed`` marks rows that were switched or added.
    """
    on = lit(action == "assign")
    wanted = ", ".join(f"{int(r)}L" for r in sorted(set(rule_ids)))
    chosen = datasets.selectExpr("id as dataset_id").distinct().selectExpr("dataset_id", f"explode(array({wanted})) as rule_id")
    merged = assignments.withColumnRenamed("is_active", "was").join(
        chosen.selectExpr("*", "true as chosen"), ["rule_id", "dataset_id"], "full_outer"
    )
    return merged.where(f"was is not null or {on}").selectExpr(
        "rule_id", "dataset_id", f"if(coalesce(chosen, false), {on}, was) as is_active",
        f"coalesce(chosen, false) and was is distinct from {on} as changed",
    )


def replace_executions(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Executions snapshot with those of the re-run audits replaced."""
    kept = stored.join(fresh.select("audit_id").distinct(), "audit_id", "left_anti")
    return kept.unionByName(fresh)
