"""One audit, or the audits of many slices, end to end.

    profile -> issues -> rules -> score -> summary

The data is read four times by ``state.observe``; everything after works on the tables of
that state, and on ones of a row per column, rule or issue.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators import detect, score
from ..operators.cells import aggregate
from ..operators.duplicates import excess
from ..operators.profile import DEFAULT, Options, column_profiles, dataset_profile, described, outlier_measures, with_distinct
from ..operators.rules import Rule, executions_from, rule_issues
from ..session import pin
from .state import State, observe


@dataclass
class Audit:
    """The tables an audit writes; each is keyed by the slice columns when there are any."""

    columns: DataFrame
    dataset: DataFrame
    issues: DataFrame
    executions: DataFrame | None
    deductions: DataFrame
    score: DataFrame
    summary: DataFrame
    by: list[str]
    state: State | None = None


def audit(
    df: DataFrame,
    rules: list[Rule] | None = None,
    expectations: detect.Expectations | None = None,
    by: list[str] | None = None,
    options: Options = DEFAULT,
    context: score.ScoringContext = score.DEFAULT_CONTEXT,
) -> Audit:
    """Audit a table.  With ``by`` every distinct slice gets its own audit in the same jobs."""
    return conclude(observe(df, rules, expectations, by, options, keep=False), context)


def conclude(state: State, context: score.ScoringContext = score.DEFAULT_CONTEXT) -> Audit:
    """The audit of what a state has seen."""
    layout, options, by, rules = state.layout, state.options, state.by, list(state.rules)
    measures = with_distinct(state.counted, layout, options)
    outliers = outlier_measures(state.df, layout, measures, options, state.counted)
    scored = pin(described(layout, measures, outliers, options))
    profiles = column_profiles(layout, scored, options)
    duplicates = pin(excess(state.rows, layout))
    dataset = dataset_profile(profiles, duplicates, by)
    checks = detect.row_checks(layout, state.expectations, options)
    issues = detect.issues_from(layout, scored, duplicates, state.counted, state.checks, checks, state.expectations, options, state.df)
    executions = None
    if rules:
        executions = pin(executions_from(state.checks, len(checks), scored, duplicates, layout, rules, options))
        issues = pin(issues)
        if by:
            found = aggregate(issues, by, found="count(1)")
            numbered, first = executions.join(found, by, "left"), "coalesce(found, 0L) + 1"
        else:
            numbered, first = executions, f"{issues.count() + 1}"
        failed = rule_issues(numbered, rules, list(layout.columns), by, first)
        issues = issues.unionByName(failed)
    issues = pin(issues)
    costs = score.deductions(issues, by, context)
    scores = pin(score.score(costs, dataset, by, context))
    return Audit(profiles, dataset, issues, executions, costs, scores, score.summary(issues, scores, by), by, state)
