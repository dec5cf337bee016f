"""Reliability score, audit summary and readiness."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, values
from ..functions.values import lit, name, py_round
from .cells import aggregate, side_by_side
from .profile import first_in_order

DIMENSIONS = tuple(fixed.DIMENSION_WEIGHT)


@dataclass(frozen=True)
class ScoringContext:
    criticality: str = "medium"
    accepted_risk_discount: float = fixed.ACCEPTED_RISK_DISCOUNT
    rule_multiplier: float = fixed.RULE_MULTIPLIER
    weights: dict[str, float] = field(default_factory=dict)

    def shares(self) -> dict[str, float]:
        """Dimension weights, negative ones as 0, scaled to sum to 1."""
        raw = {d: max(float(self.weights.get(d, w)), 0.0) for d, w in fixed.DIMENSION_WEIGHT.items()}
        total = sum(raw.values()) or 1.0
        return {d: w / total for d, w in raw.items()}


DEFAULT_CONTEXT = ScoringContext()


def deductions(issues: DataFrame, by: list[str] | None = None, context: ScoringContext = DEFAULT_CONTEXT) -> DataFrame:
    """One row per active issue with what it costs (C1-C3).  ``penalty`` is unrounded."""
    level = fixed.CRITICALITY[context.criticality]
    raw = f"{values.lookup('severity', fixed.SEVERITY_WEIGHT)} * {values.breadth('affected_rate')}"
    by_rule = f"if(rule_id is not null, {float(context.rule_multiplier)!r}D, 1D)"
    by_status = (
        f"case status when 'accepted_risk' then {float(context.accepted_risk_discount)!r}D"
        " when 'in_progress' then 0.9D else 1D end"
    )
    active = issues.where(f"not {values.among('status', fixed.INACTIVE_STATUSES)}")
    weighed = active.selectExpr(
        *[name(c) for c in by or []], "id as issue_id", "severity", "status", "affected_rate",
        f"coalesce({values.lookup('category', fixed.CATEGORY_DIMENSION)}, 'reliability') as dimension",
        f"{raw} as raw",
        f"{raw} * (0.75D + 0.25D * confidence) * {by_rule} * {float(level)!r}D * {by_status} as penalty",
    )
    return weighed.selectExpr(
        *[name(c) for c in by or []], "issue_id", "dimension", "severity", "status", "affected_rate",
        f"{py_round('raw', 3)} as raw_penalty", f"{py_round('penalty', 3)} as weighted_penalty", "penalty",
    )


def top_deductions(costs: DataFrame, by: list[str] | None = None, k: int = 10) -> DataFrame:
    """The k costliest issues per audit."""
    if by:
        return first_in_order(costs, by, "weighted_penalty desc, issue_id", k)
    most = costs.orderBy(F.desc("weighted_penalty"), "issue_id").limit(int(k))
    return most.selectExpr("*", "row_number() over (order by weighted_penalty desc, issue_id) as place")  # of k rows


def score(
    costs: DataFrame, datasets: DataFrame, by: list[str] | None = None, context: ScoringContext = DEFAULT_CONTEXT
) -> DataFrame:
    """Dimension and overall scores of each audit.

    ``datasets`` has one row per audit with ``duplicate_row_rate``; audits without an
    issue keep their row.
    """
    by = by or []
    level = fixed.CRITICALITY[context.criticality]
    sums = {d: f"coalesce(sum(if(dimension = '{d}', penalty, 0D)), 0D)" for d in DIMENSIONS}
    total = aggregate(
        costs, by, **{f"{d}_penalty": s for d, s in sums.items()},
        active_issue_count="count(1)", accepted_risk_count="count_if(status = 'accepted_risk')",
    )
    joined = side_by_side(by, datasets.select(*by, "duplicate_row_rate"), total).where("duplicate_row_rate is not null")
    repeated = (
        f"if(duplicate_row_rate > 0, least(15D, 4D + 18D * sqrt(duplicate_row_rate)) * {float(level)!r}D, 0D)"
    )
    spent = joined.selectExpr(
        *[name(c) for c in by], "coalesce(active_issue_count, 0L) as active_issue_count",
        "coalesce(accepted_risk_count, 0L) as accepted_risk_count",
        *[
            f"coalesce({d}_penalty, 0D){' + ' + repeated if d == 'uniqueness' else ''} as {d}_penalty"
            for d in DIMENSIONS
        ],
    )
    scored = spent.selectExpr(
        "*", *[f"greatest(0L, least(100L, {py_round(f'100D - {d}_penalty')})) as {d}" for d in DIMENSIONS]
    )
    overall = " + ".join(f"{d} * {share!r}D" for d, share in context.shares().items())
    penalty = " + ".join(f"{d}_penalty" for d in DIMENSIONS)
    return scored.selectExpr(
        *[name(c) for c in by], f"{py_round(overall)} as overall", *DIMENSIONS, "active_issue_count",
        "accepted_risk_count", f"{py_round(penalty, 3)} as total_weighted_penalty",
    )


def rescore(issues: DataFrame, datasets: DataFrame, context: ScoringContext, by: list[str] | None = None) -> DataFrame:
    """Score stored issues under another context; the data is not read again."""
    return score(deductions(issues, by, context), datasets, by, context)


def health(score_column: str) -> str:
    """Dataset status by score."""
    return f"case when {score_column} >= 80 then 'healthy' when {score_column} >= 60 then 'warning' else 'review_needed' end"


def active_count(status: str = "status") -> str:
    return f"count_if(not {values.among(status, fixed.INACTIVE_STATUSES)})"


def summary(issues: DataFrame, scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Risk level and issue counts by severity and category per audit."""
    by = by or []
    counts = {f"{s}_issues": f"count_if(severity = '{s}')" for s in fixed.SEVERITIES}
    counts |= {f"{c}_issues": f"count_if(category = '{c}')" for c in fixed.CATEGORIES}
    total = aggregate(issues, by, issue_count="count(1)", **counts)
    filled = side_by_side(by, scores, total).where("overall is not null").fillna(0, ["issue_count", *counts])
    risk = (
        "case when overall < 60 or critical_issues > 0 then 'critical' when overall < 75 or high_issues > 0 then 'high'"
        " when overall < 90 or medium_issues > 0 then 'medium' else 'low' end"
    )
    return filled.selectExpr(*[name(c) for c in by], "overall", f"{risk} as risk_level", "issue_count", *counts)


def top_issues(issues: DataFrame, by: list[str], k: int = 5, order: str = "rate") -> DataFrame:
    """Worst issues per audit (C9 top three, C11).

    ``order='rate'``: severity, share of rows, confidence; ``'rows'``: severity, rows;
    ``'id'``: severity, then detection order.
    """
    rank = values.lookup("severity", fixed.SEVERITY_RANK)
    by_order = {
        "rate": f"{rank} desc, affected_rate desc, confidence desc, id",
        "rows": f"{rank} desc, affected_rows desc, id",
        "id": f"{rank} desc, id",
    }[order]
    return first_in_order(issues, by, by_order, k)


def issues_about(issues: DataFrame, column: str) -> DataFrame:
    """Issues that name a column."""
    return issues.where(f"array_contains(columns, {lit(column)})")


def privacy_safe_context(profiles: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Profile fields that reveal no single text value."""
    return profiles.selectExpr(
        *[name(c) for c in by or []], "column", "inferred_type", "missing_rate", "unique_rate", "min", "max", "mean", "median"
    )


def privacy_safe_issues(issues: DataFrame, by: list[str] | None = None, k: int = 8) -> tuple[DataFrame, DataFrame]:
    """Issue half of the privacy-safe context (S13): counts, and the first k issues without examples.

    Counts are two maps per slice, by severity and by category.
    """
    by = by or []
    counted = aggregate(issues, [*by, "severity", "category"], n="count(1)")
    maps = {
        f"by_{c}": f"map_from_entries(collect_list(struct({c}, n)) filter (where side = '{c}'))" for c in ("severity", "category")
    }
    sides = [aggregate(counted, [*by, c], n="sum(n)").selectExpr(*[name(b) for b in by], f"'{c}' as side", *[name(x) if x == c else f"cast(null as string) as {name(x)}" for x in ("severity", "category")], "n") for c in ("severity", "category")]
    counts = aggregate(sides[0].unionByName(sides[1]), by, **maps)
    order = f"{values.lookup('severity', fixed.SEVERITY_RANK)} desc, id"
    shown = issues.drop("examples")
    if by:
        return counts, first_in_order(shown, by, order, k)
    return counts, shown.orderBy(F.expr(values.lookup("severity", fixed.SEVERITY_RANK)).desc(), "id").limit(k)


def readiness(issues: DataFrame, profiles: DataFrame, scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Can the table feed a model: blockers, warnings, unsuitable columns, score, level."""
    by = by or []
    blocking = "severity in ('critical', 'high') and category in ('schema', 'uniqueness', 'privacy')"
    warning = f"not ({blocking}) and category in ('anomaly', 'completeness', 'validity')"
    found = aggregate(
        issues, by, blockers=f"count_if({blocking})", warnings=f"count_if({warning})",
        blocker_titles=f"array_sort(collect_list(if({blocking}, title, null)))",
    )
    unfit = (
        "missing_rate > 0.3D or (unique_rate > 0.95D and inferred_type = 'text')"
        f" or {values.among('lower(column)', fixed.NOT_A_FEATURE)}"
    )
    columns = aggregate(profiles, by, unsuitable_features=f"array_sort(collect_set(if({unfit}, column, null)))")
    joined = side_by_side(by, scores.select(*by, "overall"), found, columns).where("overall is not null")
    penalty = (
        "least(60L, coalesce(blockers, 0L) * 15 + coalesce(warnings, 0L) * 4"
        " + coalesce(size(unsuitable_features), 0) * 2)"
    )
    rated = joined.selectExpr(
        *[name(c) for c in by], f"greatest(0L, overall - {penalty}) as score", "coalesce(blockers, 0L) as blockers",
        "coalesce(warnings, 0L) as warnings", "blocker_titles", "unsuitable_features",
    )
    level = (
        "case when score < 50 or blockers > 0 then 'critical' when score < 70 then 'high' when score < 85 then 'medium'"
        " else 'low' end"
    )
    return rated.selectExpr("*", f"{level} as risk_level")
