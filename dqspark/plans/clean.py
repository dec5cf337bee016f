"""Remediation preview and apply."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators.cells import side_by_side
from ..operators.detect import in_severity_order
from ..operators.profile import DEFAULT, Options
from ..operators.remediate import Remediation, plan_actions, remediate
from ..operators.rules import Rule
from ..operators.score import DEFAULT_CONTEXT, ScoringContext
from ..sources.store import AuditStore
from .audit import Audit, audit, conclude
from .state import revise


@dataclass
class Preview:
    remediation: Remediation
    projected: Audit

    def comparison(self, source: Audit) -> DataFrame:
        """Score, issue and row counts before and after, one row (M9)."""
        before = side_by_side([], source.score, source.dataset).selectExpr(
            "overall as score_before", "active_issue_count as issues_before", "row_count as rows_before"
        )
        after = side_by_side([], self.projected.score, self.projected.dataset).selectExpr(
            "overall as projected_score", "active_issue_count as projected_issues", "row_count as rows_after"
        )
        return side_by_side([], before, after).selectExpr("*", "projected_score - score_before as projected_score_delta")


def preview(
    df: DataFrame, source: Audit, issue_ids: list[str], rules: list[Rule] | None = None, options: Options = DEFAULT,
    context: ScoringContext = DEFAULT_CONTEXT, **how,
) -> Preview:
    """Clean the table by the chosen issues and audit the outcome; nothing is written (M9).

    The audit starts from the state of the source's: only changed columns are measured anew,
    and removed rows are taken off the counts of the others.  It runs the source's rules and
    expectations; with other rules or options the outcome is audited as a whole.

    Actions run in the order of the audit, grave issues first.  The plan has a row per issue
    and is read to the driver; the data is not.
    """
    chosen = set(issue_ids)
    plan = [r for r in plan_actions(in_severity_order(source.issues)).collect() if r["issue_id"] in chosen]
    cleaned = remediate(df, plan, **how)
    kept = source.state
    if kept is None or rules is not None and tuple(rules) != kept.rules or options != kept.options:
        return Preview(cleaned, audit(cleaned.result, rules, options=options, context=context))
    touched = cleaned.touched()
    gone = cleaned.removed([c for c in kept.layout.columns if c not in touched])
    return Preview(cleaned, conclude(revise(kept, cleaned.result, touched, gone), context))


def apply(store: AuditStore, name: str, version: int, done: Preview, audit_date: str, audit_id: str) -> str:
    """Write the cleaned table as a dataset version and its audit to the history."""
    path = store.write_version(done.remediation.result, f"cleaned_{name}", version)
    store.save_audit(done.projected, audit_date, audit_id, f"cleaned_{name}", "remediation", version)
    return path
