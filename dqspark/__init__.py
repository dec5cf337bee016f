"""dqspark: data-reliability audits as Spark jobs."""

from .operators.detect import Expectations
from .operators.profile import Options, profile_columns, profile_dataset
from .operators.rules import Rule, execute_rules, violations
from .operators.score import ScoringContext
from .plans.audit import Audit, audit

__all__ = [
    "Audit", "Expectations", "Options", "Rule", "ScoringContext", "audit", "execute_rules", "profile_columns",
    "profile_dataset", "violations",
]
