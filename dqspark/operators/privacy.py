"""Which columns hold personal or secret data (V1-V8).

Every share is taken over all non-missing values; ratios come from the measures
of the profile, so classification needs no scan of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions import fixed, names, values
from ..functions.values import lit
from .cells import Layout, aggregate

CANDIDATE = "struct<rank:int,confidence:double,turn:int,classification:string,sensitivity:string>"
PATTERN_MEASURE = {
    "email": "emails", "phone_number": "phones", "network_identifier": "addresses", "payment_card": "cards",
}
PRESENT = "(row_count - missing_count)"
# How values of a sensitivity are to be published.
MASKING = {"critical": "tokenize", "high": "mask", "medium": "generalize", "low": "none"}


def _when(test: str, turn: int, label: str, sensitivity: str, confidence: str) -> str:
    rank = fixed.SENSITIVITY_RANK[sensitivity]
    return (
        f"case when {test} then named_struct('rank', {rank}, 'confidence', {confidence}, 'turn', {-turn},"
        f" 'classification', {lit(label)}, 'sensitivity', {lit(sensitivity)}) end"
    )


def with_finding(measures: DataFrame, layout: Layout, name_match: str = "substring") -> DataFrame:
    """Add ``privacy`` = struct(classification, sensitivity, confidence, reasons, masking), null when not sensitive."""
    key = names.canonical
    date_named = layout.where(lambda c: names.has_token(key(c), fixed.DATE_NAME, name_match))
    candidates: list[str] = []
    reasons: list[str] = []

    for token, label, sensitivity in fixed.PRIVACY_NAMES:
        hit = (token, label, sensitivity)
        here = layout.where(lambda c, hit=hit: names.privacy_by_name(c, name_match) == hit)
        if here != "false":
            candidates.append(_when(here, 0, label, sensitivity, "0.93D"))
            reasons.append(f"case when {here} then {lit(f'the column name contains {token}')} end")

    for turn, (label, sensitivity) in enumerate(fixed.PRIVACY_PATTERNS, start=1):
        share = values.ratio(PATTERN_MEASURE[label], PRESENT)
        test = f"({PRESENT} > 0 and {share} >= 0.6D)"
        if label in ("phone_number", "payment_card"):
            test = f"({test} and not {date_named})"
        candidates.append(_when(test, turn, label, sensitivity, f"least(0.99D, 0.75D + {share} * 0.24D)"))
        shown = f"concat({values.percent_text(share)}, {lit(' of the values look like a ' + label.replace('_', ' '))})"
        reasons.append(f"case when {test} then {shown} end")

    id_named = layout.where(lambda c: names.has_token(key(c), fixed.PERSONAL_ID_NAME, name_match))
    personal = (
        f"({id_named} and {PRESENT} > 0 and {values.ratio('identifiers', PRESENT)} >= 0.8D"
        f" and {values.ratio('unique_count', PRESENT)} >= 0.8D)"
    )
    candidates.append(_when(personal, 9, "personal_identifier", "high", "0.84D"))
    reasons.append(f"case when {personal} then 'the values are mostly distinct and look like identifiers' end")

    email_named = layout.named(fixed.EMAIL_NAME, name_match)
    declared_boolean = layout.where(lambda c: layout.kind(c) == "boolean")
    flag_named = layout.where(lambda c: names.is_email_flag(c, name_match))
    exempt = (
        f"({flag_named} or ({email_named} and"
        f" ({declared_boolean} or ({PRESENT} > 0 and bool_tokens = {PRESENT}))))"
    )
    chosen = measures.selectExpr(
        "*",
        f"if({exempt}, null, array_max(filter(array({', '.join(candidates)}), c -> c is not null))) as best",
        f"array_distinct(filter(array({', '.join(reasons)}), r -> r is not null)) as why",
    )
    advice = values.lookup("best.sensitivity", MASKING)
    return chosen.selectExpr(
        "* except (best, why)",
        "case when best is not null then named_struct('classification', best.classification,"
        f" 'sensitivity', best.sensitivity, 'confidence', {values.py_round('best.confidence', 3)},"
        f" 'reasons', why, 'masking', {advice}) end as privacy",
    )


def findings(profiles: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The sensitive columns of stored profiles (V7, V8)."""
    return profiles.where("sensitivity is not null").selectExpr(
        *[values.name(c) for c in by or []], "column", "privacy_classification as classification", "sensitivity",
        "privacy_confidence as confidence", "privacy_reasons as reasons", "masking_recommendation",
    )


def scan_summary(profiles: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per slice: number of sensitive columns, count per level, highest level (V7)."""
    rank = values.lookup("sensitivity", fixed.SENSITIVITY_RANK)
    return aggregate(
        profiles, by or [],
        sensitive_column_count="count(sensitivity)",
        highest_sensitivity=f"coalesce(max_by(sensitivity, {rank}), 'low')",
        **{f"{level}_count": f"count_if(sensitivity = '{level}')" for level in fixed.SENSITIVITY_RANK},
    )
