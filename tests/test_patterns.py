from __future__ import annotations

import pytest

from dqspark.functions import fixed
from dqspark.functions.patterns import UnsafePattern, refuse_unsafe
from dqspark.operators.rules import Rule, RuleError, validate_rule

UNSAFE = [
    "(a+)+$", "(a*)*", "(a|a)*b", r"(ab|a\w)*d", r"(\w+\s*)*$", r"(\d+)*x", ".*.*x", r"\d+\d+z", "([a-z]+)*$", "(.*)+", "(a?)*", "((ab)*)*", r"(\s*\w+)*$",
    "((a+)b?)+$", "(a{1,}){2,}", r"[a-z]+[a-z0-9]*!",
]
SAFE = [
    "", "abc", r"\+254\d{9}", r"[A-Z]{2}-\d+", r"(\.[A-Za-z0-9-]+)+", r"(,[^,]*)*", r"\d{1,3}(\.\d{1,3}){3}", r"(foo|bar)+", r"\s*\d+\s*", r"(?:[^,]*,)+", r".*x.*", r"(\w\s)*",
    "(ab){1,20}", r"^a+b+$", r"(?P<x>\d+)-(?P=x)", r"(a|b)*",
]


@pytest.mark.parametrize("pattern", UNSAFE)
def test_backtracking_patterns_are_refused(pattern):
    with pytest.raises(UnsafePattern):
        refuse_unsafe(pattern)
    with pytest.raises(RuleError):
        validate_rule(Rule(1, "x", "regex", "c", parameters={"pattern": pattern}))


@pytest.mark.parametrize("pattern", SAFE)
def test_plain_patterns_are_accepted(pattern):
    assert refuse_unsafe(pattern) == pattern


def test_the_fixed_patterns_are_accepted():
    for pattern in (fixed.EMAIL, fixed.PHONE, fixed.IP_V4, fixed.CARD, fixed.IDENTIFIER):
        assert refuse_unsafe(pattern.replace("(?U)", ""))


def test_accepted_patterns_end_soon_on_hostile_texts():
    import re
    import time

    for pattern in SAFE:
        for text in ("a" * 3000 + "!", "ab" * 1500 + "\x00", "1" * 3000 + "z", " " * 3000 + "!", ",." * 1500 + "!"):
            start = time.perf_counter()
            re.fullmatch(pattern, text)
            assert time.perf_counter() - start < 1, pattern
