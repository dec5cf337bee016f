"""A static check of user patterns: refuses what a backtracking engine may never finish.

A repeat without an upper bound is unsafe where one text can be divided among its rounds in
several ways: when its body holds another such repeat and nothing between the rounds tells
them apart, or alternatives that begin alike.  Two such repeats of overlapping characters
side by side are unsafe too, as every way to divide a text between them is tried.
"""

from __future__ import annotations

import re
from re import _constants as code
from re import _parser as parser

#: Repeats of up to so many rounds count as bounded.
BOUNDED = 32
REPEATS = (code.MAX_REPEAT, code.MIN_REPEAT)
CLASSES = {
    code.CATEGORY_DIGIT: set("0123456789"), code.CATEGORY_SPACE: set(" \t\n\r\f\v"),
    code.CATEGORY_WORD: set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_"),
}
#: Characters that stand for all others when sets are compared.
ALL = frozenset(map(chr, range(256))) | {"Ж", "中"}


class UnsafePattern(ValueError):
    """A pattern whose matching may take exponential or quadratic time."""


def characters(op, value) -> frozenset:
    """The characters that one step of a pattern takes."""
    if op is code.LITERAL:
        return frozenset({chr(value)})
    if op is code.NOT_LITERAL:
        return ALL - {chr(value)}
    if op is code.ANY:
        return ALL
    if op is not code.IN:
        return ALL
    found: set = set()
    for kind, part in value:
        if kind is code.LITERAL:
            found.add(chr(part))
        elif kind is code.RANGE:
            found |= {c for c in ALL if part[0] <= ord(c) <= part[1]} or {chr(part[0])}
        elif kind is code.CATEGORY:
            base = CLASSES.get(part)
            negated = next((c for k, c in CLASSES.items() if part.name == k.name.replace("CATEGORY_", "CATEGORY_NOT_")), None)
            found |= base if base is not None else ALL - negated if negated is not None else ALL
    return frozenset(ALL - found if value and value[0][0] is code.NEGATE else found)


def overlapping(members: list) -> bool:
    """Whether two members of a set share a character."""
    sets = [characters(code.IN, [m]) for m in members if m[0] is not code.NEGATE]
    return sum(map(len, sets)) > len(frozenset().union(*sets))


def unbounded(op, value) -> bool:
    return op in REPEATS and value[1] > BOUNDED


def body(op, value) -> list:
    """The steps inside a step, as alternatives of sequences."""
    if op in REPEATS or op is code.POSSESSIVE_REPEAT:
        return [list(value[2])]
    if op is code.SUBPATTERN:
        return [list(value[3])]
    if op is code.BRANCH:
        return [list(v) for v in value[1]]
    if op is code.ATOMIC_GROUP:
        return [list(value)]
    return []


def edge(steps: list, last: bool = False) -> tuple[frozenset, bool]:
    """Characters that a sequence may begin (or end) with, and whether it may be empty."""
    found: frozenset = frozenset()
    for op, value in reversed(steps) if last else steps:
        if op in (code.AT, code.ASSERT, code.ASSERT_NOT):
            continue
        inner = body(op, value)
        if inner:
            parts = [edge(list(s), last) for s in inner]
            found |= frozenset().union(*[p[0] for p in parts])
            empty = any(p[1] for p in parts) or (op in (*REPEATS, code.POSSESSIVE_REPEAT) and value[0] == 0)
        elif op is code.GROUPREF:
            return ALL, True
        else:
            found, empty = found | characters(op, value), False
        if not empty:
            return found, False
    return found, True


def flat(steps: list) -> list:
    """Steps with plain groups opened."""
    out = []
    for op, value in steps:
        out += flat(list(value[3])) if op is code.SUBPATTERN else [(op, value)]
    return out


def holds_repeat(steps: list) -> bool:
    return any(unbounded(op, value) or any(map(holds_repeat, body(op, value))) for op, value in steps)


def check(steps: list) -> None:
    steps = flat(steps)
    for at, (op, value) in enumerate(steps):
        for inner in body(op, value):
            check(inner)
        if not unbounded(op, value):
            continue
        inside = flat(list(value[2]))
        first, empty = edge(inside)
        if empty:
            raise UnsafePattern("a repeat of what may be empty")
        if holds_repeat(inside) and not told_apart(inside):
            raise UnsafePattern("a repeat within a repeat")
        grouped = any(o is code.SUBPATTERN for o, _ in value[2])
        for inner_op, inner in inside:
            # alternatives of one character come as a set, what alternatives begin with stands before them
            alike = grouped and inner_op is code.IN and overlapping(inner)
            if inner_op is code.BRANCH:
                starts = [edge(list(s)) for s in inner[1]]
                alike = sum(e for _, e in starts) > 1 or any(a & b for i, (a, _) in enumerate(starts) for b, _ in starts[:i])
            if alike:
                raise UnsafePattern("a repeat of alternatives that begin alike")
        for next_op, next_value in steps[at + 1 :]:
            if unbounded(next_op, next_value) and edge(list(value[2]), True)[0] & edge(list(next_value[2]))[0]:
                raise UnsafePattern("two repeats of the same characters side by side")
            if not (next_op in REPEATS and next_value[0] == 0):
                break


def told_apart(steps: list) -> bool:
    """Whether the rounds of a sequence with a repeat in it can be divided in one way only.

    So it is when the sequence begins or ends with a character that none of its repeats takes.
    """
    taken = frozenset().union(*[edge(list(v[2]))[0] | edge(list(v[2]), True)[0] for o, v in steps if unbounded(o, v)]) if steps else frozenset()
    if any(holds_repeat(s) for o, v in steps for s in body(o, v)):
        return False  # repeats three deep
    for op, value in (steps[0], steps[-1]):
        if op in (code.LITERAL, code.IN, code.NOT_LITERAL, code.ANY) and not characters(op, value) & taken:
            return True
    return False


def refuse_unsafe(pattern: str) -> str:
    """The pattern itself; raises ``UnsafePattern`` where matching may take exponential or quadratic time.

    Repeats that follow each other with something between them are accepted.
    """
    try:
        check(list(parser.parse(pattern)))
    except re.error as problem:
        raise UnsafePattern(f"invalid pattern {pattern!r}: {problem}") from problem
    except UnsafePattern as problem:
        raise UnsafePattern(f"{problem} in {pattern!r}") from None
    return pattern
