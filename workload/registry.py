"""Registry of example queries: name -> (Spark query, DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def keep(fn: Callable) -> Callable:
        if name in QUERIES:
            raise ValueError(f"two queries called {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


# --- DuckDB expressions used by many oracles --------------------------------------
def miss(c: str) -> str:
    return f"({c} is null or trim({c}) = '')"


def num(c: str) -> str:
    return (
        f"(case when regexp_full_match(trim({c}), '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?')"
        f" then try_cast(trim({c}) as double) end)"
    )


def stamp(c: str) -> str:
    return (
        f"(case when regexp_full_match(trim({c}), '[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}([T ][0-9]{{1,2}}:[0-9]{{2}}(:[0-9]{{2}}([.][0-9]+)?)?)?')"
        f" then try_cast(trim({c}) as timestamp) end)"
    )


def email(c: str) -> str:
    return f"regexp_matches(trim({c}), '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$')"


def phone(c: str) -> str:
    return f"regexp_matches(trim({c}), '^\\+?[0-9][0-9\\s().-]{{6,}}$')"


def ip(c: str) -> str:
    return f"regexp_matches(trim({c}), '^([0-9]{{1,3}}\\.){{3}}[0-9]{{1,3}}$')"


def luhn(c: str) -> str:
    d = f"regexp_replace({c}, '[^0-9]', '', 'g')"
    return (
        f"(length({d}) between 13 and 19 and list_sum([case when (length({d}) - i) % 2 = 0 then cast({d}[i] as int)"
        f" when cast({d}[i] as int) * 2 > 9 then cast({d}[i] as int) * 2 - 9 else cast({d}[i] as int) * 2 end"
        f" for i in range(1, length({d}) + 1)]) % 10 = 0)"
    )


def card(c: str) -> str:
    return f"(regexp_matches(trim({c}), '^([0-9][ -]*){{13,19}}$') and {luhn(c)})"


def ident(c: str) -> str:
    return f"regexp_matches(trim({c}), '^[A-Za-z0-9-]{{6,20}}$')"


def bool_token(c: str) -> str:
    return f"(lower(trim({c})) in ('true', 'false', 'yes', 'no', 'y', 'n', '0', '1'))"


def inferred(name: str, c: str) -> str:
    """Semantic type of a text column, as an aggregate expression."""
    text_name = any(t in name for t in ("id", "phone", "mobile", "zip", "postal", "code"))
    date_name = any(t in name for t in ("date", "time", "created", "updated", "timestamp"))
    if text_name:
        return f"case when count({c}) = 0 then 'empty' else 'text' end"
    share = lambda test: f"(cast(count_if({test}) as double) / nullif(count({c}), 0))"
    marks = share(f"regexp_matches({c}, '[-/:]')")
    return (
        f"case when count({c}) = 0 then 'empty'"
        f" when {share(bool_token(c))} >= 0.95 and count(distinct trim({c})) <= 6 then 'boolean'"
        f" when ({str(date_name).lower()} or {marks} >= 0.8) and {share(stamp(c) + ' is not null')} >= 0.85 then 'datetime'"
        f" when {share(num(c) + ' is not null')} >= 0.9 then 'numeric' else 'text' end"
    )


def unique_of(c: str) -> str:
    return f"count(distinct case when not {miss(c)} then {c} end)"


def union(parts: list[str]) -> str:
    return " union all ".join(parts)
