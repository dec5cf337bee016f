"""Decisions taken from a column's name alone (metadata, no data is read)."""

from __future__ import annotations

import re

from . import fixed


def has_token(name: str, tokens: tuple[str, ...], match: str = "substring") -> bool:
    """Does the name contain one of the tokens?

    ``match='substring'`` finds ``age`` in ``message``; ``match='word'`` wants the
    token to be a whole word of the name (``customer_age`` but not ``message``).
    """
    lowered = name.lower()
    if match == "substring":
        return any(token in lowered for token in tokens)
    snake = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name.strip()).lower()
    words = [word for word in re.split(r"[^a-z0-9]+", snake) if word]
    padded = "_" + "_".join(words) + "_"
    return any("_" + token.strip("_") + "_" in padded for token in tokens)


def canonical(name: str) -> str:
    return name.strip().lower().replace(" ", "_")


def is_email_flag(name: str, match: str = "substring") -> bool:
    """``email_verified`` and the like say something about an address, they hold none."""
    key = canonical(name)
    return has_token(key, fixed.EMAIL_NAME, match) and has_token(key, fixed.EMAIL_FLAG_NAME, match)


def privacy_by_name(name: str, match: str = "substring") -> tuple[str, str, str] | None:
    """(token, class, sensitivity) of the first listed token in the name."""
    key = canonical(name)
    for token, label, sensitivity in fixed.PRIVACY_NAMES:
        if has_token(key, (token,), match):
            return token, label, sensitivity
    return None


def resolve(columns: list[str], wanted: str) -> str | None:
    """The column called ``wanted``: exact spelling first, then ignoring case."""
    if wanted in columns:
        return wanted
    return {column.lower(): column for column in columns}.get(wanted.lower())
