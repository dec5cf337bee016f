"""Chat formatting with Spark expressions: sort turns, merge neighbours of one role, concatenate, mask, read back.

A formatted conversation is a row of blocks ``[INST:role]text[/INST]``; within a block, the
texts of merged turns stand apart by ``[TURN]``.  Control strings inside texts are
broken up by a backslash after their first character, and backslashes are doubled, so that
no control string is left in them and the original can be read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound

OPEN, NAMED, NEXT, CLOSE = "[INST:", "]", "[TURN]", "[/INST]"
#: What must not appear in a text: the marks here, and those of common other templates.
CONTROL = r"([\[<])(?=INST:|TURN\]|/?INST\]|/?s>|\||<SYS>|</SYS>)"
ROLE_CODES = (("%", "%25"), ("[", "%5B"), ("]", "%5D"), ("<", "%3C"))
#: Turns sorted and merged at once; a longer conversation is put together from such parts.
PART = 64


def escape(text: Column) -> Column:
    """Double backslashes, then break control strings up."""
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, CONTROL, r"$1\\")


def escape_role(role: Column) -> Column:
    """Brackets and the percent sign as ``%`` and two hexadecimal digits, so that a role can hold no mark."""
    for sign, code in ROLE_CODES:
        role = F.replace(role, F.lit(sign), F.lit(code))
    return role


def unescape(text: Column) -> Column:
    """Drop single backslashes and keep one of two."""
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def unescape_role(role: Column) -> Column:
    for sign, code in reversed(ROLE_CODES):
        role = F.replace(role, F.lit(code), F.lit(sign))
    return role


def blocks(turns: Column) -> Column:
    """Merge neighbours of one role: array of (role, texts), aggregated over sorted turns."""
    none = F.array().cast("array<struct<role:string,texts:array<string>>>")

    def add(done, turn):
        last = F.element_at(done, -1)
        same = (F.size(done) > 0) & (last.role == turn.role)
        longer = F.struct(last.role.alias("role"), F.concat(last.texts, F.array(turn.text)).alias("texts"))
        new = F.struct(turn.role.alias("role"), F.array(turn.text).alias("texts"))
        return F.when(same, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(new)))

    return F.aggregate(turns, none, add)


def segments(merged: Column, learn: str) -> Column:
    """Pieces of the output in order: array of (text, loss); loss marks the texts of role ``learn``."""

    def of(block, i):
        goes_on = (i > 0) & (F.get(merged, i - 1).role == block.role)
        closes = F.when(i > 0, CLOSE).otherwise("")
        head = F.when(goes_on, F.lit(NEXT)).otherwise(F.concat(closes, F.lit(OPEN), escape_role(block.role), F.lit(NAMED)))

        def piece(text, k):
            mark = F.struct(F.when(k == 0, head).otherwise(F.lit(NEXT)).alias("text"), F.lit(False).alias("loss"))
            return F.array(mark, F.struct(escape(text).alias("text"), (block.role == learn).alias("loss")))

        return F.flatten(F.transform(block.texts, piece))

    end = F.array(F.struct(F.lit(CLOSE).alias("text"), F.lit(False).alias("loss")))
    return F.concat(F.flatten(F.transform(merged, of)), end)


def format_conversations(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn: str = "assistant") -> DataFrame:
    """(key, segments, formatted) of every conversation.

    Turns are ordered by turn (null first), then role and text, so ties and repeated rows
    have one order and all stay.  A null text is empty, a null role is the role ``""``; rows
    with a null key form a conversation.  ``segments`` is the output in pieces with the loss
    mask, ``formatted`` their concatenation.  Turns are collected in parts of 64 numbers,
    sorted and merged there, so the work on a long conversation is shared; only what must
    become one row meets in one task.
    """
    given = rows.select(F.col(key).alias("_key"), F.col(turn).alias("_turn"), F.coalesce(F.col(role), F.lit("")).alias("_role"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    part = F.floor(F.col("_turn") / PART).alias("_part")
    turns = F.array_sort(F.collect_list(F.struct(F.coalesce(F.col("_turn").cast("long"), F.lit(-(2**63))).alias("turn"), F.col("_role").alias("role"), F.col("_text").alias("text"))))
    parts = given.groupBy("_key", part).agg(turns.alias("turns")).select("_key", "_part", blocks(F.col("turns")).alias("blocks"))
    whole = parts.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("_part", F.lit(-(2**63))).alias("part"), "blocks"))).alias("parts"))
    merged = whole.select("_key", F.flatten("parts.blocks").alias("merged"))
    cut = merged.select(F.col("_key").alias(key), segments(F.col("merged"), learn).alias("segments"))
    return cut.select(key, "segments", F.array_join("segments.text", "").alias("formatted"))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text) in order."""
    found = F.split(F.substring(formatted, 1 + len(OPEN), 2**31 - 1), r"\[/INST\](?:\[INST:|$)", -1)
    shut = F.filter(F.slice(found, 1, F.greatest(F.size(found) - 1, F.lit(0))), lambda b: b.isNotNull())

    def turns(block):
        role = F.substring_index(block, NAMED, 1)
        body = F.substring(block, F.length(role) + 2, 2**31 - 1)
        return F.transform(F.split(body, r"\[TURN\]", -1), lambda t: F.struct(unescape_role(role).alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(shut, turns))


def loss_text(parts: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(parts, lambda s: s.loss), lambda s: unescape(s.text)), "")
