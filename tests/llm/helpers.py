"""Small tables with the awkward rows every operator must take."""

from __future__ import annotations

LONG = "der die und haus " * 20_000
AWKWARD = [None, "", " \n\t ", "...!!!", "a", "é", LONG, "same text here\nsame text here", "same text here\nsame text here", "\U0001f600 x\u0000y ﻿"]


def docs(spark, texts, extra="string"):
    """documents with a column of each name that operators use or add, to clash with."""
    rows = [(i, t, "xx", "src", None if t is None else len(t), "c", "c", "c", "c", "c", "c", "c", "c") for i, t in enumerate(texts)]
    names = "doc_id long, text string, lang string, source string, n_chars long, score string, ids string, decoded string, pii string, kept string, fingerprint string, n_words string, _text string"
    return spark.createDataFrame(rows, names)
