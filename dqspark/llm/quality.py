"""Line-first quality rules, in Spark expressions only.

Every line is judged by itself: by its punctuation, as navigation, as boilerplate, or as a
repeat of an earlier line.  Lines that fail go, and a document that loses too much of its
text with them is rejected, as is one that fails the document rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound

#: White space between words.
BLANK, BLANKS = r"[\x20\x09-\x0D]", " \t\n\x0b\f\r"
SYMBOL = r"[#*$%&|<>]"
#: Fewest words of a document; most of its words that may stand in repeated windows, and words of a window.
LEAST_WORDS, MOST_REPEATED, RUN = 50, 0.5, 3
#: Most words of a line, as a share, that may end in a symbol or in doubled marks.
MOST_MARKED = 0.3
MARKED = r"(?:[#*$%&|<>]|[!?]{2})(?=[\x20\x09-\x0D]|$)"
#: A line with as many separators is navigation, and so is a short line that is nothing but a link or a list of them.
SEPARATORS = 2
NAVIGATION = r"(?i)^\s*(?:home|menu|login|log in|sign up|next|previous|read more|share|back to top|skip to content)\s*$"
BOILERPLATE = r"(?i)all rights reserved|cookie policy|privacy policy|terms of (?:use|service)|subscribe to|javascript (?:is )?(?:disabled|required)|powered by|click here"
#: Least share of the text of a document, in characters of lines, that must be left.
LEAST_LEFT = 0.5
ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "clean_text", "left_share", "base_failed", "kept")


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"{BLANK}+"))


def repeated_words(words: Column, run: int = RUN) -> Column:
    """Words that stand in a window of ``run`` words found twice or more.

    Windows are compared by their 64-bit hashes.  Only where some repeat are they sorted, to
    find the places of those with an equal neighbour; each place adds what it covers first.
    """

    def count(hashes):
        def places(ordered):
            equal = F.filter(ordered, lambda e, k: (e.h == F.get(ordered, k - 1).h) | (e.h == F.get(ordered, k + 1).h))
            return F.array_sort(F.transform(equal, lambda e: e.i))

        def covered(at):
            return F.aggregate(F.transform(at, lambda i, k: F.least(F.coalesce(F.get(at, k + 1) - i, F.lit(run)), F.lit(run))), F.lit(0), lambda a, b: a + b)

        sorted_ = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(bound(bound(sorted_, places), covered))

    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - run), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(run)]))
    return F.when(F.size(words) > run, bound(hashes, count)).otherwise(0)


def line_fails(line: Column) -> Column:
    """Why a line goes: punctuation, navigation or boilerplate; null if it stays."""
    size = F.size(F.split(F.btrim(line, F.lit(BLANKS)), f"{BLANK}+"))
    return (
        F.when(F.regexp_count(line, F.lit(r"\|")) >= SEPARATORS, "navigation").when(line.rlike(NAVIGATION), "navigation")
        .when(F.regexp_count(line, F.lit(MARKED)) > MOST_MARKED * size, "punctuation").when(line.rlike(BOILERPLATE), "boilerplate")
    )


def judge(docs: DataFrame, text: str = "text", keeps: list[str] | None = None) -> DataFrame:
    """Add measures, ``clean_text``, ``left_share``, ``base_failed`` and ``kept`` to every row.

    Measures: ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``.
    A null text counts as empty: no words, base failed, not kept.  Rows are judged alone, so
    ties and repeated rows need no rule.  Existing columns of these names are replaced.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n", -1), lambda line: F.btrim(line, F.lit(BLANKS)) != "")
    kept = [c for c in (docs.columns if keeps is None else keeps) if c not in ADDED]
    # the given columns stand apart in a struct, so that no name of theirs meets one made here
    base = docs.select(F.struct(*kept).alias("row"), whole.alias("text"), words_of(whole).alias("words"), lines.alias("lines"))
    first = base.withColumn("once", F.array_distinct("lines"))
    left = first.withColumn("left", F.filter("once", lambda line: line_fails(line).isNull()))
    chars = lambda c: F.length(F.array_join(c, ""))
    out = left.select(
        "row", F.size("words").cast("long").alias("n_words"), chars("words").cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOL)).cast("long").alias("n_symbols"), (F.size("lines") - F.size("once")).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).cast("long").alias("n_repeat_words"), F.array_join("left", "\n").alias("clean_text"),
        (chars("left") / F.nullif(chars("lines"), F.lit(0))).alias("left_share"),
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    judged = out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.coalesce("left_share", F.lit(0.0)) >= LEAST_LEFT))
    return judged.select("row.*", *ADDED)
