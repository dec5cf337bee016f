"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

Spark SQL expressions only.  Offsets come from splitting a text at a pattern: the pieces
between the matches and the matches themselves add up to where each match starts.

Every pattern finds the same leftmost non-overlapping matches as its plain form.  A match
may not begin inside a run that the plain form would have taken whole, unless the match
before ended there, and repeats are possessive; so no text makes a search quadratic.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound

#: Characters before and after a match in which its kind's words are looked for.
AROUND = 40
#: A span whose score is lower is not reported, unless its kind is always reported.
LEAST_SCORE = 0.5


@dataclass(frozen=True)
class Kind:
    """A kind of span: pattern, test of a match, score of a confirmed match, and words that raise it."""

    name: str
    pattern: str
    test: object = None
    score: float = 0.7
    words: str = ""
    bonus: float = 0.3
    always: bool = True
    hint: str = ""


def only_digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def mod97(value: Column) -> Column:
    """Remainder of an account number: the first four characters moved to the end, letters as 10 to 35."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    moved = F.split(F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4)), "")
    worth = lambda c: F.when(c.between("0", "9"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(moved, F.lit(0), lambda sum_, c: F.when(c == "", sum_).otherwise((sum_ * F.when(c.between("0", "9"), 10).otherwise(100) + worth(c)) % 97))


OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", words="mail|contact|write", hint="@"),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", lambda v: v.rlike(f"^{OCTET}(?:\\.{OCTET}){{3}}$"), words="ip|address|host|server|login", hint="."),
    # a chain of digits with single separators is one match; only chains of 13 to 19 digits can pass
    Kind("card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])", lambda v: F.call_function("luhn_check", only_digits(v)), score=0.6, words="card|visa|credit|payment|karte|carte|tarjeta"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: F.length(only_digits(v)).between(9, 15), score=0.6, words="phone|tel|call|mobile|fax", hint="+"),
    Kind("iban", r"(?<![A-Za-z0-9_])[A-Z]{2}[0-9]{2}(?:(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?|[A-Z0-9]{11,30})(?![A-Za-z0-9_])", lambda v: mod97(v) == 1, score=0.8, words="iban|account|konto|compte|cuenta", always=False),
    Kind("ssn", r"(?<![A-Za-z0-9_])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9_])", score=0.4, words="ssn|social security", always=False, hint="-"),
)
BASE = ("email", "ip", "card", "phone")


def offsets(pieces: Column, found: Column) -> Column:
    """Where each match starts: lengths of what stands before it, summed in blocks of 64."""

    def sums(steps):
        total = lambda values: F.aggregate(values, F.lit(0), lambda a, b: a + b)
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / 64).cast("int")), lambda b: total(F.slice(steps, b * 64 + 1, 64)))
        return bound(blocks, lambda block: F.transform(steps, lambda _, i: total(F.slice(block, 1, F.floor(i / 64).cast("int"))) + total(F.slice(steps, F.floor(i / 64).cast("int") * 64 + 1, i % 64)) + F.length(F.get(pieces, i))))

    return bound(F.transform(found, lambda m, i: F.length(m) + F.length(F.get(pieces, i))), sums)


def proposals(text: Column, kind: Kind) -> Column:
    """Confirmed spans of one kind: array of (kind, start, end, score), by start."""
    empty = F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>")

    def spans(found):
        def at(both):
            pieces, starts = both.pieces, both.starts

            def one(match, i):
                near = F.concat_ws(" ", F.right(F.get(pieces, i), F.lit(AROUND)), F.left(F.get(pieces, i + 1), F.lit(AROUND)))
                score = F.lit(kind.score) + F.when(F.lower(near).rlike(f"(?:{kind.words})"), kind.bonus).otherwise(0.0) if kind.words else F.lit(kind.score)
                ok = F.coalesce(kind.test(match), F.lit(False)) if kind.test else F.lit(True)
                return F.struct(F.lit(kind.name).alias("kind"), F.get(starts, i).alias("start"), (F.get(starts, i) + F.length(match)).alias("end"), F.when(ok, score).alias("score"))

            return F.filter(F.transform(found, one), lambda s: s.score.isNotNull() if kind.always else s.score >= LEAST_SCORE)

        return F.when(F.size(found) > 0, bound(bound(F.split(text, kind.pattern, -1), lambda pieces: F.struct(pieces.alias("pieces"), offsets(pieces, found).alias("starts"))), at)).otherwise(empty)

    searched = bound(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)), spans)
    return F.when(F.contains(text, F.lit(kind.hint)), searched).otherwise(empty) if kind.hint else searched


def find(docs: DataFrame, text: str = "text", kinds: tuple[Kind, ...] = KINDS, out: str = "pii") -> DataFrame:
    """Add ``pii``: a struct with, for each kind, its spans (kind, start, end, score) by start.

    Offsets count code points, ends are exclusive.  Matches of one kind don't overlap, those
    of different kinds may.  A null text has no spans, like an empty one.  Rows are treated
    alone, so repeated rows need no rule.  A column called ``pii`` is replaced.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumn(out, F.struct(*[proposals(whole, kind).alias(kind.name) for kind in kinds]))


def listed(spans: list[Column]) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    return F.array_join(F.transform(F.concat(*spans), lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def redact(docs: DataFrame, text: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """Replace every span by its kind in brackets, in ``text``; overlapping spans become one, named after the first.

    Texts without spans, null ones included, stay as they are.
    """
    # the given columns stand apart in a struct, so that no name of theirs meets one made here
    given = docs.select(F.struct(*docs.columns).alias("row"), F.col(text).alias("text"))
    spans = F.concat(*[F.col(f"pii.{kind.name}") for kind in kinds])
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), s.kind.alias("kind"))))
    none = F.array().cast("array<struct<start:int,end:int,kind:string>>")

    def join(merged, span):
        last = F.element_at(merged, -1)
        wider = F.struct(last.start.alias("start"), F.greatest(last.end, span.end).alias("end"), last.kind.alias("kind"))
        return F.when(F.size(merged) == 0, F.array(span)).when(span.start < last.end, F.concat(F.slice(merged, 1, F.size(merged) - 1), F.array(wider))).otherwise(F.concat(merged, F.array(span)))

    def cut(merged):
        def part(span, i):
            before = F.when(i == 0, 0).otherwise(F.get(merged, i - 1).end)
            return F.concat(F.substring(F.col("text"), before + 1, span.start - before), F.lit("["), F.upper(span.kind), F.lit("]"))

        return F.concat(F.array_join(F.transform(merged, part), ""), F.substring(F.col("text"), F.element_at(merged, -1).end + 1, F.length(F.col("text"))))

    found = find(given, "text", kinds)
    clean = F.when(F.size(spans) > 0, bound(F.aggregate(ordered, none, join), cut)).otherwise(F.col("text"))
    return found.select(F.col("row").withField(text, clean).alias("row")).select("row.*")
