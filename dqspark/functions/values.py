"""Scalar building blocks as Spark SQL expressions.

Every function takes and returns expression text (``sql`` arguments are expressions,
not values), so an operator is assembled as SQL and parsed once.  All of it runs in the
JVM; there is no UDF.
"""

from __future__ import annotations

from pyspark.sql import types as T

from . import fixed


def lit(value) -> str:
    """A Python value as a SQL literal."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        return str(value) if -(2**31) <= value < 2**31 else f"{value}L"
    if isinstance(value, float):
        return f"{value!r}D"
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def name(column: str) -> str:
    """A column name as an identifier."""
    return "`" + column.replace("`", "``") + "`"


def items(values) -> str:
    return ", ".join(lit(v) for v in values)


def among(sql: str, values) -> str:
    """``sql in (values)``; false for an empty list."""
    values = list(values)
    return f"({sql} in ({items(values)}))" if values else "false"


def matches(text: str, pattern: str) -> str:
    return f"({text} rlike {lit(pattern)})"


def missing_in(value: str, dtype: T.DataType) -> str:
    """Missing for a column of any type: only text can be blank, only floats can be NaN."""
    if is_text_type(dtype):
        return missing(stripped(value))
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return f"({value} is null or isnan({value}))"
    return f"({value} is null)"


# Patterns are tried only on texts that can match, by first character or length: most
# values then never leave their byte form.
def _opens(text: str, low: int, high: int) -> str:
    return f"(ascii({text}) between {low} and {high})"


def is_email(text: str) -> str:
    return f"(contains({text}, '@') and {matches(text, fixed.EMAIL)})"


def is_phone(text: str) -> str:
    return f"({_opens(text, 43, 57)} and {matches(text, fixed.PHONE)})"


def is_ip(text: str) -> str:
    return f"({_opens(text, 48, 57)} and char_length({text}) <= 15 and {matches(text, fixed.IP_V4)})"


def is_identifier(text: str) -> str:
    return f"(char_length({text}) between 6 and 20 and {matches(text, fixed.IDENTIFIER)})"


def has_date_mark(text: str) -> str:
    return "(" + " or ".join(f"contains({text}, {lit(mark)})" for mark in fixed.DATE_MARKS) + ")"


def rendered(value: str, dtype: T.DataType) -> str:
    """A value as text, nested values as JSON, NaN as null.

    Numbers are in plain notation from 1e-13 to 1e16, beyond that with an exponent.
    """
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        number = f"cast({value} as double)"
        wide = f"regexp_replace(cast(cast({number} as decimal(38,10)) as string), '(?<=[.][0-9]{{1,10}})0+$', '')"
        small = f"regexp_replace(cast(cast(cast({value} as string) as decimal(38,30)) as string), '0+$', '')"
        return (
            f"case when isnan({number}) then null"
            f" when abs({number}) >= 1e7 and abs({number}) < 1e16 then {wide}"
            f" when abs({number}) < 1e-3 and abs({number}) >= 1e-13 then {small}"
            f" else cast({value} as string) end"
        )
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        return f"to_json({value})"
    if isinstance(dtype, T.BinaryType):
        return f"base64({value})"
    return f"cast({value} as string)"


def stripped(text: str) -> str:
    return f"btrim({text}, {lit(fixed.WHITESPACE)})"


def stripped_column(text: str) -> str:
    """``stripped`` for a rendered text that is at hand as a column, so reading it again is free.

    Trimming looks every end character up in all white space; texts that begin and end with a
    printable ASCII character, as most do, are told by two bytes.
    """
    last = f"substr({text}, -1)"
    return (
        f"if({text} >= '!' and {text} < {lit(chr(127))} and {last} >= '!' and {last} < {lit(chr(127))}, {text}, {stripped(text)})"
    )


def text_of(value: str, dtype: T.DataType) -> str:
    return stripped(rendered(value, dtype))


def missing(text: str) -> str:
    """True for null and for blank; ``text`` is already stripped.  Never null."""
    return f"({text} is null or {text} = '')"


def number_in(text: str, thousands: bool = False) -> str:
    """Parse a stripped text as a number; anything else is null.

    The pattern is tested first: a cast alone would accept ``12d`` or ``NaN``, and a
    failing cast costs an exception per row.
    """
    source = f"replace({text}, ',', '')" if thousands else text
    return f"case when {_opens(source, 43, 57)} and {matches(source, fixed.NUMBER)} then try_cast({source} as double) end"


def timestamp_in(text: str) -> str:
    """Parse a stripped text as a timestamp by its shape; anything else is null."""
    shapes = " ".join(
        f"when {_may_be_dated(text, layout)} and {matches(text, shape)} then try_to_timestamp({text}, {lit(layout)})"
        for shape, layout in fixed.TIMESTAMP_SHAPES
    )
    iso = f"when substr({text}, 5, 1) = '-' and {matches(text, fixed.ISO_TIMESTAMP)} then try_cast({text} as timestamp)"
    return f"case when char_length({text}) not between 8 and 40 then null {iso} {shapes} end"


def _may_be_dated(text: str, layout: str) -> str:
    """What a layout asks for that needs no pattern: its separator, or its length without one."""
    marks = [mark for mark in ("/", "-", ", ", " ") if mark in layout]
    return f"contains({text}, {lit(marks[0])})" if marks else f"char_length({text}) = {len(layout)}"


def is_number_type(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_time_type(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))


def is_text_type(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.VarcharType, T.CharType))


def number_of(value: str, dtype: T.DataType, thousands: bool = False) -> str:
    """Number in a column of any type: typed numbers pass through, strings are parsed."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return f"nullif(cast({value} as double), double('NaN'))"
    if is_number_type(dtype):
        return f"cast({value} as double)"
    return number_in(stripped(value), thousands) if is_text_type(dtype) else "cast(null as double)"


def timestamp_of(value: str, dtype: T.DataType) -> str:
    if is_time_type(dtype):
        return f"cast({value} as timestamp)"
    return timestamp_in(stripped(value)) if is_text_type(dtype) else "cast(null as timestamp)"


def in_tokens(text: str, tokens) -> str:
    return f"(char_length({text}) <= 5 and {among(f'lower({text})', tokens)})"


def luhn_valid(text: str) -> str:
    """Luhn checksum of a text of 13 to 19 digits, spaces and dashes.

    Padded to 20 digits the doubled positions are fixed.  Read to base 11 a number leaves the
    sum of its digits modulo 10, so two conversions add ten digits each; taking digits one by one
    would build the padded text anew for each, as nothing is shared within a branch.
    """
    digits = f"translate({text}, ' -', '')"
    padded = f"lpad({digits}, 20, '0')"
    plain = f"regexp_replace({padded}, '.(.)', '$1')"
    # The digit sum of twice a digit, digit by digit.
    doubled = f"translate(regexp_replace({padded}, '(.).', '$1'), '0123456789', '0246813579')"
    summed = " + ".join(f"cast(conv({part}, 11, 10) as bigint)" for part in (plain, doubled))
    return f"(char_length({digits}) between 13 and 19 and ({summed}) % 10 = 0)"


def is_card(text: str) -> str:
    """Card pattern first, so that the checksum runs on the few texts made of digits."""
    return (
        f"(case when {_opens(text, 48, 57)} and char_length({text}) >= 13 and {matches(text, fixed.CARD)}"
        f" then {luhn_valid(text)} else false end)"
    )


def title_case(text: str) -> str:
    """Upper-case every letter that follows a non-letter, lower-case the others."""
    cut = lit(r"(?<=\P{L})|(?=\P{L})")
    return f"array_join(transform(split(lower({text}), {cut}), p -> concat(upper(left(p, 1)), substr(p, 2))), '')"


def token(text: str, length: int = 12, salt: str | None = None) -> str:
    """First hex digits of the SHA-256 of the text."""
    source = text if salt is None else f"concat({lit(salt)}, {text})"
    return f"left(sha2({source}, 256), {length})"


def breadth(rate: str) -> str:
    """How much a defect weighs by the share of rows it touches (0.18 .. 1)."""
    return f"(0.18D + 0.82D * sqrt(least(greatest({rate}, 0D), 1D)))"


def py_round(value: str, digits: int = 0) -> str:
    """Round like Python: the exact binary value decides, a true tie goes to even.

    ``value * 10**digits`` is computed with its rounding error (Dekker's product), so
    a value that only looks like a tie after scaling is put on the right side.
    """
    x, s = f"({value})", f"{float(10**digits)!r}D"
    scaled = f"({x} * {s})"
    high = f"({x} * 134217729D - ({x} * 134217729D - {x}))"
    error = f"(({high} * {s} - {scaled}) + ({x} - {high}) * {s})"
    whole = f"floor({scaled})"
    part = f"({scaled} - {whole})"
    up = f"({part} > 0.5D or ({part} = 0.5D and ({error} > 0D or ({error} = 0D and pmod({whole}, 2) = 1))))"
    rounded = f"({whole} + if({up}, 1, 0))"
    return f"(cast({rounded} as double) / {s})" if digits else rounded


def ratio(part: str, whole: str) -> str:
    """part / whole as double, 0 for an empty whole."""
    return f"(if({whole} = 0, 0D, cast({part} as double) / nullif({whole}, 0)))"


def lookup(label: str, table: dict) -> str:
    """Look a label up in a small fixed table; null when absent."""
    return f"(case {label} " + " ".join(f"when {lit(k)} then {lit(v)}" for k, v in table.items()) + " end)"


def percent_text(rate: str, digits: int = 0) -> str:
    return f"concat(format_string('%.{digits}f', {rate} * 100), '%')"


def json_field(payload: str, path: str, kind: str = "string") -> str:
    """One field of a JSON text column, null when absent or unparsable."""
    return f"try_cast(get_json_object({payload}, {lit(path)}) as {kind})"


def months_back(moment: str, years: int) -> str:
    return f"({moment} - make_interval({years}))"


def days_back(moment: str, days: int) -> str:
    return f"({moment} - make_interval(0, 0, 0, {int(days)}))"
