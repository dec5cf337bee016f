from __future__ import annotations

import hashlib
import random

from dqspark.functions import fixed, names, values
from pyspark.sql import functions as F


def column(spark, items, sql, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, x {kind}").coalesce(1)
    return [r["y"] for r in df.selectExpr("i", f"{sql} as y").orderBy("i").collect()]


def test_rounding_equals_python(spark):
    rng = random.Random(3)
    items = [0.00125, 2.675, 0.09945, 77.25, 0.5, 1.5, 2.5, -0.5, -1.25, 1e-7, 0.1 + 0.2]
    items += [rng.randrange(0, 20000) / rng.randrange(1, 20000) for _ in range(500)]
    items += [k / 20000 for k in range(1, 400, 2)]
    for digits in (1, 2, 3, 4):
        assert column(spark, items, values.py_round("x", digits), "double") == [round(v, digits) for v in items]
    assert column(spark, items, values.py_round("x"), "double") == [round(v) for v in items]


def test_numbers_are_parsed_strictly(spark):
    items = ["12", " 12 ", "-5", "+.5", "5.", "1e3", "12d", "NaN", "inf", "1,234", "", None, "abc", "0x1F"]
    got = column(spark, items, values.number_in(values.stripped("x")))
    assert got == [12.0, 12.0, -5.0, 0.5, 5.0, 1000.0, None, None, None, None, None, None, None, None]
    assert column(spark, ["1,234.5"], values.number_in("x", thousands=True)) == [1234.5]


def test_timestamps_by_shape(spark):
    items = ["2025-01-10", "2025-01-10T08:30:00Z", "2025/01/10", "1/10/2025", "20250110", "10 Jan 2025", "Jan 10, 2025",
             "12:30", "T1", "2025", "2025-13-40", "soon", None]
    got = column(spark, items, f"cast({values.timestamp_in('x')} as string)")
    day = "2025-01-10 00:00:00"
    assert got == [day, "2025-01-10 08:30:00", day, day, day, day, day, None, None, None, None, None, None]


def test_missing_knows_all_blanks(spark):
    items = [None, "", "  ", "\t\n", " ", "x", " x "]
    assert column(spark, items, values.missing(values.stripped("x"))) == [True] * 5 + [False] * 2


def test_luhn(spark):
    items = ["4111 1111 1111 1111", "4111-1111-1111-1112", "5500005555555559", "123", "abc"]
    assert column(spark, items, values.is_card("x")) == [True, False, True, False, False]


def test_luhn_equals_a_loop_and_builds_the_digits_few_times(spark):
    rng = random.Random(8)
    items = ["".join(rng.choice("0123456789") for _ in range(rng.randint(12, 20))) for _ in range(400)]
    items += ["0" * 13, "9" * 19, "4111 1111-1111 1111", "-4111111111111111", "4111111111111111 x", None]

    def valid(text):
        digits = (text or "").replace(" ", "").replace("-", "")
        if not digits.isdigit() or not text[0].isdigit() or not 13 <= len(digits) <= 19:
            return False
        twice = [int(d) if i % 2 == 0 else int(d) * 2 - 9 * (d > "4") for i, d in enumerate(reversed(digits))]
        return sum(twice) % 10 == 0

    assert column(spark, items, values.is_card("x")) == [valid(t) for t in items]
    # Nothing is shared within a branch: a term for each digit padded the text twenty times.
    assert values.luhn_valid("x").count("lpad(") <= 2


def test_timestamp_guards_refuse_nothing(spark):
    """Every shape is still read from text of each length its pattern allows."""
    items = ["2025-1-1", "2025-01-01 1:02", "2025-01-01 01:02:03.5+0200", "2025/1/1", "2025/11/11", "1/1/2025", "11/11/2025", "1-1-2025", "11-11-2025",
             "20250101", "1 Jan 2025", "11 Jan 2025", "Jan 1, 2025", "Jan 11, 2025"]
    assert None not in column(spark, items, f"cast({values.timestamp_in('x')} as string)")


def test_title_case_equals_python(spark):
    items = ["o'neil mc-donald x2y", "ABC def", "  ", "élan vital", "a1b2"]
    assert column(spark, items, values.title_case("x")) == [v.title() for v in items]


def test_token_is_sha256(spark):
    assert column(spark, ["abc"], values.token("x")) == [hashlib.sha256(b"abc").hexdigest()[:12]]


def test_stripped_column_trims_what_stripped_trims(spark):
    texts = ["", " ", "a", "a ", " a", "~", "!", "\x7f", "\x7fa", "a\x7f", "é", "é ", "\u3000a", "a\u2029", "a b", "\x1fa", "a\x85", "a\n", "😀", None]
    assert column(spark, texts, values.stripped_column("x")) == column(spark, texts, values.stripped("x"))


def test_numbers_render_plainly(spark):
    df = spark.createDataFrame([(48.5,), (5000.0,), (12345678.25,), (1e7,), (float("nan"),)], "x double")
    got = [r[0] for r in df.select(F.expr(values.rendered("x", df.schema["x"].dataType))).collect()]
    assert got == ["48.5", "5000.0", "12345678.25", "10000000.0", None]


def test_pattern_gates_change_nothing(spark):
    items = ["a@b.co", "a b@c.de", "+254 700 111", "07.11-22(33)", "1.2.3.4", "1.2.3.4.5", "abcdef", "ab", "x@y", "@a.b", "2025-01-01"]
    for gated, pattern in ((values.is_email, fixed.EMAIL), (values.is_phone, fixed.PHONE), (values.is_ip, fixed.IP_V4),
                           (values.is_identifier, fixed.IDENTIFIER)):
        assert column(spark, items, gated("x")) == column(spark, items, values.matches("x", pattern))


def test_names():
    assert names.has_token("message", ("age",)) and not names.has_token("message", ("age",), "word")
    assert names.has_token("customerAge", ("age",), "word")
    assert names.is_email_flag("Email Verified") and not names.is_email_flag("email")
    assert names.privacy_by_name("first_name")[1] == "person_name"
    assert names.resolve(["Id", "id"], "ID") == "id"


def test_small_numbers_are_plain_text(spark):
    from dqspark.functions import values
    from pyspark.sql import types as T

    df = spark.createDataFrame([(x,) for x in (0.0005, 0.00012, -1e-7, 0.5, 0.0, 1.2345678901234e-4, 1e8, 0.001)], "x double")
    shown = [r[0] for r in df.selectExpr(values.rendered("x", T.DoubleType())).collect()]
    assert shown == ["0.0005", "0.00012", "-0.0000001", "0.5", "0.0", "0.00012345678901234", "100000000.0", "0.001"]
