"""Column and dataset profiles (A1-A17) of one table, or of many slices at once.

Passes over the data, each independent of the number of columns and rules:

1. ``measure``: one grouped aggregate over the cells; shuffles one row per column and task.
2. ``frequencies``: how often each value occurs, the only pass that moves values.  Distinct
   counts, quantiles, outliers and casing variants are taken from its table.
3. duplicate rows, by digest.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions import fixed, names, values
from ..functions.values import lit, py_round, ratio
from ..session import pin, small_side, together
from . import privacy
from .cells import DIGEST_ABOVE, Layout, aggregate, by_value, cells, counting_key, frequencies, key_order, side_by_side, value_counts, with_names
from .duplicates import duplicate_counts
from .quantiles import exact_quantiles, sketch_of

IQR_REACH = 1.5


@dataclass(frozen=True)
class Options:
    """How a profile is made.

    ``name_match``: ``substring`` or ``word`` matching of name tokens.
    ``dtypes``: ``declared`` trusts the schema; ``csv`` treats an all-text table as a
    CSV reader would, so a text column made of numbers counts as a number column.
    ``approximate_distinct``: sketch the distinct counts of columns not named like keys
    instead of shuffling their values; key columns stay exact.
    ``quantiles``: ``exact``, or ``sketch`` to take quartiles from mergeable sketches made in the
    first pass; outliers are then counted exactly beyond approximate bounds.
    ``as_of``: timestamp text that date checks compare with; default is now.
    """

    name_match: str = "substring"
    dtypes: str = "declared"
    approximate_distinct: bool = False
    quantiles: str = "exact"
    as_of: str | None = None

    @property
    def now(self) -> str:
        return f"cast({lit(self.as_of)} as timestamp)" if self.as_of else "current_timestamp()"


DEFAULT = Options()


def cell_tests(options: Options) -> dict[str, str]:
    """What is counted over the cells: name -> test of one cell."""
    now = options.now
    tests = {
        "non_null": "text is not null",
        "missing_count": "not present",
        "padded": "present and raw <> text",
        "bool_tokens": values.in_tokens("text", fixed.BOOLEAN_TOKENS),
        "bool_words": "lower(text) in ('true', 'false')",
        "date_marks": values.has_date_mark("text"),
        "timestamps": "ts is not null",
        "numbers": "num is not null",
        "plain_numbers": "plain is not null",
        "emails": f"present and {values.is_email('text')}",
        "phones": f"present and {values.is_phone('text')}",
        "addresses": f"present and {values.is_ip('text')}",
        "cards": f"present and {values.is_card('text')}",
        "identifiers": f"present and {values.is_identifier('text')}",
        "negative": "plain < 0",
        "off_percent": "plain < 0 or plain > 100",
        "off_age": "plain < 0 or plain > 120",
        "future": f"ts > {now}",
        "off_birth": f"ts > {now} or ts < {values.months_back(now, 120)}",
        "stale": f"ts < {values.months_back(now, 3)}",
    }
    return tests


CELL_ENDS = {
    "num_min": "min(num)", "num_max": "max(num)", "ts_min": "min(ts)", "ts_max": "max(ts)",
    "len_min": "min(char_length(text))", "len_max": "max(char_length(text))",
}


def measure(df: DataFrame, layout: Layout, options: Options = DEFAULT, only: list[str] | None = None) -> DataFrame:
    """(by..., ord, measures): everything that needs to see each value only once."""
    long = cells(df, layout, only).selectExpr("*", f"not {values.missing('text')} as present")
    return aggregate(
        long, [*layout.by, "ord"],
        row_count="count(1)",
        **{k: f"count_if({test})" for k, test in cell_tests(options).items()},
        **CELL_ENDS,
        num_mean="avg(num)",
        num_std="stddev_pop(num)",
        len_mean="avg(char_length(text))",
        **({"num_sketch": sketch_of("num"), "plain_sketch": sketch_of("plain")} if options.quantiles == "sketch" else {}),
        **({"approx_distinct": "approx_count_distinct(if(present, text, null))"} if options.approximate_distinct else {}),
    )


def measure_values(counted: DataFrame, layout: Layout, known: DataFrame, options: Options = DEFAULT) -> DataFrame:
    """The measures of whole columns, taken from their frequencies instead of their rows.

    ``known`` has a row per column: ``ord``, its ``row_count``, and a ``centre`` near its mean, from
    which squares are taken.  For exact quartiles, and columns without values over 256
    characters, which frequencies hold by digest only.
    """
    kind = lambda test: layout.where(test)
    typed = kind(lambda c: layout.kind(c) == "numeric")
    single, timed = kind(lambda c: isinstance(layout.types[c], T.FloatType)), kind(lambda c: layout.kind(c) == "datetime")
    parsed = kind(lambda c: layout.kind(c) == "text")
    long = counted.selectExpr("ord", "n", "value as text", "coalesce(substr(spelling, 2), value) as raw").selectExpr(
        "*",
        f"case when {single} then cast(try_cast(text as float) as double) when {typed} then try_cast(text as double) when {parsed} then {values.number_in('text')} end as plain",
        f"case when {timed} then try_cast(text as timestamp) when {parsed} then {values.timestamp_in('text')} end as ts",
        f"not {values.missing('text')} as present",
    ).selectExpr("*", f"if({parsed} and contains(text, ','), {values.number_in('text', True)}, plain) as num")
    joined = long.join(known.select("ord", "centre"), "ord")
    size = "sum(if(num is not null, n, 0L))"
    found = aggregate(
        joined, ["ord"],
        **{k: f"coalesce(sum(if({test}, n, 0L)), 0L)" for k, test in cell_tests(options).items()},
        **CELL_ENDS,
        num_mean=f"sum(n * num) / nullif({size}, 0)",
        num_std=f"sum(n * (num - centre) * (num - centre)) / nullif({size}, 0)",
        len_mean="cast(sum(n * char_length(text)) as double) / nullif(sum(n), 0)",
    )
    zeros = [f"coalesce({k}, 0L) as {k}" for k in cell_tests(options) if k != "missing_count"]
    present = "coalesce(non_null, 0L) - coalesce(missing_count, 0L)"
    return known.join(found, "ord", "left").selectExpr(
        "ord", "row_count", f"row_count - ({present}) as missing_count", *zeros, *CELL_ENDS, "num_mean", "len_mean",
        "sqrt(greatest(num_std - (num_mean - centre) * (num_mean - centre), 0D)) as num_std",
    )


def distinct_measures(df: DataFrame, layout: Layout, only: list[str] | None = None) -> DataFrame:
    """(by..., ord, distinct_text, unique_count, repeated_rows) from value frequencies.

    ``distinct_text`` counts blanks as a value, ``unique_count`` does not;
    ``repeated_rows`` counts all rows whose non-blank value occurs more than once.
    """
    return distinct_counts(value_counts(df, layout, only).selectExpr("*", "1L as spellings"), layout)


def distinct_counts(valued: DataFrame, layout: Layout) -> DataFrame:
    """The same from a table of values with ``n`` and ``spellings``; ``unique_count`` counts every spelling."""
    return aggregate(
        valued, [*layout.by, "ord"],
        distinct_text="count(1)",
        unique_count="coalesce(sum(if(value <> '', spellings, 0L)), 0L)",
        repeated_rows="coalesce(sum(if(value <> '' and n > 1, n, 0L)), 0L)",
    )


BOOLEAN_SHARE = f"{ratio('bool_tokens', 'non_null')} >= 0.95D"


def inferred_type(layout: Layout, options: Options) -> str:
    """Semantic type of a column from its measures: the first line that holds decides."""
    share = lambda part: ratio(part, "non_null")
    declared = lambda kind: layout.where(lambda c: layout.kind(c) == kind)
    csv = lit(options.dtypes == "csv")
    return f"""case
        when non_null = 0 then 'empty'
        when {layout.named(fixed.TEXT_NAME, options.name_match)} then 'text'
        when {declared("boolean")} or ({csv} and bool_words = non_null) then 'boolean'
        when {declared("numeric")} or ({csv} and plain_numbers = non_null) then 'numeric'
        when {declared("datetime")} then 'datetime'
        when {BOOLEAN_SHARE} and distinct_text <= 6 then 'boolean'
        when ({layout.named(fixed.DATE_NAME, options.name_match)} or {share("date_marks")} >= 0.8D)
             and {share("timestamps")} >= 0.85D then 'datetime'
        when {share("numbers")} >= 0.9D then 'numeric'
        else 'text' end"""


@dataclass(frozen=True)
class Counted:
    """What one pass over the cells and one over the values leave: both tables are pinned.

    ``measures`` has a row per slice and column, ``values`` the frequencies of
    ``cells.frequencies`` for the columns in ``exact`` (all but the sketched ones).
    """

    measures: DataFrame
    values: DataFrame | None
    padded: tuple[str, ...]
    exact: tuple[str, ...]


def count_cells(df: DataFrame, layout: Layout, options: Options = DEFAULT, keep: bool = True, only: list[str] | None = None) -> Counted:
    """Measures and value frequencies of a table, or of some of its columns, in two passes.

    Without ``keep`` the frequencies are not written, for callers that read them once.
    """
    exact = layout.columns if only is None else tuple(only)
    if options.approximate_distinct:
        exact = tuple(c for c in exact if names.has_token(c, fixed.KEY_NAME, options.name_match))
    found = frequencies(df, layout, list(exact)) if exact else None
    if keep and exact:
        base, found = together(df.sparkSession, lambda: pin(measure(df, layout, options, only)), lambda: pin(found))
    else:
        base = pin(measure(df, layout, options, only))
    padded = tuple(layout.columns[r[0]] for r in base.where("padded > 0").select("ord").distinct().collect())
    return Counted(base, found, padded, exact)


def with_distinct(counted: Counted, layout: Layout, options: Options = DEFAULT) -> DataFrame:
    """Measures, distinct counts and inferred type, pinned: one row per slice and column."""
    if counted.values is None:
        full = counted.measures.selectExpr("*", "approx_distinct as distinct_text", "approx_distinct as unique_count", "0L as repeated_rows")
    else:
        valued = by_value(counted.values, layout) if counted.padded else counted.values.selectExpr("*", "1L as spellings")
        other = "approx_distinct" if options.approximate_distinct else "0L"
        dropped = ", ".join([*(layout.slices if layout.by else []), "distinct_text", "unique_count", "repeated_rows"])
        full = counted.measures.join(distinct_counts(valued, layout), [*layout.by, "ord"], "left").selectExpr(
            *layout.slices, f"* except ({dropped})", f"coalesce(distinct_text, {other}) as distinct_text",
            f"coalesce(unique_count, {other}) as unique_count", "coalesce(repeated_rows, 0L) as repeated_rows",
        )
    return pin(full).selectExpr("*", f"{inferred_type(layout, options)} as inferred_type")


def column_measures(df: DataFrame, layout: Layout, options: Options = DEFAULT) -> DataFrame:
    """``with_distinct`` of a table whose value frequencies nobody else needs."""
    return with_distinct(count_cells(df, layout, options, keep=False), layout, options)


TYPE_TESTS = ("non_null", "bool_tokens", "bool_words", "date_marks", "timestamps", "numbers", "plain_numbers")


def column_types(df: DataFrame, layout: Layout, options: Options = DEFAULT) -> DataFrame:
    """(by..., ord, inferred_type) of every column, without the other measures.

    Only a column of boolean words is asked how many different values it has, so no other
    column's values are moved.  These are counted exactly, whatever the options.
    """
    keys, tests = [*layout.by, "ord"], cell_tests(options)
    base = pin(aggregate(cells(df, layout), keys, **{k: f"count_if({tests[k]})" for k in TYPE_TESTS}))
    texts = layout.where(lambda c: layout.kind(c) == "text" and not names.has_token(c, fixed.TEXT_NAME, options.name_match))
    maybe = base.where(f"{texts} and non_null > 0 and {BOOLEAN_SHARE}").select("ord").distinct().collect()
    if maybe:
        counted = aggregate(value_counts(df, layout, [layout.columns[r["ord"]] for r in maybe]), keys, distinct_text="count(1)")
        full = base.join(counted, keys, "left")
    else:
        full = base.selectExpr("*", "0L as distinct_text")
    return full.selectExpr(*layout.slices, "ord", f"{inferred_type(layout, options)} as inferred_type")


NO_OUTLIERS = (
    "median double, q1 double, q3 double, outliers long, plain_q1 double, plain_q3 double, plain_outliers long"
)


def numbers_in(df: DataFrame | None, layout: Layout, ords: list[int], counted: Counted | None, long_values: bool) -> DataFrame:
    """(by..., ord, num, plain, n): the numbers of the chosen columns, read from their frequencies where there are any.

    Typed numbers come back from their text unchanged; a text over 256 characters is kept by
    digest only, so numbers written that long are read from the rows.
    """
    columns = [layout.columns[i] for i in ords]
    kept = [c for c in columns if counted is not None and counted.values is not None and c in counted.exact]
    parts = []
    if kept:
        typed = layout.where(lambda c: layout.kind(c) == "numeric")
        single = layout.where(lambda c: isinstance(layout.types[c], T.FloatType))
        read = f"case when {single} then cast(try_cast(value as float) as double) when {typed} then try_cast(value as double) else {values.number_in('value')} end"
        found = counted.values.where(values.among("ord", [layout.ordinal(c) for c in kept])).selectExpr(*layout.slices, "ord", "value", "n", f"{read} as plain")
        commas = f"if(contains(value, ','), {values.number_in('value', True)}, plain)"
        parts.append(found.selectExpr(*layout.slices, "ord", f"{commas} as num", "plain", "n"))
    rest = [c for c in columns if c not in kept]
    if rest:
        parts.append(cells(df, layout, rest, render=False).selectExpr(*layout.slices, "ord", "num", "plain", "1L as n"))
    if kept and long_values and df is not None:
        texts = [c for c in kept if layout.kind(c) == "text"]
        if texts:
            parts.append(cells(df, layout, texts).where(f"char_length(text) > {DIGEST_ABOVE}").selectExpr(*layout.slices, "ord", "num", "plain", "1L as n"))
    return reduce(DataFrame.unionByName, parts)


def outlier_measures(
    df: DataFrame | None, layout: Layout, measures: DataFrame, options: Options = DEFAULT, counted: Counted | None = None
) -> DataFrame:
    """Quartiles and outlier counts of the numeric columns.

    Two readings exist: ``num`` (thousands commas dropped) for profiles and ``plain``
    for the outlier detector.  They share one pass unless commas occur.  With ``counted``
    the numbers are taken from its frequencies; the rows are not read again.
    """
    keys = [*layout.by, "ord"]
    skipped = layout.named(fixed.NOT_OUTLIER_NAME, options.name_match)
    wanted = measures.where(
        f"(inferred_type = 'numeric' and numbers >= 4) or (not {skipped} and plain_numbers >= 8)"
    )
    facts = wanted.selectExpr(
        "sort_array(collect_set(ord)) as ords", "coalesce(max(numbers <> plain_numbers), false) as commas",
        f"coalesce(max(len_max) > {DIGEST_ABOVE}, false) as long_values",
    ).first()
    if not facts["ords"]:
        fields = [f"cast(null as {part.split()[1]}) as {part.split()[0]}" for part in NO_OUTLIERS.split(", ")]
        return measures.where("false").selectExpr(*layout.slices, "ord", *fields)
    readings = "struct('num' as reading, num as x)"
    if facts["commas"]:
        readings += ", struct('plain' as reading, plain as x)"
    read = numbers_in(df, layout, facts["ords"], counted, facts["long_values"])
    numbers = pin(read.selectExpr(*layout.slices, "ord", "n", f"inline(array({readings}))").where("x is not null"))
    keyed = [*keys, "reading"]
    quartiles = [0.25, 0.5, 0.75]
    if options.quantiles == "sketch":
        sketches = ", ".join(f"struct('{r}' as reading, {count} as n, {r}_sketch as sketch)" for r, count in (("num", "numbers"), ("plain", "plain_numbers"))[: 1 + facts["commas"]])
        shown = [f"kll_sketch_get_quantile_double(sketch, {p!r}D) as q{i}" for i, p in enumerate(quartiles)]
        bounds = wanted.selectExpr(*layout.slices, "ord", f"inline(array({sketches}))").where("sketch is not null").selectExpr(*layout.slices, "ord", "reading", "n", *shown)
    else:
        bounds = exact_quantiles(numbers, keyed, quartiles, weight="n")
    reach = f"{IQR_REACH}D * (q2 - q0)"
    beyond = aggregate(
        numbers.withColumnRenamed("n", "times").join(small_side(bounds.where("q2 <> q0")), keyed), keyed,
        outliers=f"coalesce(sum(if(x < q0 - {reach} or x > q2 + {reach}, times, 0L)), 0L)",
    )
    full = pin(bounds.join(beyond, keyed, "left").fillna({"outliers": 0}))
    plain = "plain" if facts["commas"] else "num"
    return aggregate(
        full, keys,
        median="max(if(reading = 'num', q1, null))",
        q1="max(if(reading = 'num', q0, null))",
        q3="max(if(reading = 'num', q2, null))",
        outliers="max(if(reading = 'num', outliers, null))",
        plain_q1=f"max(if(reading = '{plain}', q0, null))",
        plain_q3=f"max(if(reading = '{plain}', q2, null))",
        plain_outliers=f"max(if(reading = '{plain}', outliers, null))",
    )


def cardinality(unique: str, rows: str) -> str:
    """Label by number and share of distinct values."""
    share = ratio(unique, rows)
    return (
        f"case when {rows} = 0 or {unique} = 0 then 'empty' when {unique} = 1 then 'constant'"
        f" when {share} <= 0.05D then 'low' when {share} >= 0.95D then 'unique'"
        f" when {share} >= 0.5D then 'high' else 'medium' end"
    )


def risk_score() -> str:
    """Points for what a column's measures show."""
    return "least(100, " + " + ".join(f"if({test}, {points}, 0)" for _, points, test in fixed.RISK_POINTS) + ")"


def risk_signals() -> str:
    told = ", ".join(f"if({test}, {lit(code)}, null)" for code, _, test in fixed.RISK_POINTS)
    return f"filter(array({told}), s -> s is not null)"


def described(layout: Layout, measures: DataFrame, outliers: DataFrame, options: Options = DEFAULT) -> DataFrame:
    """Measures with the rates, labels and risk derived from them (no scan of the data)."""
    keys = [*layout.by, "ord"]
    joined = privacy.with_finding(measures.join(outliers, keys, "left"), layout, options.name_match)
    rated = joined.selectExpr(
        "*",
        f"{layout.name_of()} as column",
        "if(inferred_type = 'numeric' and numbers >= 4, coalesce(outliers, 0L), 0L) as outlier_count",
        f"{py_round(ratio('missing_count', 'row_count'), 4)} as missing_rate",
        f"{py_round(ratio('unique_count', 'row_count'), 4)} as unique_rate",
        f"{cardinality('unique_count', 'row_count')} as cardinality",
        "unique_count = 1 and row_count > 1 as constant",
    ).selectExpr("*", f"{py_round(ratio('outlier_count', 'numbers'), 4)} as outlier_rate")
    return rated.selectExpr("*", f"{risk_score()} as risk_score", f"{risk_signals()} as signals")


def column_profiles(layout: Layout, scored: DataFrame, options: Options = DEFAULT) -> DataFrame:
    """The published columns of a profile, from ``described``."""
    only = lambda kinds, sql: f"case when inferred_type in ({kinds}) then {sql} end"
    return scored.selectExpr(
        *layout.slices, "ord", "column", "inferred_type", "row_count", "missing_count", "missing_rate", "unique_count",
        "unique_rate", "cardinality", "constant",
        f"unique_rate >= 0.95D or {layout.named(fixed.IDENTIFIER_NAME, options.name_match)} as identifier_candidate",
        f"{only(lit('numeric'), 'num_min')} as min",
        f"{only(lit('numeric'), 'num_max')} as max",
        f"{only(lit('numeric'), py_round('num_mean', 4))} as mean",
        f"{only(lit('numeric'), 'median')} as median",
        f"{only(lit('numeric'), py_round('num_std', 4))} as std_dev",
        f"{only(lit('datetime'), 'ts_min')} as first_timestamp",
        f"{only(lit('datetime'), 'ts_max')} as last_timestamp",
        f"{only(values.items(['text', 'boolean']), 'len_min')} as min_length",
        f"{only(values.items(['text', 'boolean']), 'len_max')} as max_length",
        f"{only(values.items(['text', 'boolean']), py_round('len_mean', 2))} as average_length",
        "outlier_count", "outlier_rate", "risk_score",
        "case when risk_score >= 50 then 'high' when risk_score >= 20 then 'medium' else 'low' end as risk_level",
        "signals", "privacy.classification as privacy_classification", "privacy.sensitivity as sensitivity",
        "coalesce(privacy.confidence, 0D) as privacy_confidence",
        "coalesce(privacy.reasons, cast(array() as array<string>)) as privacy_reasons",
        "privacy.masking as masking_recommendation",
    )


def profile_columns(
    df: DataFrame, by: list[str] | None = None, options: Options = DEFAULT, columns: list[str] | None = None
) -> DataFrame:
    """One row per (slice and) column: the whole column profile."""
    layout = Layout.of(df, by or [], columns)
    counted = count_cells(df, layout, options)
    measures = with_distinct(counted, layout, options)
    scored = described(layout, measures, outlier_measures(df, layout, measures, options, counted), options)
    return column_profiles(layout, scored, options)


def schema_profile(
    df: DataFrame, by: list[str] | None = None, options: Options = DEFAULT, columns: list[str] | None = None
) -> DataFrame:
    """Type, completeness and distinct counts only: what drift and contracts compare, without quantiles."""
    layout = Layout.of(df, by or [], columns)
    return column_measures(df, layout, options).selectExpr(
        *layout.slices, "ord", f"{layout.name_of()} as column", "inferred_type", "row_count", "missing_count",
        f"{py_round(ratio('missing_count', 'row_count'), 4)} as missing_rate", "unique_count",
        f"{py_round(ratio('unique_count', 'row_count'), 4)} as unique_rate",
    )


def scan_privacy(
    df: DataFrame, by: list[str] | None = None, options: Options = DEFAULT, columns: list[str] | None = None
) -> DataFrame:
    """Sensitivity of every column, without the rest of the profile (V7)."""
    layout = Layout.of(df, by or [], columns)
    found = privacy.with_finding(column_measures(df, layout, options), layout, options.name_match)
    return found.selectExpr(
        *layout.slices, "ord", f"{layout.name_of()} as column", "privacy.classification as privacy_classification",
        "privacy.sensitivity as sensitivity", "coalesce(privacy.confidence, 0D) as privacy_confidence",
        "coalesce(privacy.reasons, cast(array() as array<string>)) as privacy_reasons", "privacy.masking as masking_recommendation",
    )


def dataset_profile(profiles: DataFrame, duplicates: DataFrame, by: list[str]) -> DataFrame:
    """One row per slice: counts, completeness, duplicates, risk and sensitivity."""
    rank = values.lookup("sensitivity", fixed.SENSITIVITY_RANK)
    total = aggregate(
        profiles, by,
        row_count="max(row_count)",
        column_count="count(1)",
        missing="sum(missing_count)",
        high_risk_column_count="count_if(risk_level = 'high')",
        medium_risk_column_count="count_if(risk_level = 'medium')",
        sensitive_column_count="count(sensitivity)",
        highest_sensitivity=f"coalesce(max_by(sensitivity, {rank}), 'low')",
    )
    return side_by_side(by, total, duplicates).selectExpr(
        *[values.name(c) for c in by], "row_count", "column_count", "duplicate_row_count",
        f"{py_round('1D - ' + ratio('missing', 'row_count * column_count'), 4)} as completeness_rate",
        f"{py_round(ratio('duplicate_row_count', 'row_count'), 4)} as duplicate_row_rate",
        "rows_in_duplicate_groups", "high_risk_column_count", "medium_risk_column_count", "sensitive_column_count",
        "highest_sensitivity",
    )


def profile_dataset(df: DataFrame, by: list[str] | None = None, options: Options = DEFAULT) -> DataFrame:
    """Dataset-level profile in one call."""
    by = by or []
    return dataset_profile(profile_columns(df, by, options), duplicate_counts(df, Layout.of(df, by)), by)


def first_in_order(df: DataFrame, keys: list[str], order: str, k: int) -> DataFrame:
    """The first k rows per key.

    The rank filter lets Spark keep k rows per key in each task before the shuffle, so
    no key is gathered whole.
    """
    return df.selectExpr(
        "*", f"row_number() over (partition by {', '.join(values.name(c) for c in keys)} order by {order}) as place"
    ).where(f"place <= {int(k)}")


def _shown(df: DataFrame, by: list[str] | None, columns: list[str] | None, sensitive: bool) -> tuple[DataFrame, Layout]:
    """The columns whose values may be listed: those named, or all but the ones whose name says they are private."""
    if columns is None and not sensitive:
        columns = [c for c in df.columns if c not in (by or []) and names.privacy_by_name(c) is None]
    if columns == []:
        return df.where("false"), Layout.of(df, by or [])
    return df, Layout.of(df, by or [], columns)


def top_values(
    df: DataFrame, k: int = 5, by: list[str] | None = None, columns: list[str] | None = None, sensitive: bool = False
) -> DataFrame:
    """(by..., column, value, n, place): the k most frequent stripped values.

    Ties go to the smaller value; long values that begin alike are taken by digest.  The
    text of long values is fetched afterwards, for the k winners only.  Columns that are
    private by name are left out unless they are named or ``sensitive`` is set.
    """
    df, layout = _shown(df, by, columns, sensitive)
    keys = [*layout.by, "ord"]
    best = pin(first_in_order(value_counts(df, layout), keys, f"n desc, {key_order('value')}", k))
    hidden = best.where("startswith(value, ' ')")
    ords = [r[0] for r in hidden.select("ord").distinct().collect()]
    if ords:
        long = cells(df, layout, [layout.columns[i] for i in ords], parse=False).where(
            f"char_length(text) > {DIGEST_ABOVE}"
        )
        long = long.selectExpr(*layout.slices, "ord", "text", f"{counting_key('text')} as value")
        found = long.join(small_side(hidden.select(*keys, "value")), [*keys, "value"], "left_semi")
        texts = aggregate(found, [*keys, "value"], text="min(text)")
        best = best.join(texts, [*keys, "value"], "left").selectExpr(
            *layout.slices, "ord", "coalesce(text, value) as value", "n", "place"
        )
    return with_names(best, layout).selectExpr(*layout.slices, "column", "value", "n", "place")


def sample_values(
    df: DataFrame, k: int = 5, by: list[str] | None = None, columns: list[str] | None = None,
    order_by: list[str] | None = None, sensitive: bool = False,
) -> DataFrame:
    """(by..., column, value, place): k non-blank example values per column.

    With ``order_by`` the first k rows in that order are shown, otherwise the k smallest
    distinct values.  Columns that are private by name are left out unless they are named or
    ``sensitive`` is set.
    """
    df, layout = _shown(df, by, columns, sensitive)
    order = "value"
    if order_by:
        ordered = df.selectExpr("*", f"struct({', '.join(values.name(c) for c in order_by)}) as __order")
        carried = Layout.of(ordered, [*layout.by, "__order"], list(layout.columns))
        shown = cells(ordered, carried, parse=False).where("text <> ''")
        shown = shown.selectExpr(*layout.slices, "ord", "text as value", "__order")
        order = "__order, value"
    else:
        shown = cells(df, layout, parse=False).where("text <> ''")
        shown = shown.selectExpr(*layout.slices, "ord", "text as value").distinct()
    ranked = first_in_order(shown, [*layout.by, "ord"], order, k)
    return with_names(ranked, layout).selectExpr(*layout.slices, "column", "value", "place")
