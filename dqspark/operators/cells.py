"""One row per value: the long form every profiling aggregate is computed from.

A table of ``c`` columns becomes ``c`` rows per input row, made inside the scan stage
and folded there by partial aggregation.  The number of aggregate expressions then
does not grow with the number of columns, and audits of many slices (``by``) run in
one pass.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import names, values
from ..functions.values import name

# Longer values are counted under their SHA-256 digest, so that grouping documents
# moves some 130 bytes per value instead of the text.
DIGEST_ABOVE = 256
SHOWN = 64


def kind_of(dtype: T.DataType) -> str:
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if values.is_number_type(dtype):
        return "numeric"
    return "datetime" if values.is_time_type(dtype) else "text"


@dataclass(frozen=True)
class Layout:
    """Which columns are audited and which ones only name the slice."""

    by: tuple[str, ...]
    columns: tuple[str, ...]
    types: dict[str, T.DataType] = field(hash=False, default_factory=dict)

    @classmethod
    def of(cls, df: DataFrame, by: list[str] | tuple[str, ...] = (), columns: list[str] | None = None) -> Layout:
        audited = [c for c in (columns or df.columns) if c not in by]
        return cls(tuple(by), tuple(audited), {f.name: f.dataType for f in df.schema.fields})

    @property
    def slices(self) -> list[str]:
        return [name(c) for c in self.by]

    def ordinal(self, column: str) -> int:
        return self.columns.index(column)

    def kind(self, column: str) -> str:
        return kind_of(self.types[column])

    def where(self, test) -> str:
        """Boolean expression over ``ord``: columns whose name passes ``test``."""
        return values.among("ord", [self.ordinal(c) for c in self.columns if test(c)])

    def named(self, tokens: tuple[str, ...], match: str) -> str:
        return self.where(lambda c: names.has_token(c, tokens, match))

    def name_of(self) -> str:
        """Expression giving the column name of an ``ord``."""
        return f"element_at(array({values.items(self.columns)}), ord + 1)"


def cells(
    df: DataFrame, layout: Layout, only: list[str] | None = None, parse: bool = True, render: bool = True
) -> DataFrame:
    """(by..., ord, raw, text [, num, plain, ts]) for every value of the chosen columns.

    ``text`` is stripped, ``num`` ignores thousands commas, ``plain`` does not.  Without
    ``render`` the text of typed columns is left null, for passes that read numbers only.
    """
    entries = []
    for column in layout.columns:
        if only is not None and column not in only:
            continue
        dtype, value = layout.types[column], name(column)
        shown = values.rendered(value, dtype) if render or layout.kind(column) == "text" else "cast(null as string)"
        entry = f"{layout.ordinal(column)} as ord, {shown} as raw"
        if parse:
            number = values.number_of(value, dtype) if values.is_number_type(dtype) else "cast(null as double)"
            moment = values.timestamp_of(value, dtype) if values.is_time_type(dtype) else "cast(null as timestamp)"
            text = values.lit(layout.kind(column) == "text")
            entry += f", {text} as parsed, {number} as typed_num, {moment} as typed_ts"
        entries.append(f"struct({entry})")
    long = df.selectExpr(*layout.slices, f"inline(array({', '.join(entries)}))")
    if not parse:
        return long.selectExpr(*layout.slices, "ord", "raw", f"{values.stripped_column('raw')} as text")
    long = long.selectExpr("*", f"{values.stripped_column('raw')} as text")
    long = long.selectExpr(
        "*",
        f"if(parsed, {values.number_in('text')}, typed_num) as plain",
        f"if(parsed, {values.timestamp_in('text')}, typed_ts) as ts",
    )
    commas = f"if(parsed and contains(text, ','), {values.number_in('text', True)}, plain) as num"
    return long.selectExpr(*layout.slices, "ord", "raw", "text", commas, "plain", "ts")


def counting_key(text: str) -> str:
    """The stripped text itself; of a long one its first characters and its digest.

    Long keys begin with a blank, with which no stripped text begins, so that they equal no
    other value.
    """
    return f"if(char_length({text}) > {DIGEST_ABOVE}, concat(' ', left({text}, {SHOWN}), ' ', sha2({text}, 256)), {text})"


def key_order(key: str) -> str:
    """Order of counting keys: that of the values, long ones with equal beginnings by digest."""
    return f"if(startswith({key}, ' '), substr({key}, 2), {key})"


def value_counts(df: DataFrame, layout: Layout, only: list[str] | None = None) -> DataFrame:
    """(by..., ord, value, n): how often each non-null stripped value occurs.

    Partial aggregation folds hot values in the scan stage, so a value that fills a
    third of a column reaches the shuffle as one row per task.
    """
    long = cells(df, layout, only, parse=False).where("text is not null")
    long = long.selectExpr(*layout.slices, "ord", f"{counting_key('text')} as value")
    return long.groupBy(*long.columns).count().withColumnRenamed("count", "n")


def frequencies(df: DataFrame, layout: Layout, only: list[str] | None = None) -> DataFrame:
    """(by..., ord, value, spelling, n): how often each non-null value occurs, by stripped value and spelling.

    ``spelling`` is null where the value stands without surrounding blanks.  This is the one
    table from which distinct counts, quantiles, outliers, casing variants and repeated keys
    are taken.
    """
    long = cells(df, layout, only, parse=False).where("text is not null")
    written = f"if(char_length(raw) > {DIGEST_ABOVE}, {counting_key('raw')}, concat('=', raw))"
    long = long.selectExpr(*layout.slices, "ord", f"{counting_key('text')} as value", f"if(raw <> text, {written}, null) as spelling")
    return long.groupBy(*long.columns).count().withColumnRenamed("count", "n")


def by_value(counted: DataFrame, layout: Layout) -> DataFrame:
    """(by..., ord, value, n, spellings): frequencies with the spellings of a value put together."""
    return aggregate(counted, [*layout.by, "ord", "value"], n="sum(n)", spellings="count(1)")


def with_names(df: DataFrame, layout: Layout) -> DataFrame:
    """Add the column name next to ``ord`` (a literal array lookup, no join)."""
    return df.selectExpr("*", f"{layout.name_of()} as column")


def aggregate(df: DataFrame, keys: list[str], **measures: str) -> DataFrame:
    """``group by keys`` with named SQL aggregates."""
    return df.groupBy(*keys).agg(*[F.expr(f"{sql} as {alias}") for alias, sql in measures.items()])


def side_by_side(by: list[str], *tables: DataFrame) -> DataFrame:
    """Put tables of one row per slice next to each other, by union and one aggregate.

    Works the same with and without slices; what a table lacks for a slice is null.
    """
    stacked = tables[0]
    for table in tables[1:]:
        stacked = stacked.unionByName(table, allowMissingColumns=True)
    kept = [c for c in stacked.columns if c not in by]
    return aggregate(stacked, list(by), **{name(c): f"any_value({name(c)}, true)" for c in kept})
