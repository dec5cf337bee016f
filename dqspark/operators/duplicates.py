"""Full-row duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions.values import name
from .cells import Layout, aggregate


def row_digest(layout: Layout) -> str:
    """SHA-256 over an unambiguous encoding of the audited columns.

    Grouping on the digest moves 32 bytes per row instead of the row.  Null and NaN are
    one value, -0.0 equals 0.0.
    """
    parts = []
    for column in layout.columns:
        text = encoded(name(column), layout.types[column])
        parts.append(f"coalesce(concat(cast(char_length({text}) as string), ':', {text}), '-')")
    return f"unhex(sha2(concat({', '.join(parts)}), 256))"


def encoded(value: str, dtype: T.DataType) -> str:
    """A value as text, equal values as equal texts; null and NaN are null, the order of a map does not matter."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return f"cast(nullif(cast({value} as double), double('NaN')) + 0D as string)"
    if isinstance(dtype, T.MapType):
        return f"to_json(array_sort(map_entries({value})))"
    if isinstance(dtype, (T.ArrayType, T.StructType, T.VariantType)):
        return f"to_json({value})"
    if isinstance(dtype, T.BinaryType):
        return f"hex({value})"
    return f"cast({value} as string)"


def copies(df: DataFrame, layout: Layout) -> DataFrame:
    """(by..., digest, copies): one row per distinct row."""
    hashed = df.selectExpr(*layout.slices, f"{row_digest(layout)} as digest")
    return aggregate(hashed, [*layout.by, "digest"], copies="count(1)")


def duplicate_counts(df: DataFrame, layout: Layout) -> DataFrame:
    """(by..., duplicate_row_count, rows_in_duplicate_groups): excess copies, and all copies."""
    return excess(copies(df, layout), layout)


def excess(counted: DataFrame, layout: Layout) -> DataFrame:
    """The same from the number of copies of each distinct row."""
    return aggregate(
        counted,
        list(layout.by),
        duplicate_row_count="coalesce(sum(copies - 1), 0L)",
        rows_in_duplicate_groups="coalesce(sum(if(copies > 1, copies, 0L)), 0L)",
    )
