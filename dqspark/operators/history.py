"""Shared pieces for queries over audit-history tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import lit, name


def query(sql: str, **tables: DataFrame) -> DataFrame:
    """Run SQL over the given tables, named as ``{table}`` in the text."""
    spark = next(iter(tables.values())).sparkSession
    return spark.sql(sql, **tables)


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row per key in an order of expressions, nulls coming first.

    Every task keeps one row of a key before the shuffle, so a key with a long history costs
    no more than one with a short one.
    """
    last = ", ".join(f"{sql} desc nulls last" for sql in order)
    part = ", ".join(name(k) for k in keys) or "1"
    return df.selectExpr("*", f"row_number() over (partition by {part} order by {last}) as __place").where("__place = 1").drop("__place")


def page_after(df: DataFrame, order: list[tuple[str, bool]], k: int, after: dict | None = None) -> DataFrame:
    """The k rows that follow a given one in an order; the first k without one.

    ``order`` lists columns and whether they fall; together they must tell rows apart.
    ``after`` holds their values in the last row of the page before.  Nulls come first where a
    column rises and last where it falls.  Unlike an offset, a page costs the same however far
    it is: rows before it are skipped by a filter, and every task keeps k rows.
    """
    if after is not None:
        tests, equal = [], []
        for column, falls in order:
            value, sql = lit(after[column]) if not isinstance(after[column], datetime) else f"timestamp '{after[column]}'", name(column)
            if after[column] is None:
                beyond = "false" if falls else f"{sql} is not null"
            else:
                beyond = f"({sql} < {value} or {sql} is null)" if falls else f"{sql} > {value}"
            tests.append(" and ".join([*equal, beyond]))
            equal.append(f"{sql} <=> {value}")
        df = df.where(" or ".join(f"({t})" for t in tests))
    return df.orderBy(*[F.col(name(c)).desc_nulls_last() if falls else F.col(name(c)).asc_nulls_first() for c, falls in order]).limit(k)
