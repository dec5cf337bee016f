"""Load the given tables and derived views into Spark."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from dqspark.session import prepare
from dqspark.sources.readers import spread

from .views import VIEWS, _order


def table(spark: SparkSession, sf_dir: str, name: str, heavy: bool = False) -> DataFrame:
    """A given table, timestamps as UTC instants.  ``heavy``: the query computes much per row."""
    prepare(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if heavy:
        df = spread(df)
    return df.selectExpr(*[
        f"cast({f.name} as timestamp) as {f.name}" if isinstance(f.dataType, T.TimestampNTZType) else f.name
        for f in df.schema.fields
    ])


BASE = {
    "customer_dirty": "customer", "orders_dirty": "orders", "people": "orders", "order_versions": "orders", "slices": "orders",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view over the whole base table."""
    order = _order([name])
    bases = sorted({BASE[v] for v in order if v in BASE})
    frames = {b: table(spark, sf_dir, b, heavy="slices" not in order) for b in bases}
    sql = ", ".join(f"{v} as ({VIEWS[v]})" for v in order)
    for base in bases:
        sql = re.sub(rf"\bfrom {base}\b", f"from {{{base}}}", sql)
    return spark.sql(f"with {sql} select * from {name}", **frames)


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History issues with their columns as an array."""
    return view(spark, sf_dir, "issue_rows").selectExpr(
        "* except (column_list)", "split(column_list, ',') as columns", "cast(null as string) as rule_name"
    )
