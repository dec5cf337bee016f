"""Tables that are updated in place, a few hash buckets at a time.

A row's bucket is a hash of its key.  An update reads, merges and rewrites only the buckets
that hold a key of the new rows, and of these only the ones that come out different; the rest
of the table is neither read nor moved.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions.values import name
from ..operators.cells import Layout
from ..operators.duplicates import row_digest
from ..session import pin

BUCKET = "__bucket"


class BucketedTable:
    """A table below ``path``, dealt into ``buckets`` folders by the hash of its ``keys``.

    The number of buckets is kept with the table; opening it with other keys or another number
    is refused.  A bucket is rewritten by a dynamic partition overwrite, so a run that fails
    before its commit leaves the table as it was, and repeating it gives the same table.  One
    writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 64):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), list(keys), buckets
        told = hashlib.sha256(json.dumps([self.keys, buckets]).encode()).hexdigest()
        try:
            kept = spark.read.parquet(f"{self.path}/_layout").first()["layout"]
        except AnalysisException:
            spark.sql(f"select '{told}' as layout").coalesce(1).write.parquet(f"{self.path}/_layout")
            kept = told
        if kept != told:
            raise ValueError("the table has other keys or another number of buckets")

    def bucket(self) -> F.Column:
        """Number of a row's bucket; keys are compared as text, null being a key like any other."""
        text = [F.coalesce(F.concat(F.lit("="), F.col(name(k)).cast("string")), F.lit("")) for k in self.keys]
        return F.pmod(F.xxhash64(*text), F.lit(self.buckets)).cast("int")

    def read(self, numbers: list[int] | None = None) -> DataFrame | None:
        """The rows, or those of some buckets; None before the first update."""
        try:
            rows = self.spark.read.parquet(f"{self.path}/rows")
        except AnalysisException:
            return None
        return (rows if numbers is None else rows.where(F.col(BUCKET).isin(numbers))).drop(BUCKET)

    def update(self, fresh: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Merge new rows into the buckets of their keys; returns the numbers of the buckets rewritten.

        ``merge`` gets the present rows of these buckets and the new rows, and returns what the
        buckets shall hold; it keeps the key of a row.
        """
        fresh = pin(fresh.withColumn(BUCKET, self.bucket()))
        touched = sorted(r[0] for r in fresh.select(BUCKET).distinct().collect())  # at most one per bucket
        if not touched:
            return []
        rows = fresh.drop(BUCKET)
        held = self.read(touched)
        merged = pin(merge(rows.limit(0) if held is None else held, rows).withColumn(BUCKET, self.bucket()))
        changed = touched if held is None else self.different(held, merged)
        if changed:
            # keys that agree on a bucket lie in one file of it
            out = merged.where(F.col(BUCKET).isin(changed)).repartition(min(len(changed), self.buckets), BUCKET)
            out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(f"{self.path}/rows")
        return changed

    def different(self, held: DataFrame, merged: DataFrame) -> list[int]:
        """Buckets whose rows are not the same before and after, compared by digests of the rows."""
        marked = []
        for df, sign in ((held.withColumn(BUCKET, self.bucket()), 1), (merged, -1)):
            columns = sorted(c for c in df.columns if c != BUCKET)
            marked.append(df.selectExpr(BUCKET, f"{row_digest(Layout.of(df, columns=columns))} as digest", f"{sign} as n"))
        moved = marked[0].unionByName(marked[1]).groupBy(BUCKET, "digest").agg(F.sum("n").alias("n")).where("n <> 0")
        return sorted(r[0] for r in moved.select(BUCKET).distinct().collect())
