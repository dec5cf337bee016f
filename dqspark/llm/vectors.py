"""Vectors as whole numbers: validity, rounding, and arrays of a batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Whole numbers are held to this magnitude, so that absurd entries overflow nowhere.
MOST = 1 << 40


def usable(vector: str) -> Column:
    """Whether a vector is there and all its entries are finite numbers."""
    good = F.forall(vector, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & good, F.lit(False))


def whole(vector: str, factor: int, plus: int = 0) -> Column:
    """floor(factor * entry) + plus of each entry, as longs; beyond ``MOST`` in size an entry counts as ``MOST``."""
    return F.transform(vector, lambda e: F.least(F.greatest(F.floor(e.cast("double") * factor), F.lit(-MOST)), F.lit(MOST)).cast("long") + F.lit(plus).cast("long"))


def common_length(df: DataFrame, vector: str) -> int | None:
    """The length that most vectors have, the shortest of equally frequent ones; None without a vector."""
    found = df.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), "d").first()
    return None if found is None else found["d"]


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """The rows of an array<long> column without nulls, as int64."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), d)
