"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..session import pin, shared_folder

__all__ = ["bound", "field", "lower_ascii", "pin", "row_ids", "shared_folder", "with_batches"]

SLICE = 256


def field(name: str, kind: str) -> T.StructField:
    """A nullable field from a DDL type."""
    return T.StructField(name, T.DataType.fromDDL(kind), True)


def with_batches(
    df: DataFrame, reads: Sequence[str], keeps: Sequence[str], fields: Sequence[T.StructField], start: Callable[[], Callable], rows: int = SLICE,
) -> DataFrame:
    """Columns ``keeps`` of ``df`` and new ``fields`` computed from columns ``reads``.

    ``start`` runs once per task and returns a function from lists of values (one per read
    column) to one list per new field.  Rows stay in their partition and go through Python
    in Arrow slices of ``rows`` rows, so memory is bounded by the rows of a slice.  A new field
    replaces a kept column of the same name.
    """
    new = {f.name for f in fields}
    kept = [c for c in keeps if c not in new]
    source = df.select(*[df[c].alias(f"_k{i}") for i, c in enumerate(kept)], *[df[c].alias(f"_r{i}") for i, c in enumerate(reads)])
    schema = T.StructType([*[T.StructField(f"_k{i}", df.schema[c].dataType) for i, c in enumerate(kept)], *fields])
    kinds, width, slice_rows = [to_arrow_type(f.dataType) for f in fields], len(kept), rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            for at in range(0, batch.num_rows, slice_rows):
                part = batch.slice(at, slice_rows)
                made = work(*[c.to_pylist() for c in part.columns[width:]])
                columns = [*part.columns[:width], *[pa.array(v, kind) for v, kind in zip(made, kinds, strict=True)]]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    out = source.mapInArrow(run, schema)
    return out.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(kept)], *[f.name for f in fields])


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def row_ids(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(row, key, _id): each row as a struct, its key, and a text that names its key and text together.

    Equal keys and texts give equal names; null differs from every other key and from the empty text.
    """
    name = F.coalesce(F.concat(F.lit("k"), F.col(key).cast("string")), F.lit("n"))
    digest = F.coalesce(F.md5(F.col(text).cast("binary")), F.lit("n"))
    return docs.select(F.struct(*docs.columns).alias("row"), F.col(key), F.concat_ws(" ", digest, name).alias("_id"))
