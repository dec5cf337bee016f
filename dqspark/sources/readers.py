"""Reading datasets and checking their header."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..functions import fixed, values
from ..functions.values import name
from .records import BYTE_ENCODINGS, records

ODD = "__odd_record"


class IngestionError(ValueError):
    """A dataset that cannot be read safely."""


def check_header(header: list[str]) -> list[str]:
    """Stripped column names; refuses unnamed and repeated ones."""
    stripped = [str(item).strip() for item in header]
    if not any(stripped):
        raise IngestionError("the file needs a header row")
    unnamed = [str(i) for i, item in enumerate(stripped, start=1) if not item]
    if unnamed:
        raise IngestionError(f"unnamed columns at positions {', '.join(unnamed)}")
    repeated = sorted({item for item in stripped if stripped.count(item) > 1})
    if repeated:
        raise IngestionError(f"repeated column names: {', '.join(repeated)}")
    return stripped


def _first_line(spark: SparkSession, path: str, encoding: str) -> str:
    reader = spark.read.option("header", False).option("sep", "\x01").option("quote", "").option("encoding", encoding)
    row = reader.csv(path, schema="line string").first()
    if row is None:
        raise IngestionError("the file is empty")
    return (row["line"] or "").lstrip("﻿")


def _survey_lines(spark: SparkSession, path: str):
    """One pass over the lines: is any not UTF-8, and does a record run over several lines?

    In the second case some line has an odd number of quotes.
    """
    return spark.read.text(path).selectExpr(
        "coalesce(bool_or(not is_valid_utf8(value)), false) as foreign",
        "coalesce(bool_or((length(value) - length(replace(value, '\"', ''))) % 2 = 1), false) as broken",
    ).first()


def read_csv(
    spark: SparkSession, path: str, encoding: str | None = None, na_tokens: tuple[str, ...] = fixed.NA_TOKENS,
    multi_line: bool | None = None,
) -> DataFrame:
    """Read a CSV with a header as text columns, missing-value tokens as null.

    Types are inferred later by the profile, over all rows.  Without an encoding UTF-8 is
    tried first and Latin-1 used when some line does not decode.  Files are split and read in
    parallel, also where records run over several lines (``records``); ``multi_line`` says
    so when the caller knows, otherwise a pass over the lines finds out.  Only in an encoding
    of several bytes a character is a file with such records one task.

    All files must have the same header.  Rows with too few fields are padded with nulls;
    a row with too many is refused when it is read.
    """
    try:
        line = _first_line(spark, path, encoding or "UTF-8")
    except IngestionError:
        raise
    except Exception as problem:
        raise IngestionError(f"cannot read {path}: {problem}") from problem
    if encoding is None or multi_line is None:
        seen = _survey_lines(spark, path)
        if encoding is None and seen["foreign"]:
            encoding = "ISO-8859-1"
            line = _first_line(spark, path, encoding)
        multi_line = seen["broken"] if multi_line is None else multi_line
    encoding = encoding or "UTF-8"
    raw = next(csv.reader([line]), [])
    columns = check_header(raw)
    if multi_line and encoding.upper() in BYTE_ENCODINGS:
        return normalise_na(_fields(records(spark, path, encoding.upper(), line.rstrip("\r")), len(raw)).toDF(*columns), na_tokens)
    parsed = T.StructType([T.StructField(column, T.StringType()) for column in raw])
    reader = spark.read.option("header", True).option("enforceSchema", False).option("encoding", encoding)
    reader = reader.option("columnPruning", False).option("multiLine", multi_line).option("escape", '"').option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", ODD)
    read = reader.csv(path, schema=parsed.add(ODD, "string"))
    # An odd row has too few or too many fields; reading it with one more column tells which.
    wider = ", ".join(f"c{i} string" for i in range(len(raw) + 1))
    last = f"from_csv({name(ODD)}, '{wider}', map('escape', '\"', 'multiLine', '{str(multi_line).lower()}')).c{len(raw)}"
    # The message names a data column only because Spark reads no odd records without one.
    refuse = f"cast(raise_error(concat('a row has more than {len(raw)} fields', left(coalesce({name(raw[0])}, ''), 0))) as boolean)"
    sound = read.where(f"if({name(ODD)} is null or {last} is null, true, {refuse})").drop(ODD)
    return normalise_na(sound.toDF(*columns), na_tokens)


def _fields(found: DataFrame, width: int) -> DataFrame:
    """The fields of records; a record with more than ``width`` of them is refused."""
    schema = ", ".join(f"c{i} string" for i in range(width + 1))
    parsed = found.selectExpr(f"from_csv(record, '{schema}', map('escape', '\"', 'multiLine', 'true', 'maxCharsPerColumn', '-1')) as f")
    refuse = f"cast(raise_error('a row has more than {width} fields') as boolean)"
    return parsed.where(f"if(f.c{width} is null, true, {refuse})").selectExpr(*[f"f.c{i}" for i in range(width)])


def normalise_na(df: DataFrame, tokens: tuple[str, ...] = fixed.NA_TOKENS) -> DataFrame:
    """Turn missing-value tokens of text columns into null."""
    return df.selectExpr(*[
        f"if({values.among(name(f.name), tokens)}, null, {name(f.name)}) as {name(f.name)}"
        if values.is_text_type(f.dataType) else name(f.name)
        for f in df.schema.fields
    ])


def read_table(spark: SparkSession, path: str, form: str = "parquet", **options) -> DataFrame:
    """Read a typed source: parquet, orc, json, avro-like formats, or a catalogue table."""
    if form == "table":
        return spark.read.table(path)
    if form == "csv":
        return read_csv(spark, path, **options)
    return spark.read.options(**options).format(form).load(path)


def spread(df: DataFrame) -> DataFrame:
    """Share a scan out over all cores when it has fewer splits than the cluster has cores.

    Audits are bound by computing, and a small file may be a single split.  A scan with
    enough splits, as any large table has, is left alone.  ``df`` is a plain scan.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def validate_frame(df: DataFrame) -> DataFrame:
    """Refuse a table without rows or columns; strip its column names (S3)."""
    if not df.columns:
        raise IngestionError("the dataset has no columns")
    if df.isEmpty():
        raise IngestionError("the dataset has no rows")
    return df.toDF(*[c.strip() or f"unnamed_{i}" for i, c in enumerate(df.columns)])


def preview(df: DataFrame, limit: int = 10) -> DataFrame:
    """The first ``limit`` rows, 1 to 50, NaN shown as null."""
    if not 1 <= int(limit) <= 50:
        raise ValueError("a preview has 1 to 50 rows")
    shown = df.selectExpr(*[
        f"nanvl({name(f.name)}, null) as {name(f.name)}" if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else name(f.name)
        for f in df.schema.fields
    ])
    return shown.limit(int(limit))
