"""CSV records that run over several lines, read by many tasks.

A line starts either a record or inside a quoted field, and a split of a file does too.  One
pass finds for every split how it ends for each of the two ways it may start; composing
these along a file tells how each split starts.  A second pass puts the lines of records
together.  What a split holds of a record that began before it, or goes on after it, is put
together from these few pieces afterwards.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import pin, small_side

#: Up to the quote that closes a field; a doubled quote does not.
CLOSING = re.compile(r'[^"]*+(?:""[^"]*+)*+"')
#: Encodings in which a line feed is one byte that stands for nothing else.
BYTE_ENCODINGS = ("UTF-8", "ISO-8859-1", "US-ASCII", "WINDOWS-1252")


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a line ends inside a quoted field, given whether it starts in one.

    A field is quoted if its first character is a quote.  Text after a closing quote belongs to
    the field, unquoted.
    """
    if '"' not in line:
        return inside
    at = 0
    while True:
        if inside:
            closed = CLOSING.match(line, at)
            if not closed:
                return True
            at, inside = closed.end(), False
        elif line.startswith('"', at):
            at, inside = at + 1, True
            continue
        at = line.find(",", at)
        if at < 0:
            return False
        at += 1


def lines_of(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """(file, block, line): the lines of each split of each file, in order within a split."""
    text = "value" if encoding == "UTF-8" else f"decode(cast(value as binary), '{encoding}')"
    read = spark.read.option("lineSep", "\n").text(path)
    return read.selectExpr("_metadata.file_path as file", "_metadata.file_block_start as block", f"{text} as line")


def by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list]]:
    """((file, block), rest of the columns) of each run of rows of one split; a long split comes in several runs."""
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        first = 0
        for i in range(1, batch.num_rows + 1):
            if i == batch.num_rows or (columns[0][i], columns[1][i]) != (columns[0][first], columns[1][first]):
                yield (columns[0][first], columns[1][first]), [c[first:i] for c in columns[2:]]
                first = i


def split_starts(lines: DataFrame) -> DataFrame:
    """(file, block, inside): whether a split starts inside a quoted field.  One row per split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends: dict[tuple, list] = {}
        for split, (texts,) in by_split(batches):
            state = ends.setdefault(split, [False, True])
            for line in texts:
                if '"' in line:
                    out, in_ = ends_inside(line, state[0]), ends_inside(line, state[1]) if state[1] != state[0] else None
                    state[:] = [out, out if in_ is None else in_]
        yield pa.RecordBatch.from_arrays(
            [pa.array([s[i] for s in ends], k) for i, k in enumerate((pa.string(), pa.int64()))] + [pa.array([e[i] for e in ends.values()], pa.bool_()) for i in range(2)],
            names=["file", "block", "from_out", "from_in"],
        )

    found = lines.mapInArrow(run, "file string, block long, from_out boolean, from_in boolean")
    along = F.aggregate(
        F.array_sort(F.collect_list(F.struct("block", "from_out", "from_in"))),
        F.expr("named_struct('now', false, 'starts', cast(array() as array<struct<block: bigint, inside: boolean>>))"),
        lambda done, split: F.struct(
            F.when(done.now, split.from_in).otherwise(split.from_out).alias("now"),
            F.concat(done.starts, F.array(F.struct(split.block.alias("block"), done.now.alias("inside")))).alias("starts"),
        ),
    )
    return found.groupBy("file").agg(along.alias("along")).select("file", F.explode("along.starts").alias("start")).select("file", "start.*")


def records(spark: SparkSession, path: str, encoding: str, header: str) -> DataFrame:
    """(record): the records of the files of ``path``, without their header line, which must be ``header`` in each.

    Records hold the line feeds of their fields, as single characters where the first line ends
    with two; empty lines between records are skipped.
    The last record of a file may lack its closing quote.
    """
    lines = lines_of(spark, path, encoding)
    seen = lines.select("line").first()
    crlf = seen is not None and seen["line"].endswith("\r")
    starts = small_side(pin(split_starts(lines)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, held, inside, begun, sequence, out = None, [], False, True, 0, []

        def made() -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["file", "block", "kind", "record"])

        def close(kind: int | None) -> None:
            # 0: a whole record, 1: the rest of one that began before, 2: the start of one that goes on, 3: part of one that does both
            if held or kind in (1, 3):
                text = "\n".join(held)
                if kind != 0 or text:
                    out.append((*split, kind, text))
            held.clear()

        for now, (texts, started) in by_split(batches):
            if now != split:
                if split is not None and inside:
                    close(2 if begun else 3)
                split, inside = now, started[0]
                begun = not inside
                held.clear()
                skip = now[1] == 0
            for line in texts:
                line = line.removesuffix("\r") if crlf else line
                if skip:
                    skip = False
                    if line.lstrip("﻿") != header:
                        raise ValueError(f"a file has another header than the first one: {now[0]}")
                    continue
                held.append(line)
                inside = ends_inside(line, inside)
                if not inside:
                    close(0 if begun else 1)
                    begun = True
            if len(out) > 2000:
                yield made()
                out = []
        if split is not None and inside:
            close(2 if begun else 3)
        yield made()

    joined = lines.join(starts, ["file", "block"]).select("file", "block", "line", "inside")
    found = joined.mapInArrow(run, "file string, block long, kind int, record string")
    whole = found.where("kind = 0").select("record")
    # a start opens a group; rests and parts follow it in the order of the splits
    loose = found.where("kind <> 0").selectExpr("*", "sum(if(kind = 2, 1, 0)) over (partition by file order by block, if(kind = 2, 1, 0)) as nth")
    together = loose.groupBy("file", "nth").agg(F.array_sort(F.collect_list(F.struct("block", F.when(F.col("kind") == 2, 1).otherwise(0).alias("late"), "record"))).alias("parts"))
    return whole.unionByName(together.select(F.array_join(F.transform("parts", lambda p: p.record), "\n").alias("record")))
