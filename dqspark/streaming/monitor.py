"""Continuous rule checks of an append-only table (T-1, T-2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.values import lit, name
from ..operators.cells import Layout
from ..operators.profile import DEFAULT, Options
from ..operators.rules import Rule, RuleError, execute_rules, predicate, validate_rule, violations

BATCH_ONLY = ("unique", "duplicate_rows", "missing_threshold")


def row_rules(rules: list[Rule]) -> list[Rule]:
    """Refuse rules that need the whole table: a stream never has it."""
    for rule in rules:
        validate_rule(rule)
        if rule.rule_type in BATCH_ONLY:
            raise RuleError(f"{rule.rule_type} needs the whole table; run it as a batch audit")
    return rules


def watch_rules(
    stream: DataFrame, rules: list[Rule], out: str, checkpoint: str, options: Options = DEFAULT, available_now: bool = True,
    key: list[str] | None = None, violations_out: str | None = None,
) -> StreamingQuery:
    """Check each micro-batch and write its rule counts to ``out/batch_id=N`` (T-1).

    With ``key`` and ``violations_out`` the rows that break a rule are written as well, as
    (key..., rule_id), below ``violations_out/batch_id=N``.

    A batch that is run again after a failure overwrites its own folder, so counts are
    exact.  No state is kept between batches.
    """
    row_rules(rules)

    def check(batch: DataFrame, number: int) -> None:
        execute_rules(batch, rules, options=options).write.mode("overwrite").parquet(f"{out}/batch_id={int(number)}")
        if violations_out is not None:
            violations(batch, rules, key or [], options).write.mode("overwrite").parquet(f"{violations_out}/batch_id={int(number)}")

    writer = stream.writeStream.foreachBatch(check).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def total_counts(batches: DataFrame) -> DataFrame:
    """Rule totals over all batches written by ``watch_rules``."""
    return batches.groupBy("rule_id").agg(F.sum("affected_rows").alias("affected_rows"))


def windowed_failures(
    stream: DataFrame, rules: list[Rule], time_column: str, window: str = "1 day", late: str = "1 hour",
    options: Options = DEFAULT,
) -> DataFrame:
    """Rows checked and failed per rule and event-time window (T-2).

    Works on streams and on tables.  On a stream, rows later than the watermark are left
    out of the windows (``watch_rules`` still counts them).
    """
    layout = Layout.of(stream)
    tests = [(rule, predicate(rule, layout.types, options)) for rule in row_rules(rules)]
    marks = ", ".join(f"struct({rule.id}L as rule_id, coalesce({test}, false) as failed)" for rule, test in tests)
    checked = stream.selectExpr(f"cast({name(time_column)} as timestamp) as event_time", f"inline(array({marks}))")
    if stream.isStreaming:
        checked = checked.withWatermark("event_time", late)
    grouped = checked.groupBy(F.window("event_time", window), "rule_id").agg(
        F.count(F.lit(1)).alias("rows"), F.expr("count_if(failed) as failed_rows")
    )
    return grouped.selectExpr(
        "window.start as window_start", "rule_id", "rows", "failed_rows", "failed_rows / cast(rows as double) as failure_rate"
    )


def write_windows(windows: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append finished windows to Parquet."""
    writer = windows.writeStream.outputMode("append").format("parquet").option("path", out)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def open_windows(
    df: DataFrame, rules: list[Rule], time_column: str, written: DataFrame, window: str = "1 day", options: Options = DEFAULT
) -> DataFrame:
    """The windows a bounded stream left open, counted from its table (T-2).

    A stream writes a window once the watermark has passed its end, so the last ones of a
    run that has ended are still held back.  ``written`` is what the stream wrote.
    """
    last = written.agg(F.max("window_start")).first()[0]
    rest = df if last is None else df.where(F.col(time_column) >= F.lit(last) + F.expr(f"interval {window}"))
    return windowed_failures(rest, rules, time_column, window, options=options)
