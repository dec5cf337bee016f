"""What an audit keeps of a table, in a form that adds up.

A table is observed in four passes: measures of the cells, value frequencies, row digests,
and counts of the row checks and rules.  States of parts of a table merge into the state of
the whole, so an append-only table is audited again by reading its new part only.

    kept = observe(first_part, ...)
    kept.save("…/state")
    whole = merge(load(spark, "…/state", ...), observe(new_part, ...))
    result = conclude(whole)
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..functions.values import among, name
from ..operators import detect
from ..operators.cells import DIGEST_ABOVE, Layout, aggregate, frequencies
from ..operators.duplicates import copies
from ..operators.profile import DEFAULT, Counted, Options, count_cells, measure_values
from ..operators.quantiles import merged_sketches
from ..operators.rules import Rule, rule_predicates, validate_rule
from ..session import pin, prepare, together

# Measures that are the largest or smallest of the parts; the means and deviation are put
# together from the parts' own; all others are sums.
LEAST = ("num_min", "ts_min", "len_min")
MOST = ("num_max", "ts_max", "len_max")
MEANS = ("num_mean", "num_std", "len_mean")


class StateError(ValueError):
    """States that do not describe parts of one table under one set of checks."""


@dataclass(frozen=True)
class State:
    """The four tables of an observation and what they were made with."""

    layout: Layout
    rules: tuple[Rule, ...]
    expectations: detect.Expectations
    options: Options
    counted: Counted
    rows: DataFrame
    checks: DataFrame
    df: DataFrame | None = None

    @property
    def by(self) -> list[str]:
        return list(self.layout.by)

    def predicates(self) -> list[str]:
        return check_predicates(self.layout, list(self.rules), self.expectations, self.options)

    def signature(self) -> str:
        """Names what has to be equal in states that merge: columns, types, options and checks."""
        columns = [[c, self.layout.types[c].simpleString()] for c in (*self.layout.by, *self.layout.columns)]
        told = [len(self.layout.by), columns, self.options.__dict__, self.predicates(), [r.__dict__ for r in self.rules], self.expectations.__dict__]
        return hashlib.sha256(json.dumps(told, sort_keys=True, default=str).encode()).hexdigest()

    def save(self, folder: str) -> None:
        """Write the state; a folder that is there already is refused."""
        spark = self.checks.sparkSession
        for part, table in (("measures", self.counted.measures), ("values", self.counted.values), ("rows", self.rows), ("checks", self.checks)):
            table.write.parquet(f"{folder}/{part}")
        facts = [(self.signature(), ",".join(str(self.layout.ordinal(c)) for c in self.counted.padded))]
        spark.createDataFrame(facts, "signature string, padded string").coalesce(1).write.parquet(f"{folder}/facts")  # last: marks a whole state


def check_predicates(layout: Layout, rules: list[Rule], expect: detect.Expectations, options: Options) -> list[str]:
    """Row predicates counted in one pass: the row checks, then one for each rule."""
    return [c.predicate for c in detect.row_checks(layout, expect, options)] + rule_predicates(rules, layout, options)


def observe(
    df: DataFrame, rules: list[Rule] | None = None, expectations: detect.Expectations | None = None, by: list[str] | None = None,
    options: Options = DEFAULT, keep: bool = True,
) -> State:
    """Read a table four times, whatever the number of its columns, rules and slices.

    Without ``keep`` the row digests are not written, for a state that is concluded once.
    """
    prepare(df.sparkSession)
    layout, expect = Layout.of(df, by or []), expectations or detect.Expectations()
    rules = [validate_rule(r) for r in rules or []]
    predicates, digests = check_predicates(layout, rules, expect, options), copies(df, layout)
    counted, checks, rows = together(
        df.sparkSession,
        lambda: count_cells(df, layout, options),
        lambda: pin(detect.count_rows(df, layout, predicates)) if predicates else None,
        lambda: pin(digests) if keep else digests,
    )
    if checks is None:
        checks = aggregate(counted.measures, list(layout.by), row_count="max(row_count)")
    return State(layout, tuple(rules), expect, options, counted, rows, checks, df)


def load(
    spark: SparkSession, folder: str, schema: T.StructType, rules: list[Rule] | None = None, expectations: detect.Expectations | None = None,
    by: list[str] | None = None, options: Options = DEFAULT,
) -> State:
    """Read a saved state of a table of this ``schema``; other columns or checks than it was saved with are refused."""
    prepare(spark)
    layout = Layout.of(spark.createDataFrame([], schema), by or [])
    read = lambda part: spark.read.parquet(f"{folder}/{part}")
    facts = read("facts").first()
    padded = tuple(layout.columns[int(i)] for i in facts["padded"].split(",") if i)
    counted = Counted(read("measures"), read("values"), padded, layout.columns)
    state = State(layout, tuple(validate_rule(r) for r in rules or []), expectations or detect.Expectations(), options, counted, read("rows"), read("checks"))
    if state.signature() != facts["signature"]:
        raise StateError("the state was saved for other columns, options or checks")
    return state


def merge_measures(parts: DataFrame, layout: Layout) -> DataFrame:
    """Measures of the whole from those of its parts, one row per slice and column."""
    keys = [*layout.by, "ord"]
    over = f"over (partition by {', '.join(name(k) for k in keys)})"
    centred = parts.selectExpr("*", f"sum(numbers * num_mean) {over} / nullif(sum(numbers) {over}, 0) as whole_mean")
    sums = {c: f"sum({c})" for c in parts.columns if c not in (*keys, *LEAST, *MOST, *MEANS)}
    sums |= {c: merged_sketches(c) for c in parts.columns if c.endswith("_sketch")}
    ends = {c: f"min({c})" for c in LEAST} | {c: f"max({c})" for c in MOST}
    shift = "(num_mean - whole_mean)"
    means = {
        "num_mean": "max(whole_mean)",
        "num_std": f"sqrt(sum(numbers * (num_std * num_std + {shift} * {shift})) / nullif(sum(numbers), 0))",
        "len_mean": "cast(sum(round(non_null * len_mean)) as double) / nullif(sum(non_null), 0)",
    }
    return aggregate(centred, keys, **{c: (sums | ends | means)[c] for c in parts.columns if c not in keys})


def merge(*states: State) -> State:
    """The state of all parts together.  Every part must have the same columns, options and checks.

    Dates are compared with one moment, so ``as_of`` has to be given.  Sketched distinct
    counts do not add up and are refused.
    """
    first = states[0]
    if len({s.signature() for s in states}) > 1:
        raise StateError("states of different columns, options or checks do not merge")
    if first.options.as_of is None or first.options.approximate_distinct:
        raise StateError("states merge with a fixed as_of and exact distinct counts only")
    layout = first.layout
    keys = list(layout.by)
    together = lambda get: reduce(DataFrame.unionByName, [get(s) for s in states])
    measures = pin(merge_measures(together(lambda s: s.counted.measures), layout))
    values = pin(aggregate(together(lambda s: s.counted.values), [*keys, "ord", "value", "spelling"], n="sum(n)"))
    rows = aggregate(together(lambda s: s.rows), [*keys, "digest"], copies="sum(copies)")
    counts = together(lambda s: s.checks)
    checks = pin(aggregate(counts, keys, **{c: f"sum({c})" for c in counts.columns if c not in keys}))
    padded = tuple(c for c in layout.columns if any(c in s.counted.padded for s in states))
    return replace(first, counted=Counted(measures, values, padded, layout.columns), rows=rows, checks=checks, df=None)


def revise(state: State, result: DataFrame, touched: list[str], removed: DataFrame | None) -> State:
    """The state of a table after some of its columns changed and some of its rows went.

    Only ``touched`` columns are measured anew.  The frequencies of the others lose those of
    the ``removed`` rows (which hold these columns), and their measures are taken from what is
    left.  Columns that hold values over 256 characters, known by digest only, count as
    touched where rows went.  Row digests and checks are counted on the result.
    """
    options, rules, expect = state.options, list(state.rules), state.expectations
    if state.by or options.approximate_distinct or options.quantiles != "exact":
        return observe(result, rules, expect, state.by, options, keep=False)
    layout = Layout.of(result)
    long = []
    if removed is not None:
        long = [state.layout.columns[r[0]] for r in state.counted.measures.where(f"len_max > {DIGEST_ABOVE}").select("ord").collect()]
    fresh = [c for c in layout.columns if c in touched or c in long]
    rest = [c for c in layout.columns if c not in fresh]
    at = {c: layout.ordinal(c) for c in rest}
    # columns stay in place: cleaning adds and drops none
    chosen = among("ord", list(at.values()))
    predicates, digests = check_predicates(layout, rules, expect, options), copies(result, layout)
    parts = [lambda: pin(detect.count_rows(result, layout, predicates)) if predicates else None]
    parts += [lambda: count_cells(result, layout, options, only=fresh)] if fresh else []
    checks, *found = together(result.sparkSession, *parts)
    measures, values = [], []
    if rest:
        kept, known = state.counted.values.where(chosen), state.counted.measures.where(chosen)
        if removed is not None:
            gone = frequencies(removed, Layout.of(state.df if state.df is not None else result, columns=list(state.layout.columns)), rest).selectExpr("* except (n)", "-n as n")
            kept = aggregate(kept.unionByName(gone.select(kept.columns)), ["ord", "value", "spelling"], n="sum(n)").where("n > 0")
            kept, fewer = together(result.sparkSession, lambda: pin(kept), removed.count)
            centred = known.selectExpr("ord", f"row_count - {fewer}L as row_count", "coalesce(num_mean, 0D) as centre")
            known = measure_values(kept, layout, pin(centred), options)
        measures.append(known)
        values.append(kept)
    if found:
        measures.append(found[0].measures)
        values.append(found[0].values)
    whole = pin(reduce(DataFrame.unionByName, measures))
    padded = tuple(layout.columns[r[0]] for r in whole.where("padded > 0").select("ord").collect())
    counted = Counted(whole, pin(reduce(DataFrame.unionByName, values)), padded, layout.columns)
    if checks is None:
        checks = aggregate(whole, [], row_count="max(row_count)")
    return State(layout, state.rules, expect, options, counted, digests, checks, result)
