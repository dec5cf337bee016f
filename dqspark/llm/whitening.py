"""Whitening of embeddings: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the factor.

Entries become whole numbers, so counts, sums and the scatter are exact however the rows
are spread.  Each vector counts once in the fit.  Only numbers that depend on the
dimensions, not on the rows, come to the driver; there the scatter is factored with
pivoting, and the columns of the triangular factor are rotated until they are orthogonal:
their squared lengths are the eigenvalues, their directions the components.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import field, pin
from .vectors import common_length, matrix, usable, whole

#: Entries become floor(SCALE * entry) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Components kept at most.
COMPONENTS = 16
#: Rows that a task computes on at once.
ROWS = 2048
EPS = float(np.finfo(float).eps)


@dataclass(frozen=True)
class Whitening:
    """A fitted model; ``components`` has one row per component, ``sums`` the exact sums of the fit list."""

    n: int
    sums: tuple[int, ...]
    eigenvalues: np.ndarray
    components: np.ndarray
    explained: np.ndarray
    identity_error: float

    @property
    def length(self) -> int:
        return len(self.sums)

    @property
    def centre(self) -> np.ndarray:
        """The whole numbers nearest to the means."""
        return np.array([round_div(s, self.n) for s in self.sums], dtype=np.int64)

    @property
    def rest(self) -> np.ndarray:
        """What the means have beyond the centre."""
        return np.array([(s - self.n * int(c)) / self.n for s, c in zip(self.sums, self.centre, strict=True)])


def round_div(a: int, n: int) -> int:
    return (2 * a + n) // (2 * n)


def pivoted_cholesky(v: np.ndarray) -> np.ndarray:
    """L with L Lᵀ = v, a column per pivot; rows stay in place, so L is triangular in the order of the pivots.

    Every pivot is the largest variance left; at rounding level the rest counts as zero.
    """
    d = len(v)
    left, factor, open_ = v.diagonal().copy(), np.zeros((d, d)), np.ones(d, dtype=bool)
    least = d * EPS * max(left.max(initial=0.0), 0.0)
    for k in range(d):
        p = int(np.argmax(np.where(open_, left, -np.inf)))
        if left[p] <= least:
            return factor[:, :k]
        column = (v[:, p] - factor[:, :k] @ factor[p, :k]) / np.sqrt(left[p])
        open_[p] = False
        factor[:, k] = np.where(open_, column, 0.0)
        factor[p, k] = np.sqrt(left[p])
        left = left - factor[:, k] ** 2
    return factor


def orthogonal_columns(factor: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """One-sided Jacobi: pairs of columns are rotated until all are orthogonal to working precision.

    A round takes disjoint pairs at once; as many rounds as columns less one meet every pair.
    """
    g = np.hstack([factor, np.zeros((len(factor), factor.shape[1] % 2))])
    r = g.shape[1]
    if r < 2:
        return factor
    order, half = np.arange(r), r // 2
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(r - 1):
            p, q = order[:half], order[half:][::-1]
            a, b = g[:, p], g[:, q]
            aa, bb, ab = (a * a).sum(0), (b * b).sum(0), (a * b).sum(0)
            size = np.sqrt(aa * bb)
            off = np.divide(np.abs(ab), size, out=np.zeros_like(ab), where=size > 0)
            worst = max(worst, float(off.max()))
            turn = off > EPS
            zeta = np.divide(bb - aa, 2 * ab, out=np.zeros_like(ab), where=turn)
            t = np.where(turn, np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta)), 0.0)
            c = 1 / np.hypot(1.0, t)
            g[:, p], g[:, q] = c * (a - t * b), c * (t * a + b)
            order[1:] = np.roll(order[1:], 1)
        if worst <= 4 * len(factor) * EPS:
            break
    return g[:, : factor.shape[1]]


def eigen(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of a covariance, falling, and their unit vectors as rows; the largest entry of each is positive."""
    turned = orthogonal_columns(pivoted_cholesky(v))
    values = (turned**2).sum(0)
    first = np.argsort(-values, kind="stable")[:most]
    rows = (turned[:, first] / np.sqrt(values[first])).T
    signs = np.sign(rows[np.arange(len(rows)), np.argmax(np.abs(rows), axis=1)])
    return values[first], rows * signs[:, None]


def products(y: np.ndarray) -> list[list[int]]:
    """yᵀ y, exact."""
    top = int(np.abs(y).max(initial=0))
    if top * top * max(1, len(y)) < 1 << 53:
        made = y.astype(np.float64)
        return (made.T @ made).astype(np.int64).tolist()
    return (y.astype(object).T @ y.astype(object)).tolist()


def summed(df: DataFrame, partial, schema: str, by: list[str]) -> list:
    """Partial rows of each task, summed by ``by``; ``partial`` turns an iterator of record batches into lists of columns."""
    arrow = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = partial(batches)
        if columns:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    made = df.mapInArrow(run, schema)
    return made.groupBy(*by).agg(*[F.sum(c).alias(c) for c in made.columns if c not in by]).collect()


def counts(xs: DataFrame, d: int) -> tuple[int, tuple[int, ...]]:
    """Number of vectors and exact sums of each dimension."""

    def partial(batches):
        n, total = 0, [0] * d
        for batch in batches:
            x = matrix(batch.column(0), d)
            n += len(x)
            for at in range(0, len(x), ROWS):  # ROWS entries below 2**41 stay far from overflow
                total = [t + s for t, s in zip(total, x[at : at + ROWS].sum(axis=0).tolist(), strict=True)]
        return n and [list(range(d)), [n] * d, [Decimal(t) for t in total]]

    rows = {r.i: r for r in summed(xs, partial, "i int, n long, s decimal(38,0)", ["i"])}
    return (rows[0].n, tuple(int(rows[i].s) for i in range(d))) if rows else (0, (0,) * d)


def covariance(xs: DataFrame, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """The covariance, divisor n.

    Vectors are centred on the whole numbers nearest to the means, multiplied and summed
    exactly; what the means have beyond these numbers is then taken off exactly too.
    """
    d, middle = len(sums), [round_div(s, n) for s in sums]

    def partial(batches):
        total, seen = None, False
        for batch in batches:
            x = matrix(batch.column(0), d) - np.array(middle, dtype=np.int64)
            for at in range(0, len(x), ROWS):
                part, seen = products(x[at : at + ROWS]), True
                total = part if total is None else [[a + b for a, b in zip(p, q, strict=True)] for p, q in zip(total, part, strict=True)]
        pairs = [(i, j) for i in range(d) for j in range(i, d)] if seen else []
        return pairs and [[i for i, _ in pairs], [j for _, j in pairs], [Decimal(total[i][j]) for i, j in pairs]]

    rest, v = [s - n * m for s, m in zip(sums, middle, strict=True)], np.zeros((d, d))
    for r in summed(xs, partial, "i int, j int, s decimal(38,0)", ["i", "j"]):
        v[r.i, r.j] = v[r.j, r.i] = (n * int(r.s) - rest[r.i] * rest[r.j]) / (n * n)
    return v


def projected(x: np.ndarray, model: Whitening) -> np.ndarray:
    return ((x - model.centre) - model.rest) @ (model.components / np.sqrt(model.eigenvalues)[:, None]).T


def measured_error(xs: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the covariance of the whitened fit list minus the identity."""
    d, k = model.length, len(model.eigenvalues)

    def partial(batches):
        one, two, seen = np.zeros(k), np.zeros((k, k)), False
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                w, seen = projected(matrix(batch.column(0).slice(at, ROWS), d), model), True
                one, two = one + w.sum(0), two + w.T @ w
        index = [(i, j) for i in range(k) for j in range(k)] if seen else []
        return index and [[i for i, _ in index], [j for _, j in index], [one[i] for i, _ in index], [one[j] for _, j in index], [two[i, j] for i, j in index]]

    rows = summed(xs, partial, "i int, j int, a double, b double, s double", ["i", "j"])
    return max((abs(r.s / model.n - r.a / model.n * (r.b / model.n) - (r.i == r.j)) for r in rows), default=0.0)


def vectors(df: DataFrame, vector: str) -> DataFrame:
    """``df`` with the whole-number vectors ``_x`` of its usable rows."""
    return df.where(usable(vector)).withColumn("_x", whole(vector, SCALE, SHIFT))


def fit(df: DataFrame, vector: str = "embedding", most: int = COMPONENTS) -> Whitening:
    """The whitening of all different vectors of ``df``.

    Rows with a null vector, or a null or non-finite entry, take no part; nor do vectors of
    another length than most have (the shorter on ties).  Repeated vectors count once.
    There are as many components as the covariance has rank, ``most`` at most: none for an
    empty table, for a single vector, or for vectors of no entries.
    """
    given = vectors(df.select(vector), vector).select("_x")
    d = common_length(given, "_x")
    none = Whitening(0, (), np.zeros(0), np.zeros((0, 0)), np.zeros(0), 0.0)
    if not d:
        return none
    xs = pin(given.where(F.size("_x") == d).distinct())
    n, sums = counts(xs, d)
    v = covariance(xs, n, sums)
    values, components = eigen(v, most)
    model = Whitening(n, sums, values, components, values / max(v.trace(), np.finfo(float).tiny), 0.0)
    return Whitening(n, sums, values, components, model.explained, measured_error(xs, model) if len(values) else 0.0)


def deviations(x: np.ndarray, model: Whitening) -> list[int]:
    """Sum over dimensions of (n x - S)², exact; beyond a long it counts as the largest long."""
    y, rest = x - model.centre, np.array([s - model.n * int(c) for s, c in zip(model.sums, model.centre, strict=True)], dtype=object)
    top = model.n * (int(np.abs(y).max(initial=0)) + 1)
    if top * top * model.length < 1 << 62:
        return ((model.n * y - rest.astype(np.int64)) ** 2).sum(axis=1).tolist()
    return [min(v, (1 << 63) - 1) for v in ((model.n * y.astype(object) - rest) ** 2).sum(axis=1).tolist()]


def transform(df: DataFrame, model: Whitening, keeps: list[str], vector: str = "embedding") -> DataFrame:
    """Columns ``keeps`` of the rows that can take part, with ``deviation`` (a long) and ``whitened`` (an array of doubles).

    Every such row comes out, repeated ones as often as they came in, also with a null key;
    a model without components gives no rows.  New columns replace kept ones of the same name.
    """
    kept = [c for c in keeps if c not in ("deviation", "whitened")]
    given = vectors(df.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(kept)], F.col(vector).alias("_vector")), "_vector")
    given = given.where((F.size("_x") == model.length) & F.lit(len(model.eigenvalues) > 0)).drop("_vector")
    schema = given.drop("_x").schema.add(field("deviation", "long")).add(field("whitened", "array<double>"))
    names, d, k = schema.names, model.length, len(model.eigenvalues)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x = matrix(part.column(part.num_columns - 1), d)
                ends = pa.array(np.arange(0, (len(x) + 1) * k, k, dtype=np.int32))
                lists = pa.ListArray.from_arrays(ends, pa.array(projected(x, model).ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(deviations(x, model), pa.int64()), lists], names=names)

    return given.mapInArrow(run, schema).select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(kept)], "deviation", "whitened")
