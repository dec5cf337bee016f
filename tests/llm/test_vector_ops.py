from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dqspark.llm import negatives, queries, vectors, whitening

SF = "/root/testdata/sf0.001"
ODD = [(None, [0.5, 0.5, 0.5]), (9001, None), (9002, [0.1, None, 0.2]), (9003, [0.1, math.nan, 0.2]), (9004, [math.inf, 0.0, 0.0]), (9005, []), (9006, [0.25])]


def table(spark, rows, kind="float"):
    """(vec_id, embedding, label) with columns that operators add, to clash with."""
    names = f"vec_id long, embedding array<{kind}>, label int, x string, means string, rank string, deviation string, whitened string, _x string"
    return spark.createDataFrame([(*r, "c", "c", "c", "c", "c", "c") for r in rows], names)


# --- whitening --------------------------------------------------------------------------
def expected(rows, most=16):
    """{component: (eigenvalue, share)}, whitened columns and deviations by numpy's own solver and plain integers."""
    xs = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in r] for r in rows]
    fit = sorted({tuple(x) for x in xs})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[n * a - s for a, s in zip(x, sums, strict=True)] for x in fit], dtype=float) / n
    values, columns = np.linalg.eigh(centred.T @ centred / n)
    values, columns = values[::-1][:most], columns[:, ::-1][:, :most]
    every = np.array([[n * a - s for a, s in zip(x, sums, strict=True)] for x in xs], dtype=float) / n
    return n, values, every @ columns / np.sqrt(values), [sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)) for x in xs], float(np.trace(centred.T @ centred / n))


def test_whitening_equals_plain_numpy(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    n, values, whitened, deviations, trace = expected([r.embedding for r in rows])
    got = {(r.vec_id, r.component): r for r in queries.whitened_vectors(spark, SF).collect()}
    assert len(got) == 16 * len(rows)
    signs = [np.sign(got[rows[0].vec_id, c].whitened * whitened[0, c - 1]) for c in range(1, 17)]
    for i, row in enumerate(rows):
        for c in range(1, 17):
            r = got[row.vec_id, c]
            assert (r.n, r.deviation) == (n, deviations[i])
            assert r.whitened == pytest.approx(signs[c - 1] * whitened[i, c - 1], abs=1e-9)
            assert r.explained == pytest.approx(values[c - 1] / trace, rel=1e-9)
    assert max(r.identity_error for r in got.values()) < 1e-9


def test_whitening_of_repeats_odd_rows_and_low_rank(spark):
    draw = random.Random(5)
    base = [[draw.gauss(0, 1), draw.gauss(0, 0.2)] for _ in range(50)]
    rows = [(i, [a, a + b, 2.0], 1) for i, (a, b) in enumerate(base)]
    rows += [(100 + i, rows[3][1], 1) for i in range(200)] + [(*o, 1) for o in ODD]
    used = [r for r in rows if r[1] and len(r[1]) == 3 and all(c is not None and math.isfinite(c) for c in r[1])]
    given = table(spark, rows)
    model = whitening.fit(given, most=2)
    n, values, whitened, deviations, _ = expected([r[1] for r in used], 2)
    assert model.n == n <= 51 and np.allclose(model.eigenvalues, values) and model.identity_error < 1e-9
    got = whitening.transform(given, model, given.columns)
    assert got.columns == [c for c in given.columns if c not in ("deviation", "whitened")] + ["deviation", "whitened"]
    assert sorted(r.deviation for r in got.collect()) == sorted(deviations)
    key = lambda k: (k is None, k)
    found = [r.whitened for r in sorted(got.collect(), key=lambda r: key(r.vec_id))]
    want = [w for _, w in sorted(zip([r[0] for r in used], whitened.tolist(), strict=True), key=lambda p: key(p[0]))]
    assert np.allclose(np.abs(found), np.abs(want))
    full = whitening.fit(given)
    assert len(full.eigenvalues) == np.linalg.matrix_rank(np.array([[math.floor(64 * float(np.float32(c))) for c in r[1]] for r in used]) - np.array([math.floor(64 * float(np.float32(c))) for c in used[0][1]]))


@pytest.mark.parametrize("rows", [[], [(1, [0.5, 0.5], 1)], [(1, None, 1)], [(1, [], 1), (2, [], 1)], [(1, [0.5], 1), (2, [0.5], 2)]])
def test_whitening_without_variance_gives_no_rows(spark, rows):
    given = table(spark, rows)
    model = whitening.fit(given)
    assert len(model.eigenvalues) == 0 and whitening.transform(given, model, ["vec_id"]).count() == 0


def test_whitening_of_extreme_entries(spark):
    given = table(spark, [(i, [3e38 if i == 3 else float(i), -1e30 if i == 4 else 0.5 * i * i], 0) for i in range(30)])
    model = whitening.fit(given)
    rows = whitening.transform(given, model, ["vec_id"]).collect()
    assert len(rows) == 30 and all(np.isfinite(r.whitened).all() and r.deviation >= 0 for r in rows)


def test_factor_and_rotation():
    draw = np.random.default_rng(3)
    for d, rank in ((1, 1), (5, 5), (9, 4), (40, 40)):
        a = draw.normal(size=(d, rank)) * np.logspace(0, -4, rank)
        v = a @ a.T
        factor = whitening.pivoted_cholesky(v)
        assert np.allclose(factor @ factor.T, v, atol=1e-13) and factor.shape[1] <= rank + 1
        values, rows = whitening.eigen(v, rank)
        assert np.allclose(values, np.linalg.eigvalsh(v)[::-1][: len(values)], rtol=1e-8, atol=1e-15)
        assert np.allclose(rows @ rows.T, np.eye(len(rows)), atol=1e-8)


# --- hard negatives ---------------------------------------------------------------------
def mined(rows, anchors, positives=5, negatives_=10, band=(30, 90)):
    """The contract's rows by comparing all pairs; rows are (id, whole-number vector, label)."""
    out = []
    score = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    for a, x, g in rows:
        if not anchors(a):
            continue
        ranked = sorted((-score(x, y), b, h) for b, y, h in rows if b != a)
        for s, p, _ in [r for r in ranked if r[2] == g][:positives]:
            fits = [(t, b) for t, b, h in ranked if h != g and band[0] * -s <= 100 * -t <= band[1] * -s]
            out += [(a, p, i + 1, b, -s, -t) for i, (t, b) in enumerate(fits[:negatives_])]
    return sorted(out)


def test_negatives_equal_brute_force(spark):
    draw = random.Random(6)
    centre = [[draw.gauss(0, 40) for _ in range(20)] for _ in range(4)]
    rows = [(i, [math.floor(c + draw.gauss(0, 25)) for c in centre[i % 4]], draw.randrange(3)) for i in range(240)]
    rows += [(300 + i, rows[7][1], i % 3) for i in range(60)]  # ties
    given = table(spark, rows, "long").repartition(5)
    for block in (7, 2048):
        got = sorted(tuple(r) for r in negatives.mine(given, lambda k: k % 10 == 0, block=block).collect())
        assert got == mined(rows, lambda k: k % 10 == 0)
    assert len({r[0] for r in got}) > 20


def test_bounds_hold_and_prune():
    draw = np.random.default_rng(8)
    centres = draw.normal(0, 300, (12, 64)).cumsum(axis=1)  # smooth vectors: short segments are nearly flat
    x = np.floor(centres[draw.integers(0, 12, 200)] + draw.normal(0, 3, (200, 64))).astype(np.int64)
    tile = negatives.Tile(np.arange(200), np.zeros(200), x, *negatives.summaries(x))
    exact = x @ x.T
    for am, ad in tile.levels:
        assert (am @ am.T + ad @ ad.T >= exact - 1e-3).all() and (am @ am.T - ad @ ad.T <= exact + 1e-3).all()
    floor = np.sort(exact, axis=1)[:, -5]
    columns, mask = negatives.survivors(tile, tile, np.ones((200, 200), bool), floor, np.full(200, negatives.HIGH))
    full = np.zeros((200, 200), bool)
    full[:, columns] = mask
    assert full[exact >= floor[:, None]].all() and full.mean() < 0.5


def test_negatives_of_odd_rows(spark):
    rows = [(i, [float(i % 5), 1.0, 2.0], i % 2) for i in range(20)] + [(*o, 0) for o in ODD if o[0] != 9005] + [(500, [1.0, 1.0, 1.0], None), (0, [9.0, 9.0, 9.0], 1), (0, [9.0, 9.0, 9.0], 1)]
    given = table(spark, rows).where(vectors.usable("embedding")).withColumn("embedding", vectors.whole("embedding", 1))
    got = sorted(tuple(r) for r in negatives.mine(given, lambda k: k % 10 == 0).collect())
    assert got == mined([(i, [i % 5, 1, 2], i % 2) for i in range(20)], lambda k: k % 10 == 0)
    assert negatives.mine(given.limit(0), lambda k: k % 10 == 0).count() == 0
    assert negatives.mine(given, lambda k: k < -1).count() == 0
    assert negatives.mine(given.where("label = 0"), lambda k: k % 10 == 0).count() == 0
    assert negatives.mine(given.withColumn("embedding", F.array().cast("array<long>")), lambda k: k % 10 == 0).count() > 0
