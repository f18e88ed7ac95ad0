"""Spectrum, basins and absorption of sparse matrices against dense ones."""

import numpy as np
import pytest

from statefield.operators import basins


def sparse(spark, t):
    return spark.createDataFrame([(i, j, float(p)) for i, row in enumerate(t) for j, p in enumerate(row) if p], "i long, j long, p double")


def chain(n=9, seed=2):
    """Two joined groups that leak a little; symmetric up to the rows' scales, so that all eigenvalues are real."""
    rng = np.random.default_rng(seed)
    t = rng.random((n, n)) * (rng.random((n, n)) < 0.8)
    t = t + t.T
    t[: n // 2, n // 2 :] *= 0.3
    t[n // 2 :, : n // 2] *= 0.3
    return t / t.sum(1, keepdims=True) * np.linspace(0.8, 0.99, n)[:, None]


def test_spectrum_equals_dense_eigenvalues(spark):
    t = chain()
    sizes = np.sort(np.abs(np.linalg.eigvals(t)))[::-1]
    got = basins.spectrum(sparse(spark, t), 30, 1e-8).first()
    assert got.first == pytest.approx(sizes[0], abs=1e-4) and got.second == pytest.approx(sizes[1], abs=1e-3)
    assert got.gap == pytest.approx(got.first - got.second) and got.leakage == pytest.approx(1 - got.first) and got.mixing == pytest.approx(-1 / np.log(got.second))
    assert basins.spectrum(sparse(spark, t).where("false"), 3).first().first is None


def test_basins_are_cut_at_the_widest_gaps(spark):
    stay = {0: 0.992, 1: 0.98, 2: 0.975, 3: 0.4, 4: 0.05, 5: 0.0, 6: 1.0}
    cells = spark.createDataFrame([(s, s, x) for s, x in stay.items() if x and s < 5], "i long, j long, p double")
    kept = lambda n: spark.createDataFrame([(s,) for s in range(n)], "s long")
    got = {r.s: r.basin for r in basins.basins(cells, kept(5)).collect()}
    assert got == {0: "core", 1: "stable", 2: "stable", 3: "bridge", 4: "escape"}
    assert {r.s: r.basin for r in basins.basins(cells, kept(2)).collect()} == {0: "core", 1: "stable"}
    whole = spark.createDataFrame([(s, s, x) for s, x in stay.items() if x], "i long, j long, p double")
    got = {r.s: (r.attractor, r.basin) for r in basins.basins(whole, kept(7)).collect()}
    assert got[6] == (None, "core") and got[5] == (0.0, "escape") and got[0][1] == "stable"
    assert basins.basins(cells, kept(0)).count() == 0


def test_absorption_solves_the_linear_equations(spark):
    t = chain(8, 5)
    goal, others = [0, 5], [1, 2, 3, 4, 6, 7]
    want = np.linalg.solve(np.eye(6) - t[np.ix_(others, others)], t[np.ix_(others, goal)].sum(1))
    kept, targets = (spark.createDataFrame([(s,) for s in x], "s long") for x in (range(8), goal))
    got = {r.s: r.reached for r in basins.absorption(sparse(spark, t), targets, kept, 40, 1e-8).collect()}
    assert got[0] == got[5] == 1.0 and np.allclose([got[s] for s in others], want, atol=1e-4)
    alone = spark.createDataFrame([(0, 0, 1.0), (1, 0, 0.5)], "i long, j long, p double")
    got = {r.s: r.reached for r in basins.absorption(alone, targets.where("s = 5"), kept.where("s < 2"), 5).collect()}
    assert got == {0: 0.0, 1: 0.0}


def test_mean_stability(spark):
    cells = spark.createDataFrame([(0, 0, 0.5), (0, 1, 0.25), (1, 0, 0.25)], "i long, j long, p double")
    got = basins.mean_stability(cells, spark.createDataFrame([(0, 30), (1, 10), (2, 0)], "s long, n long")).first()
    assert got.unweighted == pytest.approx(1 / 3) and got.weighted == pytest.approx((0.75 * 30 + 0.25 * 10) / 40)
