"""Mixtures against densities worked out row by row."""

import numpy as np
import pytest

from statefield.operators import mixture


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.multivariate_normal(m, c, n) for m, c, n in (([0, 0], [[1, 0.8], [0.8, 1]], 300), ([6, 1], [[1, -0.5], [-0.5, 2]], 200))])
    return x, spark.createDataFrame([*((float(a), float(b)) for a, b in x), (None, 1.0), (float("nan"), 0.0)], "a double, b double").cache()


def by_hand(x, model):
    d = np.stack([w * np.exp(-0.5 * np.einsum("ni,ij,nj->n", x - m, np.linalg.inv(c), x - m)) / (2 * np.pi * np.sqrt(np.linalg.det(c))) for w, m, c in zip(model.weights, model.means, model.covariances)], 1)
    return d / d.sum(1, keepdims=True), np.log(d.sum(1)).sum()


def test_a_step_equals_one_by_hand(cloud):
    x, df = cloud
    model = mixture.Mixture(np.array([0.6, 0.4]), np.array([[1.0, 0.0], [4.0, 1.0]]), np.array([np.eye(2), [[2, 0.3], [0.3, 1]]]))
    g, ll = by_hand(x, model)
    after, before = mixture.next_mixture(df, ["a", "b"], model, 0.0)
    assert before == pytest.approx(ll / 500) and np.allclose(after.weights, g.mean(0)) and np.allclose(after.means, g.T @ x / g.sum(0)[:, None])
    for i in range(2):
        y = x - after.means[i]
        assert np.allclose(after.covariances[i], (g[:, i, None] * y).T @ y / g[:, i].sum())


def test_likelihood_never_falls_and_the_parts_are_found(cloud):
    x, df = cloud
    model, seen = mixture.fit_mixture(df, ["a", "b"], 2, iterations=12)
    assert all(b >= a - 1e-9 for a, b in zip(seen, seen[1:])) and len(seen) > 2
    assert sorted(np.round(model.means[:, 0]).tolist()) == [0, 6] and sorted(np.round(model.weights, 1).tolist()) == [0.4, 0.6]
    found = mixture.mixture_regimes(df, ["a", "b"], 2, iterations=5)
    assert found.count() == 500 and sorted(r["count"] for r in found.groupBy("regime").count().collect())[0] in range(190, 211)
    assert mixture.mixture_regimes(df.where("false"), ["a", "b"], 2, iterations=2).count() == 0
