"""The learned models: clusters, hidden Markov model, and the chain of both."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from statefield.operators import latent


def blobs(spark, n=400):
    rng = np.random.default_rng(5)
    at = rng.integers(0, 3, n)
    x = np.array([[0, 0], [6, 0], [0, 9]])[at] + rng.normal(size=(n, 2))
    rows = [(i, float(a), float(b), True) for i, (a, b) in enumerate(x)] + [(n, None, 1.0, False)]
    return at, spark.createDataFrame(rows, "code long, a double, b double, valid boolean")


def test_kmeans_finds_the_blobs_and_leaves_invalid_rows(spark):
    at, df = blobs(spark)
    got = {r.code: r.C_t for r in latent.kmeans(df, ["a", "b"], 3, restarts=4).collect()}
    assert got.pop(400) == -1
    pairs = {(int(at[i]), c) for i, c in got.items()}
    assert len({c for _, c in pairs}) == 3 and sum(len([i for i in got if (int(at[i]), got[i]) == p]) for p in sorted(pairs, key=lambda p: -sum((int(at[i]), got[i]) == p for i in got))[:3]) > 390
    again = {r.code: r.C_t for r in latent.kmeans(df.repartition(3), ["a", "b"], 3, restarts=4).collect()}
    again.pop(400)
    assert again == got


def test_kmeans_beats_single_restarts(spark):
    _, df = blobs(spark)
    cost = lambda c: df.where("valid").select(F.array_min(F.array(*(((F.col("a") - float(x)) ** 2 + (F.col("b") - float(y)) ** 2) for x, y in c))).alias("d")).agg(F.sum("d")).first()[0]
    best = cost(latent.fit_centres(df.where("valid"), ["a", "b"], 5, 8, 1, 100, 1e-6))
    assert all(best <= cost(latent.fit_centres(df.where("valid"), ["a", "b"], 5, 1, s, 100, 1e-6)) + 1e-9 for s in (1, 2))


def test_empty_tables_give_no_clusters(spark):
    _, df = blobs(spark)
    assert latent.kmeans(df.where("false"), ["a", "b"], 3, restarts=2).count() == 0


def one_by_one(model, obs):
    """Forward-backward of a single sequence, without scaling."""
    n, k = len(obs), len(model.start)
    a, b = np.zeros((n, k)), np.ones((n, k))
    a[0] = model.start * model.emit[:, obs[0]]
    for i in range(1, n):
        a[i] = (a[i - 1] @ model.trans) * model.emit[:, obs[i]]
    for i in range(n - 2, -1, -1):
        b[i] = model.trans @ (model.emit[:, obs[i + 1]] * b[i + 1])
    p = a[-1].sum()
    moves = sum((np.outer(a[i], model.emit[:, obs[i + 1]] * b[i + 1]) * model.trans for i in range(n - 1)), np.zeros((k, k))) / p
    emits = np.zeros_like(model.emit)
    for i in range(n):
        emits[:, obs[i]] += a[i] * b[i] / p
    return np.log(p), a[0] * b[0] / p, moves, emits


def test_batched_recursion_equals_single_sequences():
    model, rng = latent.CategoricalHMM.initial(3, 4), np.random.default_rng(0)
    seqs = [rng.integers(0, 4, n) for n in (5, 1, 7, 7, 3)]
    want = [sum(x) for x in zip(*(one_by_one(model, s) for s in seqs))]
    got = [0, 0, 0, 0]
    for obs, lengths in latent._padded(seqs, 14):
        got = [x + y for x, y in zip(got, model.expected(obs, lengths))]
    assert all(np.allclose(x, y) for x, y in zip(got, want))


@pytest.mark.parametrize("n", [1, 4])
def test_viterbi_equals_enumeration(n):
    import itertools

    model, obs = latent.CategoricalHMM.initial(2, 3, 7), np.random.default_rng(n).integers(0, 3, n)
    def score(z):
        return np.log(model.start[z[0]]) + sum(np.log(model.emit[s, o]) for s, o in zip(z, obs)) + sum(np.log(model.trans[x, y]) for x, y in zip(z, z[1:]))
    assert score(model.viterbi(obs).tolist()) == pytest.approx(max(score(z) for z in itertools.product((0, 1), repeat=n)))


def test_labels_are_null_where_nothing_is_hidden(spark):
    df = spark.createDataFrame([(1, datetime.date(2020, 1, 1), 0, 3), (1, datetime.date(2020, 1, 2), -1, 3), (2, datetime.date(2020, 1, 1), 1, 30)], "code long, date date, Z_t int, state_id long")
    got = latent.apply_labels(df, latent.label_scores(df))
    assert latent.verify(got) and got.where("R_t is null").count() == 1
