"""What the findings of round 4 were about."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from statefield.config import TABLES
from statefield.operators import folds, latent, macro, states, strategy

P = replace(TABLES, min_visits=3, folds=(1999,))


@pytest.fixture(scope="module")
def alike(spark):
    """Returns of two states: of the first equal but for their last bits, of the second they vary."""
    values = [(1, "TREND", x) for x in (0.1 + 0.2, 0.3, 0.3, 0.1 + 0.2, 0.3)] + [(2, "TREND", x) for x in (0.5, 0.7, 0.6, 0.4)]
    rows = [(s, r, x, f"{1996 + i % 3}-03-0{1 + i}") for i, (s, r, x) in enumerate(values)]
    return spark.createDataFrame(rows, "state_id long, regime string, ret double, date string").withColumn("date", F.to_date("date")).coalesce(1).localCheckpoint()


def test_returns_equal_but_for_their_last_bits_have_no_deviation(spark, alike):
    limits = alike.select("date").distinct().select("date", F.lit(None).cast("date").alias("next_0"), F.lit(None).cast("date").alias("until_0"))
    found = [
        strategy.identify(alike, "ret", P),
        strategy.identify_before(alike, "ret", strategy.folds(spark, P), P),
        folds.identify_purged(alike.withColumn("exit_date", F.col("date")), "ret", limits, 1, P),
    ]
    for stats in found:
        by = {x.state_id: x for x in stats.collect()}
        assert by[1].sigma_r == 0 and by[1].t_stat is None and not by[1].tradeable
        assert np.isclose(by[2].sigma_r, np.std([0.5, 0.7, 0.6, 0.4], ddof=1), rtol=1e-12) and by[2].tradeable
    stats = states.state_stats(alike.select("state_id", F.col("ret").alias("next_r"), F.col("ret").alias("next_r_z"), F.col("state_id").alias("next_state")), P)
    assert states.edges(stats).where("state_id = 1 and t_stat is null and E_sharpe_z is null").count() == 1


def test_moments_of_years_put_together_do_not_cancel(spark):
    x = 1e4 + np.random.default_rng(5).normal(size=900) * 1e-3
    rows = spark.createDataFrame([(1, ["TREND", "RANGE", None][i % 3], float(v), f"{1996 + i % 3}-0{1 + i % 9}-01") for i, v in enumerate(x)], "state_id long, regime string, ret double, date string")
    one = strategy.identify_before(rows.withColumn("date", F.to_date("date")), "ret", strategy.folds(spark, P), P).first()
    assert one.visits == 900 and one.regime == "RANGE" and np.isclose(one.mu_r, x.mean(), rtol=1e-14) and np.isclose(one.sigma_r, x.std(ddof=1), rtol=1e-6)


def test_regimes_meet_the_quantiles_of_their_own_rows(spark):
    rows = [(i, 5 if i < 9 else 0, (i * 4 % 9 + 1.0) if i < 8 else None, i * 7 % 9 - 3.5, 1.0 + i * 4 % 9) for i in range(10)]
    table = spark.createDataFrame(rows, "state_id long, visits long, sigma_r double, mu_r double, entropy double").coalesce(1)

    def again(frames):
        """The same rows in other units each time that they are made."""
        unit = 1 + np.random.default_rng().random()
        for f in frames:
            yield f.assign(sigma_r=f.sigma_r * unit, mu_r=f.mu_r * unit, entropy=f.entropy * unit)

    labels = lambda df: sorted((x.state_id, x.regime) for x in states.regimes(df).collect())
    want = labels(table)
    assert {x for _, x in want} == {"SHOCK", "TREND", "RANGE", "TRANSITION", "UNKNOWN"}
    assert all(labels(table.mapInPandas(again, table.schema)) == want for _ in range(4))
    assert states.regimes(table).columns == [*table.columns, "regime"]


def test_sums_equal_but_for_their_last_bits_are_ties(spark):
    rows = [(1, 0.3), (2, 0.1), (2, 0.2), (3, 0.1), (3, 0.2), (4, 0.9), (5, 0.1)]
    trades = spark.createDataFrame([(c, 7, x) for c, x in rows], "code int, state_id long, ret_net double")
    sums = trades.groupBy("code").agg(F.sum("ret_net").alias("sum"))
    assert sums.where("code < 3").select("sum").distinct().count() == 2
    assert [x.code for x in macro.top(sums, "sum", 2, "code").collect()] == [4, 1]
    by = macro.contributors(trades, 2).collect()
    assert sorted((x.side, x.code) for x in by) == [("bottom", 1), ("bottom", 5), ("top", 1), ("top", 4)]


def test_expected_counts_by_words_equal_those_row_by_row():
    rng = np.random.default_rng(4)
    for k, m, lengths in ((3, 4, [1, 1, 2, 3, 4, 5, 6, 7, 11, 40]), (2, 3, [1]), (2, 30, [1, 2, 5]), (8, 8, [9, 30, 31, 32])):
        model, width = latent.CategoricalHMM.initial(k, m), latent.word_width(m)
        for obs, sizes in latent._padded([rng.integers(0, m, n) for n in lengths]):
            ll, first, moves, emits = model.expected(obs, sizes)
            words = np.concatenate([product for _, _, product in model._words(width)])
            got_ll, got_first, own, found = model.passes(words, latent.in_words(obs, sizes, m, width))
            got_moves, others = model.word_counts(found, width)
            assert len(words) == sum(m**i for i in range(1, width + 1)) and m**width <= max(m, latent.WORDS)
            assert np.isclose(got_ll, ll) and np.allclose(got_first, first) and np.allclose(got_moves, moves) and np.allclose(own + others, emits)


def test_rows_whose_lead_is_not_made_up_for_keep_their_centres(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x, before = rng.normal(size=(3000, 3)), rng.normal(size=(4, 5, 3))
    before[1, 3] = before[1, 0]  # no lead at all
    _, leads, noted = latent._leading(x, before)
    sums = latent._step_sums(x, before)
    assert np.array_equal(noted[:, : sums.shape[1]], sums) and noted[:, sums.shape[1] :].sum(1).tolist() == [3000] * 4
    for far in (1e-5, 1e-2, 0.3):
        centres = before + far * rng.normal(size=before.shape)
        moves = np.sort(np.sqrt(((centres - before) ** 2).sum(2)), 1)
        made_up = latent._lead(moves[:, -1] + moves[:, -2] + 2.0**latent.LEAD_LEAST)
        got = sums[:, 1:].reshape(4, 5, 4) + latent._changed_sums(x, leads, made_up, before, centres)
        want = latent._step_sums(x, centres)
        assert np.allclose(got, want[:, 1:].reshape(4, 5, 4)) and (far > 0.1 or (leads <= made_up[:, None])[[0, 2, 3]].mean() < 0.2)
        assert np.allclose([(x * x).sum() + latent._inertia(s, c) for s, c in zip(got, centres)], want[:, 0])
    rows = spark.createDataFrame(x.tolist(), "a double, b double, c double").repartition(3).localCheckpoint()
    fit = lambda: latent.fit_centres(rows, ["a", "b", "c"], 4, 5, 42, 40, 1e-4)
    calls = []
    monkeypatch.setattr(latent, "_summed", lambda blocks, step, f=latent._summed: (calls.append(step.__name__), f(blocks, step))[1])
    few = fit()
    assert "step" in calls and calls.count("step") > len(calls) / 2  # most steps look at few rows
    monkeypatch.setattr(latent, "LOOKED", -1.0)  # all distances in every step
    assert np.allclose(few, fit(), atol=1e-9)
