"""Regime folds, purging and the parts of a fold against loops over plain rows."""

import datetime
from collections import Counter, defaultdict

import numpy as np
import pytest

from statefield.operators import folds

DAY = datetime.date(2020, 1, 1)
at = lambda i: DAY + datetime.timedelta(int(i))


def calendar(rng, n):
    return [(at(i), str(m)) for i, m in enumerate(rng.choice(["BEAR", "BULL", "SHOCK"], n, p=[0.3, 0.5, 0.2]))]


@pytest.mark.parametrize("k,length,n", [(3, 5, 97), (4, 7, 200), (2, 1, 31)])
def test_each_regime_is_dealt_evenly(spark, k, length, n):
    got = folds.regime_blocks(spark.createDataFrame(calendar(np.random.default_rng(k), n), "date date, market string"), k, length).orderBy("date").collect()
    assert [r.date for r in got] == [at(i) for i in range(n)] and [r.block for r in got] == [i // length for i in range(n)]
    blocks = defaultdict(list)
    for r in got:
        blocks[r.block].append(r)
    for rows in blocks.values():
        counts = Counter(r.market for r in rows)
        assert {(r.main, r.fold) for r in rows} == {(min(counts, key=lambda m: (-counts[m], m)), rows[0].fold)}
    dealt = Counter((rows[0].main, rows[0].fold) for rows in blocks.values())
    for market in {m for m, _ in dealt}:
        sizes = [dealt[market, f] for f in range(k)]
        assert max(sizes) - min(sizes) <= 1
    totals = Counter(rows[0].fold for rows in blocks.values())
    assert max(totals.values()) - min(totals[f] for f in range(k)) <= 3


@pytest.mark.parametrize("embargo", [0, 4])
def test_no_training_row_overlaps_its_fold(spark, embargo):
    rng, k = np.random.default_rng(5), 3
    days = folds.regime_blocks(spark.createDataFrame(calendar(rng, 120), "date date, market string"), k, 8)
    fold = {r.date: r.fold for r in days.collect()}
    rows = [(at(i), at(i + rng.integers(1, 12)), int(rng.integers(0, 3)), "TREND", float(rng.normal())) for i in range(118) for _ in range(3)]
    df = spark.createDataFrame(rows, "date date, exit_date date, state_id int, regime string, ret_h double")
    got = {(r.fold, r.state_id): r for r in folds.identify_purged(df, "ret_h", folds.purge_limits(days, df, k, embargo), k).collect()}
    want = defaultdict(list)
    for f in range(k):
        tests = [(d, d) for d in fold if fold[d] == f] + [(d, e + datetime.timedelta(embargo)) for d, e, *_ in rows if fold[d] == f]
        for d, e, state, _, ret in rows:
            if not any(a <= e and d <= z for a, z in tests):
                want[f, state].append(ret)
    assert len(want) > 3 and got.keys() == want.keys()
    for key, rets in want.items():
        assert got[key].visits == len(rets) and got[key].mu_r == pytest.approx(np.mean(rets), abs=1e-9)
        if len(rets) > 1:
            assert got[key].sigma_r == pytest.approx(np.std(rets, ddof=1), abs=1e-7)


def test_deviations_of_nearly_equal_returns(spark):
    """Sums of squares would cancel here."""
    rows = [(at(i), at(i), 0, "TREND", 1e3 + 1e-6 * (i % 2)) for i in range(10)]
    df = spark.createDataFrame(rows, "date date, exit_date date, state_id int, regime string, ret_h double")
    days = spark.createDataFrame([(at(i), int(i >= 6)) for i in range(10)], "date date, fold int")
    got = {r.fold: r for r in folds.identify_purged(df, "ret_h", folds.purge_limits(days, df, 2), 2).collect()}
    for f, rets in enumerate(([r[4] for r in rows[6:]], [r[4] for r in rows[:6]])):
        assert got[f].visits == len(rets) and got[f].sigma_r == pytest.approx(np.std(rets, ddof=1), rel=1e-6)


def test_trades_stay_on_their_folds_dates(spark):
    rng, k = np.random.default_rng(8), 3
    days = folds.regime_blocks(spark.createDataFrame(calendar(rng, 300), "date date, market string"), k, 30)
    rows = [(c, at(i), at(i + 3), i % 2, "TREND", 0.01 * (1 - 2 * (i % 2)) + float(rng.normal(0, 0.001))) for c in range(4) for i in range(290)]
    df = spark.createDataFrame(rows, "code int, date date, exit_date date, state_id int, regime string, ret_h double")
    trades = folds.regime_trades(df, days, k)
    fold, got = {r.date: (r.fold, r.market) for r in days.collect()}, trades.collect()
    assert got and {t.state_id for t in got} == {0} and {t.fold for t in got} == {0, 1, 2} and all(fold[t.entry_date][0] == t.fold for t in got)
    for f in range(k):
        for c in range(4):
            own = sorted((t.entry_date, t.exit_date) for t in got if (t.fold, t.code) == (f, c))
            assert all(b[0] > a[1] for a, b in zip(own, own[1:]))
    by = folds.regime_cv(trades, days, folds.DEFAULT, "market").collect()
    for r in by:
        rets = [t.ret_net for t in got if fold[t.entry_date] == (r.fold, r.market)]
        assert r.n_trades == len(rets) and r.n_days == sum(v == (r.fold, r.market) for v in fold.values())
        assert not rets or r.mean == pytest.approx(np.mean(rets))
    assert sum(r.n_trades for r in folds.regime_cv(trades, days).collect()) == len(got)


def test_parts_of_a_fold_add_up(spark):
    rng = np.random.default_rng(3)
    rows = [(int(f), int(s), str(m), g, g - 0.003) for f, s, m, g in zip(rng.integers(0, 3, 200), rng.integers(0, 6, 200), rng.choice(["BEAR", "BULL"], 200), rng.normal(0, 1, 200).tolist())]
    rows += [(2, 9, "SHOCK", -50.0, -50.003)]
    cells = folds.fold_cells(spark.createDataFrame(rows, "fold int, state_id int, market string, ret_gross double, ret_net double"))
    mean = lambda f, s=None, m=None: (lambda x: np.mean(x) if x else None)([g for h, t, n, g, _ in rows if h != f and s in (None, t) and m in (None, n)])
    for c in cells.collect():
        assert c.expected + c.regime + c.state + c.own - c.cost == pytest.approx(c.net, abs=1e-9)
        total = mean(c.fold)
        market = mean(c.fold, None, c.market)
        market = total if market is None else market
        state = mean(c.fold, c.state_id, c.market)
        state = market if state is None else state
        assert (c.expected, c.regime, c.state) == pytest.approx((c.n * total, c.n * (market - total), c.n * (state - market)), abs=1e-9)
    metrics = spark.createDataFrame([(0, 1.0), (1, None), (2, -3.0)], "fold int, sharpe double")
    parts = {r.fold: r for r in folds.fold_parts(cells, metrics).collect()}
    assert [parts[f].worst for f in range(3)] == [False, False, True]
    assert parts[2].net == pytest.approx(sum(r[4] for r in rows if r[0] == 2))
    lost = folds.losses(cells, folds.fold_parts(cells, metrics)).orderBy("place").collect()
    assert (lost[0].state_id, lost[0].market, lost[0].fold) == (9, "SHOCK", 2) and sum(r.share for r in lost) == pytest.approx(1)


def test_a_single_fold_has_nothing_to_expect(spark):
    c = folds.fold_cells(spark.createDataFrame([(0, 1, "BULL", 0.5, 0.4)], "fold int, state_id int, market string, ret_gross double, ret_net double")).first()
    assert (c.expected, c.regime, c.state, c.own) == (0, 0, 0, 0.5) and c.cost == pytest.approx(0.1)
    none = folds.regime_blocks(spark.createDataFrame([], "date date, market string"))
    assert none.count() == 0
