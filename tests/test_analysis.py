"""Operators on inline tables with answers worked out by hand."""

import datetime as dt
import json
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from statefield.config import Params
from statefield.functions.columns import causal_moments, equal_frequency_bin
from statefield.operators import chains, features, latent, live, macro, states, strategy, surfaces
from statefield.sources import sinks, tables

D0 = dt.date(2020, 1, 1)


def day(i):
    return D0 + dt.timedelta(days=i)


def prices(spark, rows):
    return spark.createDataFrame([(c, day(i), float(x)) for c, i, x in rows], "code long, date date, close double")


def test_causal_moments_leave_out_the_row_itself_and_later_ones(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(5, 2, 40)
    df = spark.createDataFrame([(1, day(i), float(v)) for i, v in enumerate(x)], "code long, date date, x double")
    got = {r.date: r for r in causal_moments(df, ["x"], 10).collect()}
    cut = {r.date: r for r in causal_moments(df.where(F.col("date") <= day(25)), ["x"], 10).collect()}
    for i in range(40):
        r = got[day(i)]
        if i < 10:
            assert r.mean_x is None and r.std_x is None
        else:
            assert math.isclose(r.mean_x, x[i - 10 : i].mean(), rel_tol=1e-10)
            assert math.isclose(r.std_x, x[i - 10 : i].std(ddof=1), rel_tol=1e-10)
        if i <= 25 and i >= 10:
            assert math.isclose(cut[day(i)].mean_x, r.mean_x, rel_tol=1e-10)


def test_constant_series_has_no_z(spark):
    df = spark.createDataFrame([(1, day(i), 3.0 if i < 20 else 4.0) for i in range(21)], "code long, date date, r double")
    assert features.z_scores(df, ["r"], 10).orderBy("date").collect()[-1].z_r is None


def test_bins_by_integer_ranks(spark):
    for n in (8, 7, 13):
        df = spark.createDataFrame([(1, float(i)) for i in range(n)] + [(1, None)], "code long, x double")
        got = [r.b for r in df.select("x", equal_frequency_bin("x", 6).alias("b")).orderBy(F.col("x").asc_nulls_last()).collect()]
        assert got[:-1] == [sum((n - 1) * j < 6 * a for j in range(1, 6)) for a in range(n)] and got[-1] is None


def test_forward_is_over_retained_rows(spark):
    df = spark.createDataFrame([(1, day(0), 1.0, 1.0, 5), (1, day(2), 3.0, 3.0, 7), (2, day(0), 9.0, 9.0, 1)], "code long, date date, r double, z_r double, state_id long")
    got = {(r.code, r.date): (r.next_r, r.next_state) for r in features.forward(df).collect()}
    assert got[1, day(0)] == (3.0, 7) and got[1, day(2)] == (None, None) and got[2, day(0)] == (None, None)


def test_state_stats_and_transitions(spark):
    rows = [(1, 1, 0.1), (1, 1, 0.3), (1, 2, 0.2), (2, 1, -0.5)]
    df = spark.createDataFrame([(s, n, r, r) for s, n, r in rows], "state_id long, next_state long, next_r double, next_r_z double")
    stats = {r.state_id: r for r in states.state_stats(df, Params(bins=2)).collect()}
    assert len(stats) == 16 and stats[1].visits == 3 and math.isclose(stats[1].mu_r_raw, 0.2) and math.isclose(stats[1].p_stay, 2 / 3) and stats[5].visits == 0
    assert {(r.s, r.s_next): r.p for r in states.transitions(df).collect()}[1, 2] == pytest.approx(1 / 3)
    assert {r.state_id: r.entropy for r in states.entropy(states.transitions(df)).collect()}[1] == pytest.approx(-(2 / 3 * math.log(2 / 3) + 1 / 3 * math.log(1 / 3)))


def candidates(spark, rows):
    return spark.createDataFrame([(c, day(a), day(b), 1, "TREND", 0.1) for c, a, b in rows], "code long, date date, exit_date date, state_id int, regime string, ret_h double")


def test_greedy_trades_never_overlap(spark):
    cand = candidates(spark, [(1, 0, 5), (1, 3, 8), (1, 5, 10), (1, 6, 11), (2, 1, 2), (2, 2, 3), (2, 3, 4)])
    got = sorted((r.code, r.entry_date, r.exit_date) for r in strategy.non_overlapping(cand).collect())
    assert got == [(1, day(0), day(5)), (1, day(6), day(11)), (2, day(1), day(2)), (2, day(3), day(4))]


def test_blocked_candidates_leave_the_last_exit_alone(spark):
    bear = spark.createDataFrame([(day(0), 1), (day(3), 0)], "date date, is_bear long")
    cand = strategy.without_bear(candidates(spark, [(1, 0, 5), (1, 3, 8)]), bear)
    assert [r.entry_date for r in strategy.non_overlapping(cand).collect()] == [day(3)]


def test_path_counts_days_without_a_row_and_charges_the_exit(spark):
    p = prices(spark, [(1, 0, 100), (1, 1, 110), (1, 3, 121), (2, 0, 1), (2, 1, 1), (2, 2, 1), (2, 3, 1)])
    trades = spark.createDataFrame([(day(0), day(3), 1)], "entry_date date, exit_date date, code long")
    got = [(r.n_active, round(r.port_ret, 6)) for r in strategy.portfolio_path(trades, p, p.select("date"), 0.003).orderBy("date").collect()]
    assert got == [(0, 0.0), (1, 0.1), (1, 0.0), (1, 0.097)]
    late = spark.createDataFrame([(day(0), day(9), 1)], "entry_date date, exit_date date, code long")
    assert strategy.portfolio_path(late, p, p.select("date"), 0.003).agg(F.sum("n_active")).first()[0] == 0
    assert [r.n_active for r in strategy.portfolio_path(late, p, p.select("date"), 0.003, True).orderBy("date").collect()] == [0, 1, 1, 1]


def test_fsm_has_hysteresis(spark):
    dd = [-0.05, -0.11, -0.06, -0.04, -0.12, -0.03, 0.0]
    df = spark.createDataFrame([(day(i), x) for i, x in enumerate(dd)], "date date, dd double")
    assert [r.regime for r in macro.regime_fsm(df).orderBy("date").collect()] == ["BULL", "BEAR", "BEAR", "RECOVERY", "BEAR", "RECOVERY", "BULL"]


def test_market_returns_are_between_adjacent_dates(spark):
    p = prices(spark, [(1, 0, 1), (1, 1, math.e), (1, 2, math.e), (2, 0, 1), (2, 2, 100)])
    got = [round(math.log(r.equity_market), 6) for r in macro.market_equity(p).orderBy("date").collect()]
    assert got == [0.0, 1.0, 1.0]


def test_flip_map_and_classes(spark):
    cells = [(1, "BULL", 30, 3.0), (1, "BEAR", 30, 3.0), (2, "BULL", 29, 3.0), (2, "BEAR", 30, 3.0), (3, "BULL", 30, 3.0), (3, "BEAR", 30, -3.0), (4, "BULL", 30, 3.0), (4, "BEAR", 30, 1.0), (5, "BULL", 30, -1.0), (5, "BEAR", 30, -1.0), (6, "BULL", 30, 1.0), (6, "BEAR", 30, 1.0), (7, "BULL", 30, 1.0)]
    df = spark.createDataFrame([(s, r, n, 0.1, 0.2, t) for s, r, n, t in cells], "state_id long, macro_regime string, n long, mean double, std double, t_one_sample double")
    got = {r.state_id: r.state_class for r in macro.classify(macro.flip_map(df)).collect()}
    assert got == {1: "INVARIANT", 2: "INSUFFICIENT", 3: "TRAP", 4: "CONDITIONAL", 5: "DEAD", 6: "AMBIGUOUS"}
    dist = {r.state_class: r.n for r in macro.class_distribution(macro.classify(macro.flip_map(df))).collect()}
    assert set(dist) == set(macro.CLASSES) and sum(dist.values()) == 6


def hidden(spark):
    z = [0, 1, 1, -1, 1, 0, 0]
    return spark.createDataFrame([(1, day(i), float(i * i), v) for i, v in enumerate(z)] + [(2, day(0), 0.0, 1)], "code long, date date, p double, Z_t long")


def test_hidden_transitions_edges_and_identity(spark):
    df = hidden(spark)
    m = {(r.z, r.z_next): (r.c, r.t) for r in latent.transition_matrix(df, 3).collect()}
    assert len(m) == 9 and m[0, 1] == (1, 0.5) and m[1, 1] == (1, 0.5) and m[2, 0] == (0, 0.0)
    assert latent.verify_matrix(latent.transition_matrix(df, 3))
    e = {r.z: (r.e, r.n) for r in latent.edge_state(df, 3).collect()}
    assert e[0] == ((1 + 11) / 2, 2) and e[2] == (None, 0)
    assert all(r.ok for r in latent.identity_check(df, 3).collect())
    seqs = latent.sequences(df.withColumn("valid", F.col("Z_t") != -1))
    assert seqs.select("seq_id").distinct().count() == 3


def test_stationary_distribution():
    assert np.allclose(latent.stationary(np.array([[0.9, 0.1], [0.3, 0.7]])), [0.75, 0.25])
    assert np.allclose(latent.stationary(np.eye(3)), 1 / 3)


def test_hmm_recovers_a_sticky_chain(spark):
    rng = np.random.default_rng(4)
    rows = []
    for s in range(6):
        z = 0
        for i in range(120):
            z = z if rng.random() < 0.95 else 1 - z
            rows.append((f"s{s}", s, day(i), int(z if rng.random() < 0.95 else 1 - z)))
    seqs = spark.createDataFrame(rows, "seq_id string, code long, date date, C_t int").cache()
    model = latent.fit_hmm(seqs, 2, 2, iterations=15, rows=400)
    assert np.allclose(model.trans.sum(1), 1) and np.allclose(model.emit.sum(1), 1) and np.diag(model.trans).min() > 0.8
    got = chains.decode(seqs, model)
    assert got.count() == len(rows) and {r.Z_t for r in got.select("Z_t").distinct().collect()} <= {0, 1}


def test_rank_bins_are_causal(spark):
    rng = np.random.default_rng(2)
    x = {c: rng.normal(size=n) for c, n in (("a", 30), ("b", 7), ("c", 25))}
    df = spark.createDataFrame([(c, day(i), float(v), "k") for c, xs in x.items() for i, v in enumerate(xs)], "code string, date date, z double, other string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    got = {(r.code, r.date): r.z_bin for r in live.rank_bins(df, ["z"], 10, 6).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == {(c, day(i)): min(5, math.floor((xs[i - 10 : i] < xs[i]).sum() / 10 * 6)) for c, xs in x.items() for i in range(10, len(xs))}


def test_occupancy_turnover_and_exposure(spark):
    rows = [(day(i), c, (i + c) % 2 if i != 2 else -1) for i in range(4) for c in range(3)]
    df = spark.createDataFrame(rows, "date date, code int, Z_t int")
    got = {(r.date, r.z): (round(r.recent, 6), r.changed) for r in surfaces.occupancy_change(df, 2, 1, 3).collect()}
    assert got == {(day(i), z): (round((2 if (i + z) % 2 == 0 else 1) / 3, 6), i > 0) for i in (0, 1, 3) for z in (0, 1)}
    w = spark.createDataFrame([(day(0), 1, 1.0), (day(1), 2, 1.0), (day(2), 2, 0.5), (day(2), 1, 0.5)], "date date, code int, weight double")
    assert [r.turnover for r in surfaces.turnover(w).orderBy("date").collect()] == [0.5, 1.0, 0.5]
    edge = spark.createDataFrame([(0, -1.0), (1, 1.0)], "z int, e double")
    dd = spark.createDataFrame([(day(i), -0.2 if i == 1 else 0.0) for i in range(4)], "date date, dd double")
    assert [r.exposure for r in surfaces.bear_exposure(df, edge, dd).orderBy("date").collect()] == [0.0, 0.5, 1.0]


def test_clean_panel_keeps_the_last_row(spark):
    raw = spark.createDataFrame([(1, "5", "2020-01-01", 1.0, 1.0), (2, "5", "2020-01-01", 2.0, 1.0), (3, "6", "2020-01-01", None, 1.0)], "ingest_id long, code string, date string, close double, volume double")
    assert [(r.code, r.close) for r in live.clean_panel(raw).collect()] == [("000005", 2.0)]
    assert [(r.code, r.close) for r in live.first_close(raw.withColumn("date", F.to_date("date"))).collect()] == [("5", 1.0)]


def test_signals(spark):
    st = spark.createDataFrame([(day(0), 1, 5), (day(1), 1, 5), (day(1), 2, 6), (day(1), 3, 7)], "date date, code long, state_id long")
    pri = spark.createDataFrame([(5, 0.1), (6, 0.2)], "state_id long, edge double")
    got = live.signals(st, pri, 5)
    assert [r.code for r in got.collect()] == [2, 1]
    assert '"symbol":"2"' in live.render_json(got).first()[0] and "signals: 2" in live.render_text(got).first()[0]
    with pytest.raises(ValueError):
        live.signals(st, pri, 5, "2031-01-01")


def test_appends_are_idempotent(spark, tmp_path):
    rows = spark.createDataFrame([(day(0), 1, 2.0), (day(400), 1, 3.0)], "date date, code long, close double")
    path = str(tmp_path / "panel")
    sinks.append_new(rows, path)
    sinks.append_new(rows, path)
    assert tables.read_panel(spark, path).count() == 2
    assert tables.read_panel(spark, path, ["code"], 2021, 2021).count() == 1


def test_reports_and_checks(spark):
    with pytest.raises(ValueError):
        sinks.report_json({"a": {"x": [float("nan")]}})
    with pytest.raises(ValueError):
        macro.assert_finite(spark.createDataFrame([(float("inf"),)], "x double"))
    with pytest.raises(ValueError):
        tables.require_columns(spark.range(1), ["id", "b"])
    with pytest.raises(ValueError):
        tables.require_domain(spark.createDataFrame([("X",)], "r string"), "r", ["BULL"])
    assert tables.business_days(spark, "2024-01-05", "2024-01-08").count() == 2


def test_ks_and_spectrum(spark):
    a = spark.createDataFrame([(float(x),) for x in range(100)], "x double")
    b = spark.createDataFrame([(float(x + 50),) for x in range(100)], "x double")
    assert surfaces.ks(a, b, "x").first()[0] == pytest.approx(0.5)
    got = surfaces.spectrum(np.array([[0.9, 0.1], [0.2, 0.8]]))
    assert got["first"] == pytest.approx(1) and got["second"] == pytest.approx(0.7)


def test_streamed_ingest(spark, tmp_path):
    from statefield.streaming.ingest import ingest

    rows = spark.createDataFrame([(day(0), 1, 2.0), (day(1), 1, 3.0)], "date date, code long, close double")
    rows.write.parquet(str(tmp_path / "land"))
    for _ in range(2):
        ingest(spark, str(tmp_path / "land"), rows.schema, str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_command_line_tells_unbuilt_reports(spark, tmp_path):
    from statefield import cli

    assert cli.main(["summary", "--out", str(tmp_path)]) == 2


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no driver tables")
def test_command_line_builds_and_shows_reports(spark, tmp_path, capsys):
    from statefield import cli

    out = str(tmp_path / "reports")
    assert cli.main(["build", "--source", "/root/testdata/sf0.001", "--out", out]) == 0
    assert {"attribution.json", "diagnostics.json", "drawdown.svg", "regimes.svg", "classes.svg"} <= set(os.listdir(out))
    report = json.loads((tmp_path / "reports" / "attribution.json").read_text())
    assert sum(x["n"] for x in report["by_class"]) == report["total"][0]["n"] > 0
    for command, shown in (("summary", "state_class"), ("class", "state_id"), ("regime", "share_BULL"), ("drift", "kl_bull_bear")):
        assert cli.main([command, "--out", out]) == 0
        assert shown in capsys.readouterr().out


def test_charts_and_meta(spark, tmp_path):
    def fails(path):
        raise OSError("no disk")

    done = sinks.charts({"a": lambda p: sinks.line_chart({"x": [(0, 1), (1, float("nan")), (2, 3)], "y": []}, p), "b": fails, "c": lambda p: sinks.line_chart({}, p)}, str(tmp_path))
    assert done == ["a"] and (tmp_path / "a.svg").read_text().count("polyline") == 1
    path = str(tmp_path / "meta")
    assert sinks.write_meta(spark, path, {"a": float("inf")}, dry=True) == '{"a": null}' and not os.path.exists(path)
    sinks.write_meta(spark, path, {"a": [1.5, float("nan")], "b": {"c": 2}})
    assert tables.read_meta(spark, path) == {"a": [1.5, None], "b": {"c": 2}}
    with pytest.raises(ValueError):
        tables.require_domain(spark.createDataFrame([("BULL",), (None,)], "r string"), "r", ["BULL"])


def test_path_joins_intervals_without_arrays_of_days(spark):
    """No row carries the calendar, and no trade is compared with days beyond its bins."""
    rows = [(c, day(i), 10.0 + i + c) for c in range(3) for i in range(40)]
    prices = spark.createDataFrame(rows, "code long, date date, close double")
    trades = spark.createDataFrame([(0, day(1), day(9)), (1, day(5), day(5)), (2, day(30), day(200))], "code long, entry_date date, exit_date date")
    for clamp in (False, True):
        path = strategy.portfolio_path(trades, prices, prices.select("date").distinct(), 0.01, clamp)
        plan = path._jdf.queryExecution().optimizedPlan().toString()
        assert "collect_set" not in plan and "collect_list" not in plan and "_bin" in plan
        got = {r.date: r for r in path.collect()}
        assert len(got) == 40 and [got[day(i)].n_active for i in (1, 2, 9, 10, 31, 39)] == [0, 1, 1, 0, int(clamp), int(clamp)]
        assert abs(got[day(9)].port_ret - (1 / 18.0 - 0.01)) < 1e-12 and got[day(5)].port_ret > 0
