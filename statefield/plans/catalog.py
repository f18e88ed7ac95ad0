"""Registry of the analytic queries and their oracles.

Every query takes the driver's tables; the daily panel is made from lineitem. Doubles are rounded to six digits on both sides.
"""

from __future__ import annotations

import json
import re
import tempfile
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CLASS_STATES, CLASSES
from ..config import TABLES as P
from ..operators import chains, features, latent, live, macro, states, strategy, surfaces
from ..sources import sinks, tables
from .oracles import query, r

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to some digits, dates as text, so that both engines' results compare alike."""
    shown = {"double": lambda c: F.round(c, digits) + F.lit(0.0), "date": lambda c: F.col(c).cast("string")}
    return df.select(*(shown.get(t, F.col)(c).alias(c) for c, t in df.dtypes))


def grown(df: DataFrame, *cols: str) -> DataFrame:
    """Compounded columns on a logarithmic scale: on the driver's noise they grow beyond any fixed number of digits."""
    return df.select(*(F.col(c) for c in df.columns if c not in cols), *((F.signum(c) * F.ln(1 + F.abs(c))).alias(f"log_{c}") for c in cols))


def lg(cols: str) -> str:
    return ", ".join(r(f"sign({c}) * ln(1 + abs({c}))", f"log_{c}") for c in cols.split())


_DATES = re.compile(r"\b(?:entry_date|exit_date|date)\b")


def _dates_as_text(sql: str) -> str:
    """Casts the date columns that a query returns."""
    head = re.split(r"\bFROM\b", re.sub(r"\([^()]*\)", "", re.sub(r"\([^()]*\)", "", sql)), maxsplit=1)[0]
    names = sorted(set(_DATES.findall(head)))
    return f"SELECT * REPLACE ({', '.join(f'CAST({n} AS VARCHAR) AS {n}' for n in names)}) FROM ({sql})" if names else sql


_kept: dict[tuple[str, str, str], DataFrame] = {}


def shared(f: Query) -> Query:
    """Keeps a stage that many queries read as a table in the shared folder, so that their plans begin there."""

    def get(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = spark.sparkContext.applicationId, sf_dir, f.__name__
        if key not in _kept:
            _kept[key] = sinks.written(f(spark, sf_dir), f.__name__)
        return _kept[key]

    return get


def forget() -> None:
    """Forgets all kept stages; their files stay until the shared folder is cleared."""
    _kept.clear()


def register(name: str, needs: str | None = None, sql: str | None = None, digits: int = 6):
    def add(f: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir), digits)
        if sql is not None:
            ORACLES[name] = query(needs or "", _dates_as_text(sql))
        return f

    return add


def rs(cols: str, digits: int = 6) -> str:
    return ", ".join(r(c, c, digits) for c in cols.split())


# The stages of the analysis


def panel(spark: SparkSession, sf: str) -> DataFrame:
    return tables.lineitem_panel(spark, sf)


@shared
def forward_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that have a state with what comes next: made where the lines lie dealt by code, so that no row moves for it again."""
    return features.forward(features.warmed_up(features.state_vector(panel(spark, sf), P)))


def state_rows(spark: SparkSession, sf: str) -> DataFrame:
    return forward_rows(spark, sf).drop("next_r", "next_r_z", "next_state")


def dealt(rows: DataFrame) -> DataFrame:
    """Rows of kept stages dealt by code into parts that don't grow, for windows by code."""
    return rows.repartition(tables.parts_of(rows), "code")


def valid_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return states.pairs(forward_rows(spark, sf))


@shared
def state_regimes(spark: SparkSession, sf: str) -> DataFrame:
    return states.state_table(valid_pairs(spark, sf), P).select("state_id", "regime")


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    return states.labelled(forward_rows(spark, sf), state_regimes(spark, sf))


@shared
def trades(spark: SparkSession, sf: str) -> DataFrame:
    return strategy.trades_of(labelled(spark, sf), P)


def market(spark: SparkSession, sf: str) -> DataFrame:
    return macro.market_equity(state_rows(spark, sf))


@shared
def macro_labels(spark: SparkSession, sf: str) -> DataFrame:
    return macro.regime_fsm(market(spark, sf).select("date", "dd"), P)


def decomposition(spark: SparkSession, sf: str) -> DataFrame:
    return macro.state_decomposition(trades(spark, sf), macro_labels(spark, sf), P)


def holdings(spark: SparkSession, sf: str) -> DataFrame:
    """One-day holdings of all rows as trades, for the classes; see config.CLASSES."""
    rows = states.pairs(labelled(spark, sf))
    return rows.select(F.col("date").alias("entry_date"), "code", (F.col("state_id") % CLASS_STATES).alias("state_id"), "regime", F.col("next_r").alias("ret_gross"), (F.col("next_r") - P.cost).alias("ret_net"))


def class_labels(spark: SparkSession, sf: str) -> DataFrame:
    return macro.regime_fsm(market(spark, sf).select("date", "dd"), CLASSES)


def flips(spark: SparkSession, sf: str) -> DataFrame:
    return macro.flip_map(macro.state_decomposition(holdings(spark, sf), class_labels(spark, sf), CLASSES), CLASSES)


def classes(spark: SparkSession, sf: str) -> DataFrame:
    return macro.classify(flips(spark, sf), CLASSES)


def drift(spark: SparkSession, sf: str) -> DataFrame:
    return macro.transition_drift(dealt(state_rows(spark, sf)), macro_labels(spark, sf))


def hidden(spark: SparkSession, sf: str) -> DataFrame:
    """Stand-in hidden states: the state modulo 8, none on the first of a month."""
    z = F.when(F.dayofmonth("date") == 1, -1).otherwise(F.col("state_id") % 8).cast("long")
    return state_rows(spark, sf).select("code", "date", "p", "state_id", z.alias("Z_t"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return states.state_stats(valid_pairs(spark, sf_dir), P).where("visits > 0").select("state_id", "visits", "mu_r_raw", "p_stay")


# Features

register("s1_panel", "panel", f"SELECT code, date, {rs("volume trade_value")}, {r("close + 1e-9", "close")} FROM panel")(lambda s, d: panel(s, d).withColumn("close", F.col("close") + 1e-9))
register("w1_raw_features", "feats", f"SELECT code, date, {rs('p r sigma v l flow')} FROM feats")(lambda s, d: features.raw_features(panel(s, d), P).select("code", "date", "p", "r", "sigma", "v", "l", "flow"))
register("w3_z_scores", "zs", f"SELECT code, date, {rs('z_r z_sigma z_v z_flow')} FROM zs")(lambda s, d: features.z_scores(features.raw_features(panel(s, d), P), features.Z, P.w_z).select("code", "date", "z_r", "z_sigma", "z_v", "z_flow"))
register("w4_state_vector", "states", f"SELECT code, date, bin_r, bin_sigma, bin_v, bin_flow, state_id FROM states")(lambda s, d: state_rows(s, d).select("code", "date", "bin_r", "bin_sigma", "bin_v", "bin_flow", "state_id"))
register("w5_forward", "fwd", f"SELECT code, date, state_id, {rs('next_r next_r_z')}, next_state FROM fwd")(lambda s, d: forward_rows(s, d).select("code", "date", "state_id", "next_r", "next_r_z", "next_state"))
register("w6_horizon_return", "hor", f"SELECT code, date, {r('ret_h')}, exit_date FROM hor")(lambda s, d: features.horizon_return(labelled(s, d), P.horizon).select("code", "date", "ret_h", "exit_date"))
register("w12_daily_return", "retd", f"SELECT code, date, {r('ret_d')} FROM retd")(lambda s, d: features.daily_return(state_rows(s, d)).select("code", "date", "ret_d"))
register("p3_valid_mask", "zs", "SELECT valid, count(*) AS n FROM (SELECT z_r IS NOT NULL AND z_sigma IS NOT NULL AND z_v IS NOT NULL AND z_flow IS NOT NULL AS valid FROM zs) GROUP BY 1")(
    lambda s, d: features.valid_mask(features.z_scores(features.raw_features(panel(s, d), P), features.Z, P.w_z), [f"z_{c}" for c in features.Z]).groupBy("valid").agg(F.count(F.lit(1)).alias("n"))
)

# States and edges

STATS = "mu_r_raw sigma_r_raw mu_r sigma_r p_stay"
register("a1_state_stats", "stats", f"SELECT state_id, visits, {rs(STATS)}, bin_r, bin_sigma, bin_v, bin_flow FROM stats")(lambda s, d: states.state_stats(valid_pairs(s, d), P))
register("a3_transitions", "trans", f"SELECT s, s_next, n, {r('p')} FROM trans")(lambda s, d: states.transitions(valid_pairs(s, d)))
register("a4_entropy", "ent", f"SELECT state_id, {r('entropy')} FROM ent")(lambda s, d: states.with_entropy(states.state_stats(valid_pairs(s, d), P), states.transitions(valid_pairs(s, d))).select("state_id", "entropy"))
register("a6_thresholds", "cuts", f"SELECT {rs('q70_sigma q30_sigma med_sigma q70_mu med_mu med_entropy')} FROM cuts")(lambda s, d: states.thresholds(states.with_entropy(states.state_stats(valid_pairs(s, d), P), states.transitions(valid_pairs(s, d)))))
register("a7_regimes", "reg", "SELECT state_id, visits, regime FROM reg")(lambda s, d: states.state_table(valid_pairs(s, d), P).select("state_id", "visits", "regime"))
register("a5_regime_transitions", "valid reg", f"SELECT regime, s, s_next, n, {r('p')} FROM (SELECT regime, state_id AS s, next_state AS s_next, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY regime, state_id) AS p FROM valid JOIN reg USING (state_id) GROUP BY 1, 2, 3)")(
    lambda s, d: states.transitions(states.pairs(labelled(s, d)), "regime")
)
EDGE = "E_raw E_z E_sharpe_raw E_sharpe_z E_stay_raw E_stay_z t_stat"
register("a10_edges", "edge", f"SELECT state_id, visits, regime, {rs(EDGE)} FROM edge")(lambda s, d: states.edges(states.state_table(valid_pairs(s, d), P)).select("state_id", "visits", "regime", *EDGE.split()))
register("a11_tradeable", "edge", f"SELECT state_id, {rs('E_raw t_stat')} FROM edge WHERE E_raw > 0 AND visits >= {P.min_visits} AND t_stat >= {P.t_least} AND regime IN ('TREND', 'RANGE')")(
    lambda s, d: states.tradeable(states.edges(states.state_table(valid_pairs(s, d), P)), P).select("state_id", "E_raw", "t_stat")
)
register("v1_checks", "states", "SELECT min(state_id) AS least, max(state_id) AS most, count(*) AS n, count(DISTINCT code) AS codes FROM states")(lambda s, d: state_rows(s, d).agg(F.min("state_id").alias("least"), F.max("state_id").alias("most"), F.count(F.lit(1)).alias("n"), F.countDistinct("code").alias("codes")))
register("v2_row_sums", "trans", "SELECT count(*) AS rows, count(CASE WHEN abs(x - 1) > 1e-9 THEN 1 END) AS bad FROM (SELECT s, sum(p) AS x FROM trans GROUP BY s)")(
    lambda s, d: states.transitions(valid_pairs(s, d)).groupBy("s").agg(F.sum("p").alias("x")).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.abs(F.col("x") - 1) > 1e-9).alias("bad"))
)

# Selection, trades, portfolios


def _pick1(s: SparkSession, d: str) -> DataFrame:
    return strategy.identify(labelled(s, d).where((F.col("date") <= F.lit(P.train_end).cast("date")) & F.col("next_r").isNotNull()), "next_r", P)


def _daily1(s: SparkSession, d: str) -> DataFrame:
    return strategy.one_day_backtest(labelled(s, d).where(F.col("date") >= F.lit(P.test_start).cast("date")), strategy.chosen(_pick1(s, d)), P.cost)


register("a9_identify", "pick1", f"SELECT state_id, visits, {rs('mu_r sigma_r')}, regime, {r('t_stat')}, tradeable FROM pick1")(_pick1)
register("b1_overlapping", "daily1", f"SELECT date, n_trades, {rs('ret_gross ret_net')}, {lg('cum_gross cum_net')} FROM daily1")(lambda s, d: grown(_daily1(s, d).select("date", "n_trades", "ret_gross", "ret_net", "cum_gross", "cum_net"), "cum_gross", "cum_net"))
register("b2_metrics", "daily1", f"""SELECT n_trades, {rs('mean_gross mean_net')}, round(mean_gross / sd_gross * sqrt(252.0), 6) + 0.0 AS sharpe_gross, round(mean_net / sd_net * sqrt(252.0), 6) + 0.0 AS sharpe_net, {r('n_win / n_trades', 'win_rate')}, {lg('mdd final_cum_net')}, {r('sign(cagr_net) * ln(1 + abs(cagr_net))', 'log_cagr_net')} FROM (SELECT *, CASE WHEN last > first THEN pow(1 + final_cum_net, 1 / ((last - first) / 365.25)) - 1 END AS cagr_net FROM (SELECT CAST(sum(n_trades) AS BIGINT) AS n_trades, avg(ret_gross) AS mean_gross, avg(ret_net) AS mean_net, stddev_samp(ret_gross) AS sd_gross, stddev_samp(ret_net) AS sd_net, min(dd) AS mdd, sum(n_win) AS n_win,
  min(date) AS first, max(date) AS last, arg_max(cum_net, date) AS final_cum_net FROM (SELECT *, (1 + cum_net) / max(1 + cum_net) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS dd FROM daily1)))""")(lambda s, d: grown(strategy.daily_metrics(_daily1(s, d), P.ann), "mdd", "final_cum_net", "cagr_net"))
HS = " UNION ALL ".join(f"SELECT {h} AS h, code, date, state_id, regime, lead(close, {h}) OVER (PARTITION BY code ORDER BY date) / close - 1 AS ret FROM lab" for h in P.horizons)


def _horizon_sql() -> str:
    from . import oracles as o

    o.cte("hs", "lab", f"SELECT * FROM ({HS}) WHERE ret IS NOT NULL")
    o.cte("hst", "hs", f"SELECT * FROM hs WHERE date <= DATE '{P.train_end}'")
    o.cte("hsp", "hst", o.identify("hst", "ret", "h, "))
    o.cte("hsd", "hs hsp", f"SELECT h, date, count(*) AS n, sum(ret) AS s, sum(CASE WHEN ret > 0 THEN 1 ELSE 0 END) AS w, avg(ret) AS g FROM hs SEMI JOIN (SELECT h, state_id FROM hsp WHERE tradeable) USING (h, state_id) WHERE date >= DATE '{P.test_start}' GROUP BY 1, 2")
    return f"""SELECT h, CAST(sum(n) AS BIGINT) AS n_trades, {r('sum(s) / sum(n)', 'mu_gross')}, {r(f'sum(s) / sum(n) - {P.cost}', 'mu_net')}, {r('sum(w) / sum(n)', 'win_rate')}, {r('avg(g) / stddev_samp(g) * sqrt(252.0 / h)', 'sharpe_gross')}, {r(f'avg(g - {P.cost}) / stddev_samp(g - {P.cost}) * sqrt(252.0 / h)', 'sharpe_net')} FROM hsd GROUP BY h"""


_hs = _horizon_sql()
register("b4_horizons", "hsd", _hs)(lambda s, d: strategy.horizon_sweep(labelled(s, d), P))
TR = "entry_date, exit_date, code, state_id, regime"
register("q1_trades", "trades", f"SELECT {TR}, {rs('ret_gross ret_net')} FROM trades")(trades)
register("q2_overlay_trades", "tradesb", f"SELECT {TR}, {rs('ret_gross ret_net')} FROM (SELECT date AS entry_date, exit_date, code, state_id, regime, ret_h AS ret_gross, ret_h - {P.cost} AS ret_net FROM tradesb)")(lambda s, d: strategy.trades_of(labelled(s, d), P, strategy.market_bear(labelled(s, d), P.sma)))
register("w11_market_bear", "bear", f"SELECT date, {rs('close sma')}, is_bear FROM bear")(lambda s, d: strategy.market_bear(state_rows(s, d), P.sma))


def _path(s: SparkSession, d: str) -> DataFrame:
    rows = labelled(s, d)
    return strategy.portfolio_path(trades(s, d), rows, rows.where(F.col("date") >= F.lit(P.test_start).cast("date")).select("date"), P.cost)


MET, FOLD, BIG_ONES = "win_rate_net avg_active sharpe sortino mdd", "win_rate_net sharpe mdd", "cagr calmar final_equity"
register("q4_portfolio_path", "path", f"SELECT date, n_active, {r('port_ret')}, {lg('equity')} FROM path")(lambda s, d: grown(_path(s, d), "equity"))
register("b3_metrics", "met", f"SELECT n_trades, {rs(MET)}, {lg(BIG_ONES)}, passed FROM met")(lambda s, d: grown(strategy.path_metrics(_path(s, d), trades(s, d), P), *BIG_ONES.split()))
register("b6_walk_forward", "metf", f"SELECT fold, n_trades, {rs(FOLD)}, {lg(BIG_ONES)}, passed FROM metf")(lambda s, d: grown(strategy.walk_forward(labelled(s, d), P), *BIG_ONES.split()))
register("b7_overlay_walk_forward", "metfb", f"SELECT fold, n_trades, {rs(FOLD)}, {lg(BIG_ONES)}, passed FROM metfb")(lambda s, d: grown(strategy.walk_forward(labelled(s, d), P, True), *BIG_ONES.split()))
register("a34_fold_summary", "metf", f"""SELECT count(*) AS n_folds, CAST(sum(CAST(passed AS INT)) AS BIGINT) AS n_passed, {r('avg(sharpe)', 'mean_sharpe')}, {r('coalesce(stddev_samp(sharpe), 0.0)', 'std_sharpe')},
  round(CASE WHEN avg(sharpe) > 0 THEN coalesce(stddev_samp(sharpe), 0.0) / avg(sharpe) END, 6) + 0.0 AS cv, coalesce(sum(CAST(passed AS INT)) >= {P.sys_min_pass} AND avg(sharpe) > {P.sys_min_mean} AND stddev_samp(sharpe) / avg(sharpe) < {P.sys_max_cv}, false) AS system_pass FROM metf""")(
    lambda s, d: strategy.fold_summary(strategy.walk_forward(labelled(s, d), P), P)
)

# Macro regimes and reports

register("w10_market_equity", "equity", f"SELECT date, {r('dd')}, {lg('equity_market')} FROM equity")(lambda s, d: grown(market(s, d), "equity_market"))
register("q3_macro_regimes", "fsm", f"SELECT date, {r('dd')}, regime FROM fsm")(macro_labels)
register("a16_regime_pnl", "mtr", f"SELECT macro_regime, count(*) AS n_trades, {r('avg(ret_net)', 'mean')}, {r('stddev_samp(ret_net)', 'std')}, {r('sum(ret_net)', 'sum')}, {r('avg(CASE WHEN ret_net > 0 THEN 1.0 ELSE 0.0 END)', 'hit_rate')}, {r(f'avg(ret_net) / (stddev_samp(ret_net) + {P.eps}) * sqrt({P.ann} / {P.horizon})', 'sharpe_ann')} FROM mtr GROUP BY 1")(
    lambda s, d: macro.regime_pnl(trades(s, d), macro_labels(s, d), P)
)
BIG = "CASE WHEN std = 0 THEN sign(mean) ELSE round(t_one_sample, 6) END + 0.0 AS t_one_sample"
register("a17_state_decomposition", "dec", f"SELECT state_id, macro_regime, n, {rs('mean std sum se')}, {BIG} FROM dec")(lambda s, d: decomposition(s, d).withColumn("t_one_sample", F.when(F.col("std") == 0, F.signum("mean")).otherwise(F.col("t_one_sample"))))
register("a18_transition_drift", "drift", f"SELECT regime, state_id, next_state, n, {r('P')} FROM drift")(drift)
register("a19_kl", "kl", f"SELECT state_id, {r('kl_bull_bear')} FROM kl")(lambda s, d: macro.kl_bull_bear(drift(s, d), P))
FLIP_T = "t_flip t_bull_pos t_bear_pos"
register("a20_flip_map", "cflip", f"SELECT state_id, n_bull, n_bear, {rs('mu_bull mu_bear s2_bull s2_bear')}, reliable, {lg(FLIP_T)} FROM cflip")(
    lambda s, d: grown(flips(s, d).select("state_id", "n_bull", "n_bear", "mu_bull", "mu_bear", "s2_bull", "s2_bear", "reliable", *FLIP_T.split()), *FLIP_T.split())
)
register("a21_classes", "cclasses", "SELECT state_id, state_class FROM cclasses")(classes)
SUM = f"count(*) AS n, {r('coalesce(sum(ret_net), 0.0)', 'sum')}, {r('coalesce(avg(ret_net), 0.0)', 'mean')}, {r('coalesce(CASE WHEN count(*) > 1 THEN stddev_samp(ret_net) END, 0.0)', 'std')}"
register("a22_summary", "trades", f"SELECT {SUM} FROM trades")(lambda s, d: macro.summary(trades(s, d)))
register("a23_pnl_by_class", "cattr", f"SELECT state_class, {SUM} FROM cattr GROUP BY 1")(lambda s, d: macro.summary(macro.attribution(holdings(s, d), classes(s, d)), "state_class"))
register("a23_pnl_by_regime", "trades", f"SELECT regime, {SUM} FROM trades GROUP BY 1")(lambda s, d: macro.summary(trades(s, d), "regime"))
CO = "SELECT code, state_id, sum(ret_net) AS s, count(*) AS n FROM trades GROUP BY 1, 2"
register("a24_contributors", "trades", f"SELECT code, state_id, {r('s', 'sum')}, n, 'top' AS side FROM (SELECT * FROM ({CO}) ORDER BY s DESC, code, state_id LIMIT 20) UNION ALL SELECT code, state_id, {r('s', 'sum')}, n, 'bottom' FROM (SELECT * FROM ({CO}) ORDER BY s, code, state_id LIMIT 20)")(lambda s, d: macro.contributors(trades(s, d), 20))
register("l3_top_assets", "trades", f"SELECT code, {r('s', 'sum')} FROM (SELECT code, sum(ret_net) AS s FROM trades GROUP BY 1 ORDER BY s DESC, code LIMIT {P.top_assets})")(lambda s, d: macro.top(trades(s, d).groupBy("code").agg(F.sum("ret_net").alias("sum")), "sum", P.top_assets, "code"))
STAY = "SELECT state_id, coalesce(max(CASE WHEN regime = 'BULL' THEN P END), 0.0) AS BULL, coalesce(max(CASE WHEN regime = 'BEAR' THEN P END), 0.0) AS BEAR FROM drift WHERE state_id = next_state GROUP BY 1"
register("a26_stay_by_regime", "drift", f"SELECT state_id, {rs('BULL BEAR')}, {r('BEAR - BULL', 'delta')}, {r('abs(BEAR - BULL)', 'abs_delta')} FROM ({STAY})")(lambda s, d: macro.stay_by_regime(drift(s, d)))
cnt = lambda x: f"count(CASE WHEN regime = '{x}' THEN 1 END)"
register("a27_regime_frequency", "fsm", f"SELECT CAST(year(date) AS INT) AS year, " + ", ".join(f"{cnt(x)} AS {x}, {r(f'{cnt(x)} / count(*)', f'share_{x}')}" for x in ("BULL", "BEAR", "RECOVERY")) + " FROM fsm GROUP BY 1")(lambda s, d: macro.regime_frequency(macro_labels(s, d)))
register("a28_distribution_shift", "states", f"SELECT state_id, {rs('early late')}, {r('late - early', 'delta')} FROM (SELECT state_id, count(CASE WHEN NOT l THEN 1 END) / sum(count(CASE WHEN NOT l THEN 1 END)) OVER () AS early, count(CASE WHEN l THEN 1 END) / sum(count(CASE WHEN l THEN 1 END)) OVER () AS late FROM (SELECT state_id, (date - DATE '1970-01-01') > (SELECT quantile_cont(date - DATE '1970-01-01', 0.5) FROM states) AS l FROM states) GROUP BY 1)")(lambda s, d: macro.distribution_shift(state_rows(s, d)))
register("a29_class_distribution", "cclasses", "SELECT c.state_class, count(cclasses.state_id) AS n FROM (SELECT unnest(['INVARIANT', 'CONDITIONAL', 'TRAP', 'DEAD', 'AMBIGUOUS', 'INSUFFICIENT']) AS state_class) c LEFT JOIN cclasses USING (state_class) GROUP BY 1")(lambda s, d: macro.class_distribution(classes(s, d)))
register("a30_states_of_class", "cclasses", "SELECT state_id FROM cclasses WHERE state_class = 'INVARIANT' ORDER BY state_id")(lambda s, d: macro.states_of_class(classes(s, d), "INVARIANT"))
register("l6_top_stay", "drift", f"SELECT state_id, {r('BEAR - BULL', 'delta')} FROM ({STAY}) ORDER BY round(abs(BEAR - BULL), 9) DESC, state_id LIMIT {P.top_states}")(lambda s, d: macro.top(macro.stay_by_regime(drift(s, d)).withColumn("k", F.round("abs_delta", 9)), "k", P.top_states, "state_id").select("state_id", "delta"))
register("l5_top_kl", "kl", f"SELECT state_id, {r('kl_bull_bear')} FROM kl ORDER BY round(kl_bull_bear, 9) DESC, state_id LIMIT {P.top_states}")(lambda s, d: macro.top(macro.kl_bull_bear(drift(s, d), P).withColumn("k", F.round("kl_bull_bear", 9)), "k", P.top_states, "state_id").drop("k"))

# Hidden states

register("w16_sequences", "hid", "SELECT count(DISTINCT (code, g)) AS sequences, count(*) AS n FROM (SELECT *, sum(CASE WHEN Z_t = -1 THEN 1 ELSE 0 END) OVER (PARTITION BY code ORDER BY date) AS g FROM hid) WHERE Z_t <> -1")(
    lambda s, d: latent.sequences(dealt(hidden(s, d)).withColumn("valid", F.col("Z_t") != -1)).agg(F.countDistinct("seq_id").alias("sequences"), F.count(F.lit(1)).alias("n"))
)
register("a13_hidden_transitions", "hmat", f"SELECT z, z_next, c, {r('t')} FROM hmat")(lambda s, d: latent.transition_matrix(hidden(s, d)))
register("a14_edge_state", "hes", f"SELECT z, {r('e')}, n FROM hes")(lambda s, d: latent.edge_state(hidden(s, d)))
register("a14_edge_transition", "grid hp", f"SELECT grid.z, grid.z_next, {r('e')}, coalesce(n, 0) AS n FROM grid LEFT JOIN (SELECT Z_t, z_next, avg(r_t) AS e, count(*) AS n FROM hp WHERE r_t IS NOT NULL GROUP BY 1, 2) h ON h.Z_t = grid.z AND h.z_next = grid.z_next")(lambda s, d: latent.edge_transition(hidden(s, d)))
register("a15_identity", "hes", f"SELECT z, {r('e')}, {r('e', 'rebuilt')}, n, true AS ok FROM hes")(lambda s, d: latent.identity_check(hidden(s, d)))
lo = "(state_id // 6) % 6 IN (0, 1, 2)"
register("a33_label_scores", "hid", f"""SELECT z, n, {rs('TREND RANGE SHOCK TRANSITION')}, CASE WHEN SHOCK = m THEN 'SHOCK' WHEN TRANSITION = m THEN 'TRANSITION' WHEN TREND = m THEN 'TREND' ELSE 'RANGE' END AS label FROM (SELECT *, greatest(SHOCK, TRANSITION, TREND, RANGE) AS m FROM (SELECT *, 1 - (TREND + RANGE + SHOCK) AS TRANSITION FROM (
  SELECT Z_t AS z, count(*) AS n, avg(CASE WHEN state_id % 6 IN (0, 5) AND {lo} THEN 1.0 ELSE 0.0 END) AS TREND, avg(CASE WHEN state_id % 6 IN (2, 3) AND {lo} THEN 1.0 ELSE 0.0 END) AS RANGE, avg(CASE WHEN (state_id // 6) % 6 IN (4, 5) THEN 1.0 ELSE 0.0 END) AS SHOCK FROM hid WHERE Z_t <> -1 GROUP BY 1)))""")(lambda s, d: latent.label_scores(hidden(s, d)))

# Daily path


def _live(s: SparkSession, d: str) -> DataFrame:
    return live.live_z(live.live_features(panel(s, d), P), P)


register("w3b_live_z", "livez", f"SELECT code, date, {rs('z_r z_sigma z_v z_l z_p')} FROM livez")(lambda s, d: _live(s, d).select("code", "date", "z_r", "z_sigma", "z_v", "z_l", "z_p"))
register("w7_live_states", "lives", "SELECT code, date, z_r_bin, z_sigma_bin, z_v_bin, z_l_bin, z_p_bin, state_id FROM lives")(lambda s, d: live.live_states(_live(s, d), P).select("code", "date", "z_r_bin", "z_sigma_bin", "z_v_bin", "z_l_bin", "z_p_bin", "state_id"))


def _signals(s: SparkSession, d: str) -> DataFrame:
    edge = states.edges(states.state_table(valid_pairs(s, d), P)).where("E_raw > 0").select("state_id", F.col("E_raw").alias("edge"))
    return live.signals(state_rows(s, d).select("date", "code", "state_id"), edge, 10)


register("l2_signals", "states edge", f"SELECT date, code, '(unknown)' AS name, state_id, {r('E_raw', 'edge')}, 0.1 AS weight FROM states JOIN edge USING (state_id) WHERE E_raw > 0 AND date = (SELECT max(date) FROM states) ORDER BY E_raw DESC, code LIMIT 10")(_signals)
SIG = f"SELECT date, code, state_id, E_raw AS edge FROM states JOIN edge USING (state_id) WHERE E_raw > 0 AND date = (SELECT max(date) FROM states) ORDER BY E_raw DESC, code LIMIT 10"
register("k8_signal_json", "states edge", f"""SELECT report FROM (SELECT '{{"date":"' || strftime(max(date), '%Y-%m-%d') || '","n_signals":' || count(*) || ',"signals":[' || string_agg('{{"symbol":"' || code || '","state_id":' || state_id || ',"weight":0.1,"edge":' || CAST(round(edge, 6) AS VARCHAR) || '}}', ',' ORDER BY edge DESC, code) || ']}}' AS report FROM ({SIG}))""")(lambda s, d: live.render_json(_signals(s, d)))
register("k8_signal_text", "states edge", f"""SELECT '[' || strftime(max(date), '%Y-%m-%d') || ']' || chr(10) || '  signals: ' || count(*) || chr(10) || string_agg(printf('  BUY: %s %-10s (state=%d, edge=%+.4f, w=%.2f)', CAST(code AS VARCHAR), '(unknown)', state_id, edge, 0.1), chr(10) ORDER BY edge DESC, code) AS report FROM ({SIG})""")(lambda s, d: live.render_text(_signals(s, d)))
register("a35_previous_close", "panel", f"SELECT code, {r('arg_max(close, date)', 'prev_close')} FROM panel GROUP BY 1")(lambda s, d: live.previous_close(panel(s, d)))
register("w14_change_rate", "panel", f"SELECT code, date, {r('coalesce(close / coalesce(lag(close) OVER (PARTITION BY code ORDER BY date), prev) - 1, 0.5)', 'change_rate')} FROM panel LEFT JOIN (SELECT code, arg_max(close, date) AS prev FROM panel WHERE date < DATE '1998-01-01' GROUP BY 1) USING (code) WHERE date >= DATE '1998-01-01'")(
    lambda s, d: live.change_rate(panel(s, d).where("date >= '1998-01-01'").withColumn("change_rate", F.lit(0.5)), live.previous_close(panel(s, d).where("date < '1998-01-01'"))).select("code", "date", "change_rate")
)
register("w15_year_boundaries", "panel", f"SELECT code, date, {r('x', 'expected')} FROM (SELECT code, date, close / lag(close) OVER w - 1 AS x, year(date) <> year(lag(date) OVER w) AS first FROM panel WINDOW w AS (PARTITION BY code ORDER BY date)) WHERE first AND abs(x) > 0.01")(
    lambda s, d: live.year_boundaries(panel(s, d).withColumn("change_rate", F.lit(0.0))).select("code", "date", "expected")
)
register("s12_high_water_mark", "panel", "SELECT max(date) AS date FROM panel")(lambda s, d: panel(s, d).agg(F.max("date").alias("date")))
register("s13_clean_panel", "panel", "SELECT CAST(l_shipdate AS DATE) AS date, lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS code, round(arg_max(l_extendedprice, l_orderkey * 10 + l_linenumber), 6) + 0.0 AS close, round(arg_max(l_quantity, l_orderkey * 10 + l_linenumber), 6) + 0.0 AS volume FROM lineitem GROUP BY 1, 2")(
    lambda s, d: live.clean_panel(s.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_suppkey").alias("code"), F.col("l_shipdate").alias("date"), F.col("l_extendedprice").alias("close"), F.col("l_quantity").alias("volume"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ingest_id")))
)
register("s17_business_days", "panel", "SELECT CAST(d AS DATE) AS date FROM generate_series(DATE '2000-01-01', DATE '2000-12-31', INTERVAL 1 DAY) t(d) WHERE isodow(d) <= 5")(lambda s, d: tables.business_days(s, "2000-01-01", "2000-12-31"))
register("k3_new_rows", "panel", "SELECT date, code FROM panel WHERE date >= DATE '2000-01-01' AND (date, code) NOT IN (SELECT (date, code) FROM panel WHERE code % 2 = 0)")(lambda s, d: sinks.new_rows(panel(s, d).where("date >= '2000-01-01'"), panel(s, d).where("code % 2 = 0")).select("date", "code"))
register("u2_universe_leak", "panel", "SELECT DISTINCT code FROM panel WHERE code NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")(lambda s, d: live.leaked(panel(s, d), s.read.parquet(f"{d}/supplier.parquet").where("s_acctbal > 0").select(F.col("s_suppkey").alias("code"))))

# Sources and sinks: what is written is read again


def _written(df: DataFrame, name: str, write=None) -> str:
    path = sinks.scratch(df.sparkSession, name)
    (write or (lambda d, p: d.write.parquet(p)))(df, path)
    return path


def _raw_path(s: SparkSession, d: str) -> str:
    return _written(panel(s, d), "raw", sinks.write_by_year)


def _joined(s: SparkSession, d: str) -> DataFrame:
    """raw, states and regimes of three written tables."""
    raw = tables.read_panel(s, _raw_path(s, d), ["date", "code", "close"])
    vec = tables.read_panel(s, _written(state_rows(s, d), "states", sinks.write_state_vector), ["date", "code", "state_id"])
    reg = s.read.parquet(_written(labelled(s, d).select("date", "code", "regime").where("code % 3 > 0"), "regimes"))
    return tables.joined_panel(raw, vec, reg)


SHOWN = f"code, date, {rs('volume trade_value')}, {r('close + 1e-9', 'close')}"
shown_close = lambda df: df.withColumn("close", F.col("close") + 1e-9)
register("s1_panel_by_years", "panel", f"SELECT {SHOWN} FROM panel WHERE year(date) BETWEEN 1997 AND 1999")(lambda s, d: shown_close(tables.read_panel(s, _raw_path(s, d), ["code", "date", "close", "volume", "trade_value"], 1997, 1999)))
register("s2_state_vector", "states", f"SELECT code, date, {rs('p r sigma v l flow z_r z_sigma z_v z_flow')}, bin_r, bin_sigma, bin_v, bin_flow, state_id FROM states WHERE year(date) >= 1999")(lambda s, d: tables.read_panel(s, _written(state_rows(s, d), "states", sinks.write_state_vector), [c for c in sinks.STATE_COLUMNS if c != "close"], 1999))
register("s4_joined_panel", "states reg", f"SELECT states.code, date, {r('close + 1e-9', 'close')}, states.state_id, CASE WHEN states.code % 3 > 0 THEN regime END AS regime FROM states LEFT JOIN reg USING (state_id)")(lambda s, d: shown_close(_joined(s, d)).select("code", "date", "close", "state_id", "regime"))
register("s4_horizon_panel", "states", f"SELECT code, date, {r('lead(close, 5) OVER (PARTITION BY code ORDER BY date) / close - 1', 'ret_h')} FROM states")(lambda s, d: features.horizon_return(_joined(s, d), 5).select("code", "date", "ret_h"))
register("s7_merged", "hid", f"SELECT code, date, {r('p')}, Z_t FROM hid")(lambda s, d: tables.merge_checked(s.read.parquet(_written(hidden(s, d).select("code", "date", "p"), "p")), s.read.parquet(_written(hidden(s, d).select("code", "date", "Z_t"), "z"))))
register("s8_artifact", "fsm equity", f"SELECT date, {r('dd')}, regime FROM fsm")(lambda s, d: tables.require_domain(tables.read_artifact(s, _written(macro_labels(s, d).join(market(s, d).select("date", "equity_market"), "date"), "labels"), "regime_labels"), "regime", ["BULL", "BEAR", "RECOVERY"]).select("date", "dd", "regime"))
register("s9_universe", "panel", "SELECT DISTINCT lpad(CAST(code AS VARCHAR), 6, '0') AS code FROM panel")(lambda s, d: tables.read_universe(s, _written(panel(s, d).agg(F.to_json(F.struct(F.collect_set(F.col("code").cast("string")).alias("symbols"))).alias("value")), "universe", lambda df, p: df.write.text(p))))
register("s10_matrix", "hmat", f"SELECT CAST(z AS INT) AS i, CAST(z_next AS INT) AS j, {r('t', 'v')} FROM hmat")(lambda s, d: tables.matrix_as_long(s, np.array([x.t for x in latent.transition_matrix(hidden(s, d)).orderBy("z", "z_next").collect()]).reshape(8, 8)))
LINES = "l_orderkey * 10 + l_linenumber"
landed = lambda s, d: s.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_suppkey").alias("code"), F.to_date("l_shipdate").alias("date"), F.col("l_extendedprice").alias("price"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ingest_id"))
register("s11_landed_market", "", f"SELECT lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS code, CAST(l_shipdate AS DATE) AS date, {r('l_extendedprice', 'close')}, CAST({LINES} AS BIGINT) AS ingest_id, 'KOSPI' AS market FROM lineitem")(lambda s, d: tables.landed_market(landed(s, d), {"price": "close"}, "KOSPI"))
register("s14_first_close", "", f"SELECT l_suppkey AS code, CAST(l_shipdate AS DATE) AS date, {r(f'arg_min(l_extendedprice, {LINES})', 'close')} FROM lineitem GROUP BY 1, 2")(lambda s, d: live.first_close(landed(s, d).withColumnRenamed("price", "close")).select("code", "date", "close"))
register("s15_close_source", "panel states", f"SELECT code, date, {r('close + 1e-9', 'close')} FROM panel JOIN (SELECT code, date FROM states) USING (code, date)")(lambda s, d: shown_close(tables.close_of(labelled(s, d).drop("close"), panel(s, d)).join(state_rows(s, d).select("code", "date").hint("merge"), ["code", "date"])).select("code", "date", "close"))
register("s16_live_inputs", "states edge", f"SELECT states.date, code, state_id, {r('round(E_raw, 4)', 'edge')} FROM states JOIN edge USING (state_id) WHERE E_raw > 0 AND visits >= {P.min_visits}")(lambda s, d: _live_inputs(s, d))


def _live_inputs(s: SparkSession, d: str) -> DataFrame:
    """Rows of written states with their priorities out of a written configuration."""
    edge = states.edges(states.state_table(valid_pairs(s, d), P)).where(f"E_raw > 0 and visits >= {P.min_visits}").select("state_id", F.round("E_raw", 4).alias("e")).collect()
    with tempfile.NamedTemporaryFile("w", suffix=".json") as f:
        json.dump({"state_priority": {str(x.state_id): x.e for x in edge}, "tradeable_states": [x.state_id for x in edge]}, f)
        f.flush()
        rows, priorities, _, _ = tables.live_inputs(s, _written(state_rows(s, d).select("date", "code", "state_id"), "live"), f.name)
    return rows.join(priorities, "state_id").select("date", "code", "state_id", "edge")


register("k2_tables", "trans stats", f"SELECT s AS state_id, s_next, n, {r('p')}, visits FROM trans JOIN stats ON stats.state_id = trans.s")(lambda s, d: _tables_again(s, d))


def _tables_again(s: SparkSession, d: str) -> DataFrame:
    path = sinks.scratch(s, "tables")
    sinks.write_tables({"transitions": states.transitions(valid_pairs(s, d)), "state_table": states.state_table(valid_pairs(s, d), P)}, path)
    return s.read.parquet(f"{path}/transitions").withColumnRenamed("s", "state_id").join(s.read.parquet(f"{path}/state_table").select("state_id", "visits"), "state_id")


def _meta(s: SparkSession, d: str) -> DataFrame:
    """Counts of the hidden chain as a written JSON file has them, a missing edge as null."""
    path, edge = sinks.scratch(s, "meta"), latent.edge_state(hidden(s, d)).orderBy("z").collect()
    sinks.write_meta(s, path, {"k": len(edge), "pairs": sum(x.n for x in edge), "E": [float("nan") if x.e is None else x.e for x in edge]})
    meta = tables.read_meta(s, path)
    return s.createDataFrame([(z, meta["k"], meta["pairs"], e) for z, e in enumerate(meta["E"])], "z long, k long, pairs long, e double")


register("k4_meta", "hes", f"SELECT z, CAST(8 AS BIGINT) AS k, CAST((SELECT sum(n) FROM hes) AS BIGINT) AS pairs, {r('e')} FROM hes")(_meta)


def _appended(s: SparkSession, d: str) -> DataFrame:
    """A panel that was appended in two parts that overlap, the second one twice."""
    path, rows = sinks.scratch(s, "appended"), panel(s, d)
    for part in ("date < '1999-01-01'", "date >= '1998-06-01'", "date >= '1998-06-01'"):
        sinks.append_new(rows.where(part), path)
    return tables.read_panel(s, path, ["code", "date", "close", "volume", "trade_value"])


register("k3_appended", "panel", f"SELECT {SHOWN} FROM panel")(lambda s, d: shown_close(_appended(s, d)))
register("k7_report", "trades", f"SELECT regime, {SUM} FROM trades GROUP BY 1")(lambda s, d: s.createDataFrame([(x["regime"], x["n"], float(x["sum"]), float(x["mean"]), float(x["std"])) for x in json.loads(sinks.report_json({"by_regime": macro.summary(trades(s, d), "regime")}))["by_regime"]], "regime string, n long, sum double, mean double, std double"))
register("k10_dry_run", "states", "SELECT count(*) AS n, CAST(0 AS BIGINT) AS written FROM states")(lambda s, d: _dry(s, d))


def _dry(s: SparkSession, d: str) -> DataFrame:
    path = sinks.scratch(s, "dry")
    out = sinks.write_state_vector(state_rows(s, d), path, dry=True)
    p = s._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(s._jsparkSession.sessionState().newHadoopConf()).exists(p)
    return out.agg(F.count(F.lit(1)).alias("n")).withColumn("written", F.lit(int(there)).cast("long"))


# Formulas

register("d1_ev_surface", "mtr", f"SELECT state_id, macro_regime AS macro, count(*) AS n, {r('avg(ret_net)', 'ev')}, {r('stddev_samp(ret_net) / sqrt(count(*))', 'se')}, {r('CASE WHEN stddev_samp(ret_net) > 0 THEN avg(ret_net) / (stddev_samp(ret_net) / sqrt(count(*))) END', 't')} FROM mtr GROUP BY 1, 2")(lambda s, d: surfaces.ev_surface(trades(s, d), macro_labels(s, d)))
register("d3_positive_set", "hes", f"SELECT z, n, {r('n / (SELECT sum(n) FROM hes)', 'coverage')} FROM hes WHERE e > 0")(lambda s, d: surfaces.positive_set(latent.edge_state(hidden(s, d))))
register("d4_stability", "hes hmat", f"SELECT z, {r('s')}, {r('1 - s', 'leakage')}, {r('s / (1 - s)', 'attractor')} FROM (SELECT z, sum(t) AS s FROM hmat WHERE z IN (SELECT z FROM hes WHERE e > 0) AND z_next IN (SELECT z FROM hes WHERE e > 0) GROUP BY 1)")(lambda s, d: surfaces.stability(latent.transition_matrix(hidden(s, d)), surfaces.positive_set(latent.edge_state(hidden(s, d)))))
register("d7_ev_variants", "hes hmat", f"""SELECT z, true AS a, e > {P.cost} AS b, e > {P.cost / P.horizon} AS c, row_number() OVER (ORDER BY e * s DESC, z) AS d_rank, s > 0.5 AND e > {P.cost / P.horizon} AS e, s > 0.5 AND e > {P.cost} AS f, row_number() OVER (ORDER BY e DESC, z) <= 3 AS g
  FROM (SELECT * FROM hes WHERE e > 0) JOIN (SELECT z, sum(t) AS s FROM hmat WHERE z IN (SELECT z FROM hes WHERE e > 0) AND z_next IN (SELECT z FROM hes WHERE e > 0) GROUP BY 1) USING (z)""")(
    lambda s, d: surfaces.ev_variants(latent.edge_state(hidden(s, d)), surfaces.stability(latent.transition_matrix(hidden(s, d)), surfaces.positive_set(latent.edge_state(hidden(s, d)))), P.cost, P.horizon)
)
register("d8_equal_weights", "hes hid", f"SELECT date, code, {r('1.0 / count(*) OVER (PARTITION BY date)', 'weight')} FROM hid WHERE Z_t IN (SELECT z FROM hes WHERE e > 0)")(lambda s, d: surfaces.equal_weights(hidden(s, d), surfaces.positive_set(latent.edge_state(hidden(s, d)))))
half = lambda x: f"SELECT Z_t, count(*) / sum(count(*)) OVER () AS {x} FROM hid WHERE {'date < ' if x == 'a' else 'date >= '} DATE '{P.test_start}' GROUP BY 1"
register("d12_psi", "hid", f"SELECT {r('sum((b - a) * ln(b / a))', 'psi')} FROM (SELECT greatest(coalesce(a, 0.0), 1e-6) AS a, greatest(coalesce(b, 0.0), 1e-6) AS b FROM ({half('a')}) FULL JOIN ({half('b')}) USING (Z_t))")(
    lambda s, d: surfaces.psi(hidden(s, d).where(F.col("date") < F.lit(P.test_start).cast("date")), hidden(s, d).where(F.col("date") >= F.lit(P.test_start).cast("date")), "Z_t")
)
register("d12_ks", "states", f"SELECT {r('max(abs(ca / ta - cb / tb))', 'ks')} FROM (SELECT sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER () AS ta, sum(b) OVER () AS tb FROM (SELECT z_r, count(CASE WHEN date < DATE '{P.test_start}' THEN 1 END) AS a, count(CASE WHEN date >= DATE '{P.test_start}' THEN 1 END) AS b FROM states GROUP BY 1) WINDOW w AS (ORDER BY z_r))")(
    lambda s, d: surfaces.ks(state_rows(s, d).where(F.col("date") < F.lit(P.test_start).cast("date")), state_rows(s, d).where(F.col("date") >= F.lit(P.test_start).cast("date")), "z_r")
)
register("d9_occupancy", "states", f"SELECT state_id, {rs('before after')}, {r('abs(after - before)', 'drift')} FROM (SELECT state_id, count(CASE WHEN date < DATE '{P.test_start}' THEN 1 END) / sum(count(CASE WHEN date < DATE '{P.test_start}' THEN 1 END)) OVER () AS before, count(CASE WHEN date >= DATE '{P.test_start}' THEN 1 END) / sum(count(CASE WHEN date >= DATE '{P.test_start}' THEN 1 END)) OVER () AS after FROM states GROUP BY 1)")(lambda s, d: surfaces.occupancy(state_rows(s, d), P.test_start))
five = ", ".join(f"round(({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER (), 5) + 0.0 AS g_{c}" for c in ("r", "sigma", "v", "flow", "calm"))
register("d14_five_state", "feats", f"SELECT code, date, {five} FROM (SELECT code, date, r, sigma, v, flow, 1 / (abs(r) + 1e-8) AS calm FROM feats WHERE r IS NOT NULL AND sigma IS NOT NULL AND flow IS NOT NULL)", 5)(lambda s, d: surfaces.five_state(features.raw_features(panel(s, d), P)))
register("d17_top_scores", "lab", f"SELECT date, code, {r('total')}, place FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY total DESC, code) AS place FROM (SELECT date, code, round(z_r, 9) + CASE regime WHEN 'TREND' THEN 0.5 WHEN 'SHOCK' THEN -1.0 ELSE 0.0 END AS total FROM lab)) WHERE place <= 5")(
    lambda s, d: surfaces.top_scores(labelled(s, d).withColumn("score", F.round("z_r", 9)), {"TREND": 0.5, "SHOCK": -1.0}).select("date", "code", "total", F.col("place").cast("long").alias("place"))
)
register("d18_positions", "states", "SELECT position, count(*) AS n FROM (SELECT coalesce(last_value(x IGNORE NULLS) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'FLAT') AS position FROM (SELECT code, date, CASE WHEN z_r >= 1 THEN 'LONG' WHEN z_r < -1 THEN 'FLAT' END AS x FROM states)) GROUP BY 1")(
    lambda s, d: surfaces.positions(state_rows(s, d).withColumn("score", F.col("z_r")), 1.0, -1.0).groupBy("position").agg(F.count(F.lit(1)).alias("n"))
)
register("d19_snapshot", "panel", f"SELECT code, date, {r('max(close) OVER w / close - 1', 'max_up')}, {r('min(close) OVER w / close - 1', 'max_drawdown')} FROM panel WINDOW w AS (PARTITION BY code ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING)")(lambda s, d: surfaces.snapshot(panel(s, d), 20))
KW = "exp(-((a.z_r - x.z_r) * (a.z_r - x.z_r) + (a.z_v - x.z_v) * (a.z_v - x.z_v)))"


def _kernel_sql() -> str:
    from . import oracles as o

    o.cte("kn", "states", "SELECT code, date, z_r, z_v, r AS f, row_number() OVER (PARTITION BY code ORDER BY date) AS k FROM states")
    o.cte("ke", "kn", f"SELECT a.code, a.date, sum({KW} * x.f) / sum(CASE WHEN x.f IS NOT NULL THEN {KW} END) AS edge, sum({KW} * x.f * x.f) / sum(CASE WHEN x.f IS NOT NULL THEN {KW} END) AS sq FROM kn a LEFT JOIN kn x ON x.code = a.code AND x.k BETWEEN a.k - 20 AND a.k - 1 GROUP BY 1, 2")
    return f"SELECT code, date, {r('edge')}, {r('greatest(sq - edge * edge, 0.0)', 'var')} FROM ke"


def _kernel(s: SparkSession, d: str) -> DataFrame:
    return surfaces.kernel_edge(state_rows(s, d), ["z_r", "z_v"], "r", 20)


_ks = _kernel_sql()
register("d20_kernel_edge", "ke", _ks)(lambda s, d: _kernel(s, d).select("code", "date", "edge", "var"))
register("d21_long_run", "ke fwd", f"SELECT {r('corr(edge, next_r)', 'corr')}, {r('avg(CASE WHEN edge - sqrt(var) > 0 THEN next_r END)', 'entry_mean')}, count(CASE WHEN edge - sqrt(var) > 0 THEN 1 END) AS entries FROM (SELECT *, greatest(sq - edge * edge, 0.0) AS var FROM ke) k JOIN fwd USING (code, date)")(
    lambda s, d: surfaces.long_run(_kernel(s, d).join(forward_rows(s, d).select("code", "date", F.col("next_r").alias("f")).hint("merge"), ["code", "date"]))
)
register("d13_occupancy_change", "hid", f"""SELECT date, z, {rs('recent usual')}, round(abs(recent - usual), 9) > 0.1 AS changed FROM (SELECT date, z, avg(x) OVER (PARTITION BY z ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS recent, avg(x) OVER (PARTITION BY z ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS usual
  FROM (SELECT date, z, coalesce(n, 0) / a AS x FROM (SELECT date, count(*) AS a FROM hid WHERE Z_t <> -1 GROUP BY 1) CROSS JOIN (SELECT range AS z FROM range(8)) LEFT JOIN (SELECT date, Z_t AS z, count(*) AS n FROM hid WHERE Z_t <> -1 GROUP BY 1, 2) USING (date, z)))""")(lambda s, d: surfaces.occupancy_change(hidden(s, d)))
register("d2_transition_filter", "kl stats", f"SELECT state_id, {rs('kl_bull_bear p_stay')} FROM kl JOIN stats USING (state_id) WHERE kl_bull_bear > (SELECT quantile_cont(kl_bull_bear, 0.9) FROM kl) AND p_stay < 0.5")(lambda s, d: surfaces.transition_filter(macro.kl_bull_bear(drift(s, d), P), states.state_stats(valid_pairs(s, d), P).select("state_id", "p_stay")))
register("d2_mask", "reg cdec cclasses", f"""SELECT state_id, CAST(coalesce(mu_r_raw > 0 AND visits >= {P.min_visits} AND t >= {P.t_least} AND state_class IN ('INVARIANT', 'CONDITIONAL') AND regime IN ('TREND', 'RANGE'), false) AS BIGINT) AS mask
  FROM reg LEFT JOIN (SELECT state_id, max(abs(t_one_sample)) AS t FROM cdec GROUP BY 1) USING (state_id) LEFT JOIN cclasses USING (state_id)""")(
    lambda s, d: surfaces.tradeable_mask(states.state_table(valid_pairs(s, d), P), macro.state_decomposition(holdings(s, d), class_labels(s, d), CLASSES), classes(s, d), P)
)
register("d2_edge_field", "cmtr", f"SELECT state_id, macro, {r('ev')}, {r('(ev - avg(ev) OVER w) / nullif(stddev_samp(ev) OVER w, 0)', 'ev_z')} FROM (SELECT state_id, macro_regime AS macro, avg(ret_net) AS ev FROM cmtr GROUP BY 1, 2) WINDOW w AS (PARTITION BY macro)")(lambda s, d: surfaces.edge_field(surfaces.ev_surface(holdings(s, d), class_labels(s, d))))
register("d10_fold_variation", "metf", f"SELECT {r('avg(sharpe)', 'mean')}, {r('stddev_samp(sharpe)', 'std')}, {r('stddev_samp(sharpe) / avg(sharpe)', 'cv')} FROM metf")(lambda s, d: surfaces.variation(strategy.walk_forward(labelled(s, d), P), "sharpe"))
register("d10_aggregation_rule", "metf", f"SELECT {r('avg(sharpe)', 'mean_sharpe')}, {r('min(sharpe)', 'worst_sharpe')}, CAST(sum(CAST(passed AS INT)) AS BIGINT) AS n_passed, coalesce(avg(sharpe) > 1.806 AND min(sharpe) > 0 AND sum(CAST(passed AS INT)) >= 4, false) AS passed FROM metf")(lambda s, d: surfaces.aggregation_rule(strategy.walk_forward(labelled(s, d), P)))
register("d11_bear_exposure", "hid hes equity", f"SELECT date, {r('score')}, CAST(CASE WHEN score > 0.5 THEN 0.0 WHEN dd <= -0.1 THEN 0.5 ELSE 1.0 END AS DOUBLE) AS exposure FROM (SELECT date, avg(CASE WHEN coalesce(e, 0.0) < 0 THEN 1.0 ELSE 0.0 END) AS score FROM hid JOIN hes ON Z_t = z GROUP BY 1) LEFT JOIN equity USING (date)")(
    lambda s, d: surfaces.bear_exposure(hidden(s, d), latent.edge_state(hidden(s, d)), market(s, d))
)


def _half_labels(s: SparkSession, d: str, late: bool) -> DataFrame:
    after = F.col("date") >= F.lit(P.test_start).cast("date")
    return latent.label_scores(hidden(s, d).where(after if late else ~after))


def _calibration_sql() -> str:
    from . import oracles as o

    lab = lambda when: f"SELECT z, CASE WHEN SHOCK = m THEN 'SHOCK' WHEN TRANSITION = m THEN 'TRANSITION' WHEN TREND = m THEN 'TREND' ELSE 'RANGE' END AS label FROM (SELECT *, greatest(SHOCK, TRANSITION, TREND, RANGE) AS m FROM (SELECT *, 1 - (TREND + RANGE + SHOCK) AS TRANSITION FROM (SELECT Z_t AS z, avg(CASE WHEN state_id % 6 IN (0, 5) AND {lo} THEN 1.0 ELSE 0.0 END) AS TREND, avg(CASE WHEN state_id % 6 IN (2, 3) AND {lo} THEN 1.0 ELSE 0.0 END) AS RANGE, avg(CASE WHEN (state_id // 6) % 6 IN (4, 5) THEN 1.0 ELSE 0.0 END) AS SHOCK FROM hid WHERE Z_t <> -1 AND {when} GROUP BY 1)))"
    o.cte("wts", "hid hes", "SELECT date, code, 1.0 / count(*) OVER (PARTITION BY date) AS w FROM hid WHERE Z_t IN (SELECT z FROM hes WHERE e > 0)")
    o.cte("wtd", "wts", "SELECT code, w, dense_rank() OVER (ORDER BY date) AS day FROM wts")
    o.cte("wtn", "wtd", "SELECT day, sum(abs(w)) / 2 AS turnover FROM (SELECT day, code, sum(w) AS w FROM (SELECT day, code, w FROM wtd UNION ALL SELECT day + 1, code, -w FROM wtd) GROUP BY 1, 2) GROUP BY 1")
    split = f"DATE '{P.test_start}'"
    gates = [
        f"SELECT 'CAL-1' AS gate, avg(CASE WHEN a.label IS NOT DISTINCT FROM b.label THEN 0.0 ELSE 1.0 END) AS value, 0.05 AS lim FROM ({lab(f'date < {split}')}) a FULL JOIN ({lab(f'date >= {split}')}) b USING (z)",
        f"SELECT 'CAL-2', avg(turnover) * {P.ann} * {P.cost}, 0.03 FROM wtn WHERE day <= (SELECT max(day) FROM wtd)",
        f"SELECT 'CAL-3', max(abs(b - a)), 0.15 FROM (SELECT count(CASE WHEN date < {split} THEN 1 END) / sum(count(CASE WHEN date < {split} THEN 1 END)) OVER () AS a, count(CASE WHEN date >= {split} THEN 1 END) / sum(count(CASE WHEN date >= {split} THEN 1 END)) OVER () AS b FROM hid WHERE Z_t <> -1 GROUP BY Z_t)",
        "SELECT 'CAL-4', avg(CASE WHEN date IN (SELECT date FROM wts) THEN 0.0 ELSE 1.0 END), 0.05 FROM (SELECT DISTINCT date FROM hid)",
    ]
    return f"SELECT gate, {r('value')}, {r('lim', 'limit_')}, value < lim AS passed FROM ({' UNION ALL '.join(gates)})"


_cal = _calibration_sql()
register("d9_calibration", "hid hes wts wtd wtn", _cal)(
    lambda s, d: surfaces.calibration(_half_labels(s, d, False), _half_labels(s, d, True), surfaces.equal_weights(hidden(s, d), surfaces.positive_set(latent.edge_state(hidden(s, d)))), hidden(s, d), hidden(s, d), P.test_start, P).withColumnRenamed("limit", "limit_")
)

# Learned models: the chain of clusters, hidden states, labels, transitions and edges; invariants are compared instead of ids


@shared
def clustered(spark: SparkSession, sf: str) -> DataFrame:
    """All rows, warm-up included, with C_t, -1 where a z-score is missing."""
    zs = [f"z_{c}" for c in features.Z]
    rows = features.valid_mask(features.state_vector(panel(spark, sf), P), zs).select("code", "date", "p", "state_id", *zs, "valid")
    return latent.kmeans(sinks.written(rows, "scores"), zs, P.latent).select("code", "date", "p", "state_id", *zs, "valid", "C_t")


@shared
def regimes(spark: SparkSession, sf: str) -> DataFrame:
    """code, date, p, state_id, C_t, Z_t, R_t of all rows: HMM, Viterbi, labels."""
    rows = clustered(spark, sf)
    seqs = latent.sequences(rows).select("seq_id", "code", "date", "C_t")
    found = chains.decode(seqs, latent.fit_hmm(seqs, P.latent, P.latent))
    rows = rows.select("code", "date", "p", "state_id", "C_t").join(found.hint("merge"), ["code", "date"], "left").withColumn("Z_t", F.coalesce("Z_t", F.lit(-1)))
    return latent.apply_labels(rows, latent.label_scores(rows))


def _nearest_share(s: SparkSession, d: str) -> DataFrame:
    """Of the rows in clusters, the share whose own cluster's mean is the nearest of all means."""
    zs, rows = [f"z_{c}" for c in features.Z], clustered(s, d)
    means = rows.where("valid").groupBy("C_t").agg(*(F.avg(c).alias(c) for c in zs)).agg(F.collect_list(F.struct("C_t", *zs)).alias("means"))
    gap = lambda m: sum(((m[c] - F.col(c)) * (m[c] - F.col(c)) for c in zs), F.lit(0.0))
    best = F.array_min(F.transform("means", lambda m: F.struct(gap(m).alias("gap"), m["C_t"].alias("c"))))["c"]
    return rows.crossJoin(F.broadcast(means)).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("valid").alias("n_valid"), F.count_if(F.col("C_t") >= 0).alias("n_clustered"), F.countDistinct(F.when(F.col("valid"), F.col("C_t"))).alias("clusters"), F.round(F.avg(F.when(F.col("valid"), (best == F.col("C_t")).cast("double"))), 2).alias("nearest")
    )


OK = " AND ".join(f"z_{c} IS NOT NULL" for c in features.Z)
register("m1_kmeans", "zs", f"SELECT count(*) AS n, count(CASE WHEN {OK} THEN 1 END) AS n_valid, count(CASE WHEN {OK} THEN 1 END) AS n_clustered, CAST(8 AS BIGINT) AS clusters, CAST(1.0 AS DOUBLE) AS nearest FROM zs")(_nearest_share)
register("m2_hmm_states", "zs", f"SELECT count(*) AS n, count(CASE WHEN {OK} THEN 1 END) AS n_decoded, CAST(0 AS BIGINT) AS outside FROM zs")(
    lambda s, d: regimes(s, d).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("Z_t") >= 0).alias("n_decoded"), F.count_if(~F.col("Z_t").between(-1, P.latent - 1)).alias("outside"))
)
register("m3_hidden_transitions", "zs", f"SELECT count(CASE WHEN ok AND next THEN 1 END) AS pairs, CAST(64 AS BIGINT) AS cells, CAST(0 AS BIGINT) AS bad FROM (SELECT ok, lead(ok) OVER (PARTITION BY code ORDER BY date) AS next FROM (SELECT code, date, {OK} AS ok FROM zs))")(
    lambda s, d: (m := latent.transition_matrix(regimes(s, d), P.latent)).agg(F.sum("c").alias("pairs"), F.count(F.lit(1)).alias("cells")).crossJoin(
        m.groupBy("z").agg(F.sum("t").alias("t"), F.sum("c").alias("c"), F.min("t").alias("least")).agg(F.count_if((F.abs(F.col("t") - F.when(F.col("c") > 0, 1.0).otherwise(0.0)) > 1e-9) | (F.col("least") < 0)).alias("bad"))
    )
)
register("m4_edges", "zs", f"SELECT count(CASE WHEN ok AND next AND p + np IS NOT NULL THEN 1 END) AS n, CAST(8 AS BIGINT) AS states, CAST(8 AS BIGINT) AS ok FROM (SELECT ok, p, lead(p) OVER w AS np, lead(ok) OVER w AS next FROM (SELECT code, date, p, {OK} AS ok FROM zs) WINDOW w AS (PARTITION BY code ORDER BY date))")(
    lambda s, d: latent.identity_check(regimes(s, d), P.latent).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("states"), F.count_if("ok").alias("ok"))
)
register("m5_labels", "zs", f"SELECT count(*) AS n, count(CASE WHEN {OK} THEN 1 END) AS n_labelled, CAST(0 AS BIGINT) AS odd, CAST(0 AS BIGINT) AS unknown FROM zs")(
    lambda s, d: regimes(s, d).agg(F.count(F.lit(1)).alias("n"), F.count("R_t").alias("n_labelled"), F.count_if((F.col("Z_t") == -1) != F.col("R_t").isNull()).alias("odd"), F.count_if(~F.col("R_t").isin(*latent.LABELS)).alias("unknown"))
)


def _stationary(s: SparkSession, d: str) -> DataFrame:
    cells = latent.transition_matrix(regimes(s, d), P.latent).orderBy("z", "z_next").collect()
    t = np.array([c.t for c in cells]).reshape(P.latent, P.latent)
    pi = latent.stationary(t)
    moved = pi @ t - pi if np.allclose(t.sum(1), 1) else 0 * pi
    return s.createDataFrame([(round(float(pi.sum()), 6), round(float(np.abs(moved).max()), 6), len(pi))], "total double, moved double, states long")


register("m4_stationary", "", "SELECT CAST(1.0 AS DOUBLE) AS total, CAST(0.0 AS DOUBLE) AS moved, CAST(8 AS BIGINT) AS states")(_stationary)
register("d16_gmm")(lambda s, d: surfaces.gmm_regimes(state_rows(s, d).select("code", "date", "z_r", "z_sigma"), ["z_r", "z_sigma"]).groupBy("regime").agg(F.count(F.lit(1)).alias("n")))


def queries() -> dict[str, Query]:
    from . import crossval, incremental, stored  # noqa: F401  register their own

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import crossval, incremental, stored  # noqa: F401

    return dict(ORACLES)
