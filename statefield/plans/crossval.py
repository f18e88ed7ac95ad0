"""Queries of cross-validation over regimes and of what a fold's result is made of."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import TABLES as P
from ..operators import folds, strategy
from ..operators.features import horizon_return
from .catalog import class_labels, labelled, register, rs, shared
from .oracles import cte, greedy, identify, r

#: Folds, dates of a block, and the share of SHOCK rows that makes a date one; the driver's tables are noise, so it is low.
K, LENGTH, SHOCK = 4, 120, 0.3


def crossval_ctes() -> None:
    cte("mk", "lab cfsm", f"SELECT date, CASE WHEN x >= {SHOCK} THEN 'SHOCK' WHEN cfsm.regime = 'BEAR' THEN 'BEAR' ELSE 'BULL' END AS market FROM (SELECT date, avg(CASE WHEN regime = 'SHOCK' THEN 1.0 ELSE 0.0 END) AS x FROM lab GROUP BY 1) LEFT JOIN cfsm USING (date)")
    cte("mkp", "mk", f"SELECT *, (row_number() OVER (ORDER BY date) - 1) // {LENGTH} AS block FROM mk")
    cte("mkb", "mkp", "SELECT block, market AS main, n FROM (SELECT *, row_number() OVER (PARTITION BY block ORDER BY n DESC, market) AS k FROM (SELECT block, market, count(*) AS n FROM mkp GROUP BY ALL)) WHERE k = 1")
    cte("mkd", "mkb", "SELECT *, row_number() OVER (PARTITION BY main ORDER BY n DESC, block) - 1 AS i, (SELECT count(*) FROM mkb x WHERE x.main < mkb.main) AS o FROM mkb")
    cte("mkf", "mkp mkd", f"SELECT date, market, block, main, CAST((CASE WHEN (i // {K}) % 2 = 0 THEN i % {K} ELSE {K - 1} - i % {K} END + o) % {K} AS INT) AS fold FROM mkp JOIN mkd USING (block)")
    cte("known", "hor", "SELECT * FROM hor WHERE ret_h IS NOT NULL")
    cte("te", "mkf known", "SELECT fold, date, last FROM mkf LEFT JOIN (SELECT date, max(exit_date) AS last FROM known GROUP BY 1) USING (date)")
    overlap = "te.date BETWEEN k.date AND k.exit_date OR (te.date < k.date AND te.last >= k.date)"
    cte("lost", "known te", f"SELECT DISTINCT te.fold, k.date, k.exit_date FROM (SELECT DISTINCT date, exit_date FROM known) k JOIN te ON {overlap}")
    cte("trainr", "known lost", f"SELECT * FROM (SELECT CAST(range AS INT) AS fold, known.* FROM known, range({K})) ANTI JOIN lost USING (fold, date, exit_date)")
    cte("pickr", "trainr", identify("trainr", "ret_h", "fold, "))
    cte("candr", "known mkf pickr", "SELECT fold, code, date, exit_date, state_id, regime, ret_h FROM (SELECT fold, known.* FROM known JOIN mkf USING (date)) SEMI JOIN (SELECT fold, state_id FROM pickr WHERE tradeable) USING (fold, state_id)")
    cte("tradesr0", "candr", greedy("candr").replace("@", "tradesr0"))
    cte("tradesr", "tradesr0", f"SELECT fold, date AS entry_date, exit_date, code, state_id, regime, ret_h AS ret_gross, ret_h - {P.cost} AS ret_net FROM tradesr0")
    cte("mtrf", "tradesf mk", "SELECT tradesf.*, market FROM tradesf JOIN mk ON mk.date = entry_date")
    mean = lambda keys: f"CASE WHEN sum(n) OVER {keys[0]} > sum(n) OVER {keys[1]} THEN (sum(gross) OVER {keys[0]} - sum(gross) OVER {keys[1]}) / (sum(n) OVER {keys[0]} - sum(n) OVER {keys[1]}) END"
    cte("fc0", "mtrf", "SELECT fold, state_id, market, count(*) AS n, sum(ret_gross) AS gross, sum(ret_net) AS net FROM mtrf GROUP BY ALL")
    cte("fc1", "fc0", f"SELECT *, coalesce({mean(('()', '(PARTITION BY fold)'))}, 0.0) AS a, {mean(('(PARTITION BY market)', '(PARTITION BY fold, market)'))} AS m, {mean(('(PARTITION BY state_id, market)', '(PARTITION BY fold, state_id, market)'))} AS s FROM fc0")
    cte("fc", "fc1", "SELECT fold, state_id, market, n, net, gross - net AS cost, n * a AS expected, n * (m - a) AS regime, n * (s - m) AS state, gross - n * s AS own FROM (SELECT fold, state_id, market, n, gross, net, a, coalesce(m, a) AS m, coalesce(s, m, a) AS s FROM fc1)")
    sums = ", ".join(f"sum({c}) AS {c}" for c in ("n", "net", "cost", "expected", "regime", "state", "own"))
    cte("fp", "fc metf", f"SELECT fold, sharpe, worst, f.* EXCLUDE (fold) FROM (SELECT fold, sharpe, sharpe IS NOT NULL AND row_number() OVER (ORDER BY sharpe NULLS LAST, fold) = 1 AS worst FROM metf) JOIN (SELECT fold, {sums} FROM fc GROUP BY 1) f USING (fold)")


crossval_ctes()


def blocks(s: SparkSession, d: str) -> DataFrame:
    return folds.regime_blocks(folds.market_regimes(labelled(s, d), class_labels(s, d), SHOCK), K, LENGTH)


@shared
def regime_trades(s: SparkSession, d: str) -> DataFrame:
    return folds.regime_trades(horizon_return(labelled(s, d), P.horizon), blocks(s, d), K, P)


@shared
def fold_trades(s: SparkSession, d: str) -> DataFrame:
    return strategy.fold_trades(labelled(s, d), P)


def cells(s: SparkSession, d: str) -> DataFrame:
    markets = folds.market_regimes(labelled(s, d), class_labels(s, d), SHOCK).withColumnRenamed("date", "entry_date")
    return folds.fold_cells(fold_trades(s, d).join(F.broadcast(markets), "entry_date"))


def parts(s: SparkSession, d: str) -> DataFrame:
    return folds.fold_parts(cells(s, d), strategy.walk_forward(labelled(s, d), P, trades=fold_trades(s, d)))


def _cv(by: str) -> str:
    keys = f"fold{by}"
    stats = f"n_days, n_markets, coalesce(n_trades, 0) AS n_trades, {rs('mean std sum hit_rate')}, {r(f'CASE WHEN std > 0 THEN mean / std * sqrt({P.ann / P.horizon}) END', 'sharpe_ann')}"
    days = f"SELECT {keys}, count(*) AS n_days, count(DISTINCT market) AS n_markets FROM mkf GROUP BY ALL"
    earned = f"SELECT tradesr.fold{by}, count(*) AS n_trades, avg(ret_net) AS mean, stddev_samp(ret_net) AS std, sum(ret_net) AS sum, avg(CASE WHEN ret_net > 0 THEN 1.0 ELSE 0.0 END) AS hit_rate FROM tradesr JOIN (SELECT date AS entry_date, market FROM mkf) USING (entry_date) GROUP BY ALL"
    return f"SELECT {keys}, {stats} FROM ({days}) LEFT JOIN ({earned}) USING ({keys})"


CELL = "cost expected regime state own"
register("d10_regime_blocks", "mkf", "SELECT date, market, block, main, fold FROM mkf")(lambda s, d: blocks(s, d))
register("d10_purged_selection", "pickr", f"SELECT fold, state_id, visits, {rs('mu_r sigma_r')}, regime, {r('t_stat')}, tradeable FROM pickr")(
    lambda s, d: folds.identify_purged(known(s, d), "ret_h", folds.purge_limits(blocks(s, d), known(s, d), K), K, P).select("fold", "state_id", "visits", "mu_r", "sigma_r", "regime", "t_stat", "tradeable")
)
register("d10_regime_cv", "tradesr mkf", _cv(", market"))(lambda s, d: folds.regime_cv(regime_trades(s, d), blocks(s, d), P, "market"))
register("d10_regime_folds", "tradesr mkf", _cv(""))(lambda s, d: folds.regime_cv(regime_trades(s, d), blocks(s, d), P))
register("d10_fold_parts", "fp", f"SELECT CAST(fold AS INT) AS fold, {r('sharpe')}, worst, CAST(n AS BIGINT) AS n, {rs('net ' + CELL)} FROM fp")(parts)
register("d10_worst_fold", "fc fp", f"""SELECT CAST(fold AS INT) AS fold, state_id, market, n, {rs('net ' + CELL)}, {r('CASE WHEN total < 0 THEN least(net, 0) / total ELSE 0.0 END', 'share')}, row_number() OVER (ORDER BY round(net, 9), state_id, market) AS place
  FROM (SELECT *, sum(least(net, 0)) OVER () AS total FROM fc WHERE fold = (SELECT fold FROM fp WHERE worst))""")(lambda s, d: folds.losses(cells(s, d), parts(s, d)).withColumn("place", F.col("place").cast("long")))


def known(s: SparkSession, d: str) -> DataFrame:
    return horizon_return(labelled(s, d), P.horizon).where("ret_h is not null")
