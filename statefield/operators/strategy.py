"""State selection, trades, portfolio paths and their metrics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Params
from ..functions.columns import deviation, ratio, spread, trailing
from .features import daily_return, horizon_return


def identify(train: DataFrame, ret: str, p: Params = DEFAULT, *by: str) -> DataFrame:
    """Statistics of each state over training rows, with `tradeable` (A8, A9). by: further keys, such as the fold."""
    stats = train.where(F.col("state_id").isNotNull()).groupBy(*by, "state_id").agg(
        F.count(F.lit(1)).alias("visits"), F.avg(ret).alias("mu_r"), deviation(F.col(ret)).alias("sigma_r"), F.mode("regime", True).alias("regime")
    )
    return marked(stats, p)


def marked(stats: DataFrame, p: Params) -> DataFrame:
    """stats with t_stat and tradeable."""
    t = ratio(F.col("mu_r"), ratio(F.col("sigma_r"), F.sqrt(F.col("visits"))))
    good = (F.col("mu_r") > 0) & (F.col("visits") >= p.min_visits) & (F.col("t_stat") >= p.t_least) & F.col("regime").isin(*p.regimes)
    return stats.withColumn("t_stat", t).withColumn("tradeable", F.coalesce(good, F.lit(False)))


def chosen(stats: DataFrame, *by: str) -> DataFrame:
    return stats.where("tradeable").select(*by, "state_id")


def one_day_backtest(test: DataFrame, picked: DataFrame, cost: float = DEFAULT.cost, ret: str = "next_r", *by: str) -> DataFrame:
    """Overlapping equal-weight portfolio of all entries of a day; the cost is charged each day."""
    entries = test.join(picked, [*by, "state_id"], "left_semi").where(F.col(ret).isNotNull())
    daily = entries.groupBy(*by, "date").agg(F.count(F.lit(1)).alias("n_trades"), F.avg(ret).alias("ret_gross"), F.sum(F.when(F.col(ret) > 0, 1).otherwise(0)).alias("n_win"), F.sum(ret).alias("sum_gross"))
    daily = daily.withColumn("ret_net", F.col("ret_gross") - cost)
    upto = (Window.partitionBy(*by) if by else Window).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    grown = lambda c: F.product(1 + F.col(c)).over(upto) - 1
    return daily.select("*", grown("ret_gross").alias("cum_gross"), grown("ret_net").alias("cum_net"))


def _years(first: Column, last: Column) -> Column:
    return F.datediff(last, first) / F.lit(365.25)


def daily_metrics(daily: DataFrame, ann: float = DEFAULT.ann) -> DataFrame:
    """Metrics of one_day_backtest with sample deviations (B2, W9); one row."""
    upto = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    dd = (1 + F.col("cum_net")) / F.max(1 + F.col("cum_net")).over(upto) - 1
    out = daily.withColumn("dd", dd).agg(
        F.sum("n_trades").alias("n_trades"), F.avg("ret_gross").alias("mean_gross"), F.avg("ret_net").alias("mean_net"),
        F.stddev_samp("ret_gross").alias("sd_gross"), F.stddev_samp("ret_net").alias("sd_net"), F.min("dd").alias("mdd"), F.sum("n_win").alias("n_win"),
        F.min("date").alias("first"), F.max("date").alias("last"), F.max_by("cum_net", "date").alias("final_cum_net"),
    )
    sharpe = lambda m, s: F.when(F.col(s) > 0, F.col(m) / F.col(s) * F.sqrt(F.lit(float(ann))))
    years = _years(F.col("first"), F.col("last"))
    return out.select(
        "n_trades", "mean_gross", "mean_net", sharpe("mean_gross", "sd_gross").alias("sharpe_gross"), sharpe("mean_net", "sd_net").alias("sharpe_net"),
        ratio(F.col("n_win"), F.col("n_trades")).alias("win_rate"), "mdd", "final_cum_net",
        F.when(years > 0, F.pow(1 + F.col("final_cum_net"), ratio(F.lit(1.0), years)) - 1).alias("cagr_net"),
    )


def horizon_sweep(labelled: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Metrics of the overlapping backtest for every horizon at once; the horizon is a column."""
    w = Window.partitionBy("code").orderBy("date")
    wide = labelled.select("code", "date", "state_id", "regime", F.array(*(F.struct(F.lit(h).alias("h"), (ratio(F.lead("close", h).over(w), F.col("close")) - 1).alias("ret")) for h in p.horizons)).alias("x"))
    rows = wide.select("code", "date", "state_id", "regime", F.explode("x").alias("x")).select("code", "date", "state_id", "regime", "x.h", "x.ret").where("ret is not null")
    picked = chosen(identify(rows.where(F.col("date") <= F.lit(p.train_end).cast("date")), "ret", p, "h"), "h")
    daily = one_day_backtest(rows.where(F.col("date") >= F.lit(p.test_start).cast("date")), picked, p.cost, "ret", "h")
    out = daily.groupBy("h").agg(
        F.sum("n_trades").alias("n_trades"), F.sum("sum_gross").alias("s"), F.sum("n_win").alias("w"), F.avg("ret_gross").alias("m"), F.stddev_samp("ret_gross").alias("sd"), F.avg("ret_net").alias("mn"), F.stddev_samp("ret_net").alias("sdn")
    )
    ann = F.sqrt(F.lit(float(p.ann)) / F.col("h"))
    mu = F.col("s") / F.col("n_trades")
    return out.select("h", "n_trades", mu.alias("mu_gross"), (mu - p.cost).alias("mu_net"), ratio(F.col("w"), F.col("n_trades")).alias("win_rate"), F.when(F.col("sd") > 0, F.col("m") / F.col("sd") * ann).alias("sharpe_gross"), F.when(F.col("sdn") > 0, F.col("mn") / F.col("sdn") * ann).alias("sharpe_net"))


def market_bear(panel: DataFrame, rows: int = DEFAULT.sma) -> DataFrame:
    """date, close, sma, is_bear of the cross-sectional mean close; null in the warm-up (A31, W11). One row per date."""
    daily = panel.groupBy("date").agg(F.avg("close").alias("close"))
    w = Window.orderBy("date")
    out = daily.withColumn("sma", trailing(F.col("close"), w, rows, F.avg))
    return out.withColumn("is_bear", F.when(F.col("sma").isNotNull(), (F.col("close") < F.col("sma")).cast("long")))


def without_bear(candidates: DataFrame, bear: DataFrame) -> DataFrame:
    """Candidates on days that aren't bear days (J15); a blocked candidate leaves the last exit alone, so this comes first (Q2)."""
    return candidates.join(bear.where("is_bear = 1").select("date"), "date", "left_anti")


def non_overlapping(candidates: DataFrame, cost: float = DEFAULT.cost, *by: str) -> DataFrame:
    """Greedy trades per code: a candidate enters if its date is after the last exit (Q1).

    candidates: by.., code, date, exit_date, state_id, regime, ret_h. A code's candidates pass in order, and all that is held of
    them is the last exit.
    """
    keys = [*by, "code"]
    rows = candidates.select(*keys, "date", "exit_date", "state_id", "regime", "ret_h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last = None, None
        for b in batches:
            if not b.num_rows:
                continue
            day, out = (b.column(len(keys) + i).cast(pa.int32()).to_numpy() for i in (0, 1))
            own = [np.asarray(b.column(i).to_pylist(), object) for i in range(len(keys))]
            new = np.ones(b.num_rows, bool)
            new[1:] = np.any([v[1:] != v[:-1] for v in own], axis=0)
            starts, enter = np.flatnonzero(new).tolist(), np.zeros(b.num_rows, bool)
            for a, z in zip(starts, [*starts[1:], b.num_rows]):
                if (this := tuple(v[a] for v in own)) != key:
                    key, last = this, None
                i = a if last is None else a + int(np.searchsorted(day[a:z], last, "right"))
                while i < z:  # from a trade to the first candidate after its exit
                    enter[i], last = True, int(out[i])
                    i += 1 + int(np.searchsorted(day[i + 1 : z], last, "right"))
            yield b.filter(pa.array(enter))

    trades = rows.repartition(*keys).sortWithinPartitions(*keys, "date", "exit_date").mapInArrow(run, rows.schema)
    return trades.select(*by, F.col("date").alias("entry_date"), "exit_date", "code", "state_id", "regime", F.col("ret_h").alias("ret_gross"), (F.col("ret_h") - cost).alias("ret_net"))


#: Days of a bin in which returns meet the trades that hold their code.
BIN = 32


def portfolio_path(trades: DataFrame, prices: DataFrame, dates: DataFrame, cost: float = DEFAULT.cost, clamp: bool = False, *by: str) -> DataFrame:
    """by.., date, n_active, port_ret, equity: equal weight of the active trades.

    dates: by.., date, the calendar of the test period; the trade is active on the calendar's dates after entry up to exit, also on
    those that its code has no row on. An exit beyond the calendar skips the trade, or with clamp ends at the last date (Q4b).
    Active trades are counted from entries and exits before each date. Returns meet the trades that hold their code by bins of
    days, of which a trade touches one or two; only the calendar, one row a day and key, is broadcast.
    """
    on = list(by)
    span = Window.partitionBy(*on) if on else Window.partitionBy(F.lit(0))
    calendar = dates.select(*on, "date").distinct()
    entries = F.broadcast(calendar.withColumnRenamed("date", "entry_date"))
    exits = F.broadcast(calendar.select(*on, F.col("date").alias("exit_date"), F.lit(True).alias("_known")))
    t = trades.select(*on, "code", "entry_date", "exit_date").join(entries, [*on, "entry_date"], "left_semi").join(exits, [*on, "exit_date"], "left")
    if clamp:
        last = F.broadcast(calendar.groupBy(*on).agg(F.max("date").alias("_last")))
        t = (t.join(last, on) if on else t.crossJoin(last)).withColumn("exit_date", F.when(F.col("_known"), F.col("exit_date")).otherwise(F.col("_last")))
    else:
        t = t.where("_known")
    ends = F.explode(F.array(F.struct(F.col("entry_date").alias("date"), F.lit(1).alias("entry")), F.struct(F.col("exit_date").alias("date"), F.lit(0).alias("entry")))).alias("e")
    events = t.select(*on, ends).groupBy(*on, "e.date").agg(F.sum("e.entry").alias("entries"), F.count_if(F.col("e.entry") == 0).alias("exits"))
    day = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date"))
    held = t.select(*on, "code", day("entry_date").alias("_from"), day("exit_date").alias("_to")).where("_from < _to")
    held = held.withColumn("_bin", F.explode(F.sequence(F.floor((F.col("_from") + 1) / BIN), F.floor(F.col("_to") / BIN))))
    returns = daily_return(prices.select("code", "date", "close")).where("ret_d is not null").select("code", "date", "ret_d", day("date").alias("_day"), F.floor(day("date") / BIN).alias("_bin"))
    earned = returns.join(held, ["code", "_bin"]).where("_from < _day and _day <= _to").groupBy(*on, "date").agg(F.sum("ret_d").alias("pnl"))
    before = span.orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    count = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    path = calendar.join(events, [*on, "date"], "left").join(earned, [*on, "date"], "left")
    path = path.withColumn("n", count(F.sum(count("entries") - count("exits")).over(before)))
    n = F.col("n")
    ret = F.when(n > 0, (F.coalesce("pnl", F.lit(0.0)) - cost * count("exits")) / n).otherwise(0.0)
    path = path.select(*on, "date", n.alias("n_active"), ret.alias("port_ret"))
    upto = span.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return path.withColumn("equity", F.product(1 + F.col("port_ret")).over(upto))


def path_metrics(path: DataFrame, trades: DataFrame, p: Params = DEFAULT, *by: str) -> DataFrame:
    """Metrics of a path with population deviations over active days (B3); with keys one row for each (B5, with pass flag)."""
    on = list(by)
    span = Window.partitionBy(*on) if on else Window.partitionBy(F.lit(0))
    upto = span.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    act = F.when(F.col("n_active") > 0, F.col("port_ret"))
    dn = F.when((F.col("n_active") > 0) & (F.col("port_ret") < 0), F.col("port_ret"))
    m = path.withColumn("dd", F.col("equity") / F.max("equity").over(upto) - 1).groupBy(*on).agg(
        F.avg(act).alias("mu"), F.stddev_pop(act).alias("sd"), F.stddev_pop(dn).alias("dsd"), F.count(dn).alias("dn"), F.min("dd").alias("mdd"), F.avg("n_active").alias("avg_active"),
        F.min("date").alias("first"), F.max("date").alias("last"), F.max_by("equity", "date").alias("final_equity"),
    )
    t = trades.groupBy(*on).agg(F.count(F.lit(1)).alias("n_trades"), F.avg((F.col("ret_net") > 0).cast("double")).alias("win_rate_net"))
    m = m.join(t, on) if on else m.crossJoin(F.broadcast(t))
    years, root = _years(F.col("first"), F.col("last")), F.sqrt(F.lit(float(p.ann)))
    cagr = F.when((years > 0) & (F.col("final_equity") > 0), F.pow("final_equity", ratio(F.lit(1.0), years)) - 1)
    out = m.withColumn("cagr", cagr).select(
        *on, "n_trades", "win_rate_net", "avg_active",
        F.when(F.col("sd") > 0, F.col("mu") / F.col("sd") * root).alias("sharpe"),
        F.when((F.col("dn") > 1) & (F.col("dsd") > 0), F.col("mu") / F.col("dsd") * root).alias("sortino"),
        "mdd", "cagr", F.when(F.col("mdd") < 0, F.col("cagr") / F.abs("mdd")).alias("calmar"), "final_equity",
    )
    return out.withColumn("passed", F.coalesce((F.col("sharpe") > p.pass_sharpe) & (F.col("mdd") > p.pass_mdd), F.lit(False)))


def trades_of(labelled: DataFrame, p: Params = DEFAULT, bear: DataFrame | None = None) -> DataFrame:
    """Train selection and greedy trades of the test period (A9, Q1 or Q2)."""
    rows = horizon_return(labelled, p.horizon).where("ret_h is not null")
    picked = chosen(identify(rows.where(F.col("date") <= F.lit(p.train_end).cast("date")), "ret_h", p))
    cand = rows.where(F.col("date") >= F.lit(p.test_start).cast("date")).join(F.broadcast(picked), "state_id", "left_semi")
    return non_overlapping(cand if bear is None else without_bear(cand, bear), p.cost)


def folds(spark, p: Params = DEFAULT) -> DataFrame:
    """fold, start, end; training ends the day before start."""
    return spark.range(len(p.folds)).select(F.element_at(F.array(*(F.lit(y) for y in p.folds)), (F.col("id") + 1).cast("int")).alias("fold")).select(
        "fold", F.make_date("fold", F.lit(1), F.lit(1)).alias("start"), F.make_date("fold", F.lit(12), F.lit(31)).alias("end")
    )


def identify_before(rows: DataFrame, ret: str, years: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """fold and what identify gives for all rows before the fold's first year; moments by state and year are put together, not rows.

    A year's squares are taken around its own mean and the years' means around their common one, so that nothing cancels.
    """
    moments = F.count(ret).alias("n"), F.sum(ret).alias("s"), F.coalesce(F.var_pop(ret) * F.count(ret), F.lit(0.0)).alias("q"), F.max(F.abs(ret)).alias("most")
    sums = rows.where(F.col("state_id").isNotNull()).groupBy("state_id", "regime", F.year("date").alias("year")).agg(F.count(F.lit(1)).alias("rows"), *moments)
    own = F.collect_list(F.struct("n", "s", "q")).alias("own")
    cells = sums.join(years.select("fold"), F.col("year") < F.col("fold")).groupBy("fold", "state_id", "regime").agg(*(F.sum(c).alias(c) for c in ("n", "rows", "s")), F.max("most").alias("most"), own)
    often = F.min(F.when(F.col("regime").isNotNull(), F.struct((-F.col("rows")).alias("k"), "regime")))["regime"]
    g = cells.groupBy("fold", "state_id").agg(*(F.sum(c).alias(c) for c in ("n", "s")), F.sum("rows").alias("visits"), F.max("most").alias("most"), F.flatten(F.collect_list("own")).alias("own"), often.alias("regime"))
    g = g.withColumn("mu_r", ratio(F.col("s"), F.col("n")))
    off = lambda x: ratio(x["s"], x["n"]) - F.col("mu_r")
    q = F.aggregate("own", F.lit(0.0), lambda total, x: total + x["q"] + F.coalesce(x["n"] * off(x) * off(x), F.lit(0.0)))
    sd = F.sqrt(ratio(q, F.nullif(F.col("n") - 1, F.lit(0))))
    return marked(g.select("fold", "state_id", "visits", "mu_r", spread(sd, F.col("most")).alias("sigma_r"), "regime"), p)


def fold_trades(labelled: DataFrame, p: Params = DEFAULT, overlay: bool = False) -> DataFrame:
    """Greedy trades of one test year each after expanding training; all folds in one plan, the fold is a key (B6, P6; overlay B7)."""
    years = F.broadcast(folds(labelled.sparkSession, p))
    rows = horizon_return(labelled, p.horizon)
    known = rows.where("ret_h is not null")
    picked = chosen(identify_before(known, "ret_h", years, p), "fold")
    test = rows.join(years, F.year("date") == F.col("fold"))
    cand = test.where("ret_h is not null").join(F.broadcast(picked), ["fold", "state_id"], "left_semi")
    if overlay:
        cand = without_bear(cand, market_bear(labelled, p.sma))
    return non_overlapping(cand, p.cost, "fold")


def walk_forward(labelled: DataFrame, p: Params = DEFAULT, overlay: bool = False, trades: DataFrame | None = None) -> DataFrame:
    """Metrics of the folds (B5); trades: those of fold_trades, where they are at hand."""
    years = F.broadcast(folds(labelled.sparkSession, p))
    trades = fold_trades(labelled, p, overlay) if trades is None else trades
    days = labelled.select("date").distinct().join(years, F.year("date") == F.col("fold")).select("fold", "date")
    path = portfolio_path(trades, labelled, days, p.cost, True, "fold")
    return path_metrics(path, trades, p, "fold").drop("sortino", "avg_active")


def fold_summary(metrics: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """n_folds, n_passed, mean, sample deviation and variation of the folds' Sharpe, system pass."""
    m = metrics.agg(F.count(F.lit(1)).alias("n_folds"), F.sum(F.col("passed").cast("long")).alias("n_passed"), F.avg("sharpe").alias("mean_sharpe"), F.coalesce(F.stddev_samp("sharpe"), F.lit(0.0)).alias("std_sharpe"))
    cv = F.when(F.col("mean_sharpe") > 0, F.col("std_sharpe") / F.col("mean_sharpe"))
    good = (F.col("n_passed") >= p.sys_min_pass) & (F.col("mean_sharpe") > p.sys_min_mean) & (F.col("cv") < p.sys_max_cv)
    return m.withColumn("cv", cv).withColumn("system_pass", F.coalesce(good, F.lit(False)))
