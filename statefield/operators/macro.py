"""Macro regimes of the market and where the trades' results come from."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Params
from ..functions.columns import counted, ratio

CLASSES = ["INVARIANT", "CONDITIONAL", "TRAP", "DEAD", "AMBIGUOUS", "INSUFFICIENT"]


def market_equity(panel: DataFrame) -> DataFrame:
    """date, equity_market, dd: exp of summed mean log returns.

    Returns are between adjacent dates of the calendar: a code counts on a date only if it has a row on the date before too.
    The calendar is one row per date, so its running sums are a single small partition.
    """
    days = panel.select("date").distinct()
    numbered = days.withColumn("day", F.row_number().over(Window.orderBy("date")))
    rows = panel.join(F.broadcast(numbered), "date")
    w = Window.partitionBy("code").orderBy("date")
    lp = F.ln("close")
    r = F.when(F.lag("day").over(w) == F.col("day") - 1, lp - F.lag(lp).over(w))
    daily = rows.withColumn("lr", r).groupBy("date").agg(F.coalesce(F.avg("lr"), F.lit(0.0)).alias("m"))
    upto = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    eq = daily.select("date", F.exp(F.sum("m").over(upto)).alias("equity_market"))
    return eq.withColumn("dd", F.col("equity_market") / F.max("equity_market").over(upto) - 1)


def regime_fsm(dd: DataFrame, p: Params = DEFAULT, *keep: str) -> DataFrame:
    """date, dd, regime: BULL, BEAR, RECOVERY with hysteresis (Q3); windows over the one date series.

    Each row at or under dd_bear begins a stretch, in which the first row at or above dd_recover ends the BEAR and a row after
    that at or above dd_bull ends the RECOVERY. Before the first stretch all is BULL.
    """
    upto = lambda w: w.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    rows = dd.select("date", "dd", *keep).withColumn("_stretch", F.count_if(F.col("dd") <= p.dd_bear).over(upto(Window.partitionBy(F.lit(0)))))
    w = upto(Window.partitionBy("_stretch"))
    rows = rows.withColumn("_up", F.count_if(F.col("dd") >= p.dd_recover).over(w))
    before = F.coalesce(F.lag("_up").over(Window.partitionBy("_stretch").orderBy("date")), F.lit(0))
    rows = rows.withColumn("_before", before).withColumn("_out", F.count_if((F.col("dd") >= p.dd_bull) & (F.col("_before") > 0)).over(w))
    regime = F.when((F.col("_stretch") == 0) | (F.col("_out") > 0), "BULL").when(F.col("_up") > 0, "RECOVERY").otherwise("BEAR")
    return rows.select("date", "dd", *keep, regime.alias("regime"))


def with_regime(df: DataFrame, labels: DataFrame, on: str) -> DataFrame:
    """macro_regime of the date in `on` (J3, J4); the labels are one row per date."""
    return df.join(F.broadcast(labels.select(F.col("date").alias(on), F.col("regime").alias("macro_regime"))), on, "left")


def regime_pnl(trades: DataFrame, labels: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Trades by macro regime of their entry."""
    g = with_regime(trades, labels, "entry_date").where("macro_regime is not null").groupBy("macro_regime")
    out = g.agg(F.count(F.lit(1)).alias("n_trades"), F.avg("ret_net").alias("mean"), F.stddev_samp("ret_net").alias("std"), F.sum("ret_net").alias("sum"), F.avg((F.col("ret_net") > 0).cast("double")).alias("hit_rate"))
    return out.withColumn("sharpe_ann", F.col("mean") / (F.col("std") + p.eps) * math.sqrt(p.ann / p.horizon))


def state_decomposition(trades: DataFrame, labels: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Cells of state and macro regime; a single trade has deviation 0 and so a huge t."""
    g = with_regime(trades, labels, "entry_date").where("macro_regime is not null").groupBy("state_id", "macro_regime")
    out = g.agg(F.count(F.lit(1)).alias("n"), F.avg("ret_net").alias("mean"), F.coalesce(F.stddev_samp("ret_net"), F.lit(0.0)).alias("std"), F.sum("ret_net").alias("sum"))
    out = out.withColumn("se", F.col("std") / F.sqrt("n"))
    return out.withColumn("t_one_sample", F.col("mean") / (F.col("se") + p.eps))


def transition_drift(states: DataFrame, labels: DataFrame) -> DataFrame:
    """Regime, state_id, next_state, n, P."""
    w = Window.partitionBy("code").orderBy("date")
    rows = states.select("code", "date", "state_id", F.lead("state_id").over(w).alias("next_state")).where("state_id is not null and next_state is not null")
    rows = rows.join(F.broadcast(labels.select("date", "regime")), "date").where("regime is not null")
    counts = rows.groupBy("regime", "state_id", "next_state").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("P", F.col("n") / F.sum("n").over(Window.partitionBy("regime", "state_id")))


def kl_bull_bear(drift: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """KL of bull against bear transitions with one added to the bear counts; seen pairs only."""
    a = drift.where("regime = 'BULL'").select("state_id", "next_state", F.col("P").alias("pb"))
    b = drift.where("regime = 'BEAR'").select("state_id", "next_state", F.col("n").alias("ne"))
    m = a.join(b, ["state_id", "next_state"], "full").select("state_id", "next_state", F.coalesce("pb", F.lit(0.0)).alias("pb"), F.coalesce("ne", F.lit(0)).alias("ne"))
    k = m.agg(F.countDistinct("next_state").alias("k"))
    m = m.crossJoin(F.broadcast(k)).withColumn("total", F.sum("ne").over(Window.partitionBy("state_id")))
    smooth = (F.col("ne") + 1) / (F.col("total") + F.col("k"))
    term = F.when(F.col("pb") > 0, F.col("pb") * F.ln((F.col("pb") + p.eps) / (smooth + p.eps))).otherwise(0.0)
    return m.groupBy("state_id").agg(F.sum(term).alias("kl_bull_bear"))


def flip_map(decomposition: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Welch's t of bull against bear for states that have both cells."""
    cols = lambda r, s: decomposition.where(F.col("macro_regime") == r).select("state_id", F.col("mean").alias(f"mu_{s}"), F.col("n").alias(f"n_{s}"), (F.col("std") * F.col("std")).alias(f"s2_{s}"), F.col("t_one_sample").alias(f"t_{s}_pos"))
    m = cols("BULL", "bull").join(cols("BEAR", "bear"), "state_id")
    se = F.sqrt(F.col("s2_bull") / F.col("n_bull") + F.col("s2_bear") / F.col("n_bear"))
    return m.withColumn("t_flip", (F.col("mu_bull") - F.col("mu_bear")) / (se + p.eps)).withColumn("reliable", (F.col("n_bull") >= p.cell_visits) & (F.col("n_bear") >= p.cell_visits))


def classify(flips: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """One of six classes for each state of the flip map; the order of the tests matters."""
    bull, bear, t = F.col("t_bull_pos"), F.col("t_bear_pos"), p.t_least
    label = (
        F.when(~F.col("reliable"), "INSUFFICIENT")
        .when((bull > t) & (bear > t), "INVARIANT")
        .when((bull > t) & (bear < -t), "TRAP")
        .when((bull > t) & (F.abs(bear) <= t), "CONDITIONAL")
        .when((bull <= 0) & (bear <= 0), "DEAD")
        .otherwise("AMBIGUOUS")
    )
    return flips.select("state_id", label.alias("state_class"))


# Reports


def attribution(trades: DataFrame, classes: DataFrame) -> DataFrame:
    """Trades with their state's class."""
    return trades.join(F.broadcast(classes), "state_id", "left").withColumn("state_class", F.coalesce("state_class", F.lit("UNCLASSIFIED")))


def summary(trades: DataFrame, *by: str) -> DataFrame:
    """n, sum, mean, std of ret_net, std 0 for a single trade (A22; with keys A23)."""
    return trades.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("ret_net"), F.lit(0.0)).alias("sum"), F.coalesce(F.avg("ret_net"), F.lit(0.0)).alias("mean"), F.coalesce(F.when(F.count(F.lit(1)) > 1, F.stddev_samp("ret_net")), F.lit(0.0)).alias("std"))


def top(df: DataFrame, by: str, n: int, *ties: str, ascending: bool = False) -> DataFrame:
    """The first n rows by a column, ties by keys (L3 to L6). Values count to nine digits: equal sums differ in the last bits."""
    return df.orderBy(counted(by).asc() if ascending else counted(by).desc(), *ties).limit(n)


def contributors(trades: DataFrame, n: int = DEFAULT.top_assets) -> DataFrame:
    """Best and worst (code, state) by summed result, with side."""
    g = trades.groupBy("code", "state_id").agg(F.sum("ret_net").alias("sum"), F.count(F.lit(1)).alias("n"))
    return top(g, "sum", n, "code", "state_id").withColumn("side", F.lit("top")).unionByName(top(g, "sum", n, "code", "state_id", ascending=True).withColumn("side", F.lit("bottom")))


def stay_by_regime(drift: DataFrame) -> DataFrame:
    """p_stay of each state as BULL and BEAR columns, delta and its size."""
    wide = drift.where("state_id = next_state").groupBy("state_id").pivot("regime", ["BULL", "BEAR"]).agg(F.avg("P")).fillna(0.0, ["BULL", "BEAR"])
    return wide.withColumn("delta", F.col("BEAR") - F.col("BULL")).withColumn("abs_delta", F.abs("delta"))


def regime_frequency(labels: DataFrame) -> DataFrame:
    """Counts and shares of each regime per year."""
    g = labels.groupBy(F.year("date").alias("year")).pivot("regime", ["BULL", "BEAR", "RECOVERY"]).agg(F.count(F.lit(1))).fillna(0)
    total = F.col("BULL") + F.col("BEAR") + F.col("RECOVERY")
    return g.select("*", *((F.col(c) / total).alias(f"share_{c}") for c in ("BULL", "BEAR", "RECOVERY")))


def distribution_shift(states: DataFrame) -> DataFrame:
    """Share of each state before and after the median date, and the difference."""
    known = states.where("state_id is not null")
    mid = known.agg(F.percentile(F.unix_date("date"), F.lit(0.5)).alias("mid"))
    rows = known.crossJoin(F.broadcast(mid)).withColumn("late", F.unix_date("date") > F.col("mid"))
    sides = rows.groupBy("state_id").agg(F.sum((~F.col("late")).cast("long")).alias("a"), F.sum(F.col("late").cast("long")).alias("b"))
    total = sides.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    return sides.crossJoin(F.broadcast(total)).select("state_id", ratio(F.col("a"), F.col("ta")).alias("early"), ratio(F.col("b"), F.col("tb")).alias("late")).withColumn("delta", F.col("late") - F.col("early"))


def class_distribution(classes: DataFrame) -> DataFrame:
    """Number of states of each class, empty classes too."""
    spine = classes.sparkSession.createDataFrame([(c,) for c in CLASSES], "state_class string")
    return spine.join(classes.groupBy("state_class").agg(F.count(F.lit(1)).alias("n")), "state_class", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def states_of_class(classes: DataFrame, name: str) -> DataFrame:
    """Sorted states of a class."""
    if name not in CLASSES:
        raise ValueError(f"unknown class {name}")
    return classes.where(F.col("state_class") == name).select("state_id").orderBy("state_id")


def class_of(classes: DataFrame, state: int) -> str:
    row = classes.where(F.col("state_id") == state).first()
    return row["state_class"] if row else "UNKNOWN"


def assert_finite(df: DataFrame) -> DataFrame:
    """Raises if any double of df is NaN or infinite (P11); one pass."""
    cols = [c for c, t in df.dtypes if t in ("double", "float")]
    bad = df.agg(*(F.count_if(F.isnan(c) | (F.abs(c) == F.lit(float("inf")))).alias(c) for c in cols)).first() if cols else {}
    wrong = [c for c in cols if bad[c]]
    if wrong:
        raise ValueError(f"not finite: {', '.join(wrong)}")
    return df
