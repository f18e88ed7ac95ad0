"""Operators that are specified as formulas: EV surface, edge sets, stability, spectrum, drift measures, kernel edge."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Params
from ..functions.columns import by_code, finite, ratio
from .mixture import mixture_regimes


def ev_surface(trades: DataFrame, labels: DataFrame) -> DataFrame:
    """state_id, regime: n, ev, se, t; t only where se > 0."""
    rows = trades.join(F.broadcast(labels.select(F.col("date").alias("entry_date"), F.col("regime").alias("macro"))), "entry_date")
    g = rows.groupBy("state_id", "macro").agg(F.count(F.lit(1)).alias("n"), F.avg("ret_net").alias("ev"), F.stddev_samp("ret_net").alias("sd"))
    se = F.col("sd") / F.sqrt("n")
    return g.select("state_id", "macro", "n", "ev", se.alias("se"), F.when(se > 0, F.col("ev") / se).alias("t"))


def tradeable_mask(stats: DataFrame, decomposition: DataFrame, classes: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """state_id, mask: 1 for states with a positive mean, enough visits, a t of some size in any macro regime, a class that lasts, and a tradeable regime."""
    t = decomposition.groupBy("state_id").agg(F.max(F.abs("t_one_sample")).alias("t"))
    rows = stats.join(t, "state_id", "left").join(classes, "state_id", "left")
    good = (F.col("mu_r_raw") > 0) & (F.col("visits") >= p.min_visits) & (F.col("t") >= p.t_least) & F.col("state_class").isin("INVARIANT", "CONDITIONAL") & F.col("regime").isin(*p.regimes)
    return rows.select("state_id", F.coalesce(good, F.lit(False)).cast("long").alias("mask"))


def transition_filter(kl: DataFrame, stay: DataFrame, quantile: float = 0.9, most_stay: float = 0.5) -> DataFrame:
    """States whose divergence is above its quantile and that seldom stay."""
    cut = kl.agg(F.percentile("kl_bull_bear", F.lit(quantile)).alias("cut"))
    return kl.crossJoin(F.broadcast(cut)).where("kl_bull_bear > cut").join(stay, "state_id").where(F.col("p_stay") < most_stay).select("state_id", "kl_bull_bear", "p_stay")


def edge_field(surface: DataFrame) -> DataFrame:
    """state_id, macro, ev, ev_z: the surface's values standardised within each regime."""
    w = Window.partitionBy("macro")
    return surface.select("state_id", "macro", "ev", ratio(F.col("ev") - F.avg("ev").over(w), F.nullif(F.stddev_samp("ev").over(w), F.lit(0.0))).alias("ev_z"))


def positive_set(edge: DataFrame) -> DataFrame:
    """z, n, coverage of hidden states with positive edge (D3)."""
    total = edge.agg(F.sum("n").alias("all"))
    return edge.crossJoin(F.broadcast(total)).where("e > 0").select("z", "n", ratio(F.col("n"), F.col("all")).alias("coverage"))


def stability(matrix: DataFrame, kept: DataFrame) -> DataFrame:
    """z in the set: stability within it, leakage, attraction s / (1 - s)."""
    inside = kept.select(F.col("z").alias("z_next"))
    s = matrix.join(F.broadcast(inside), "z_next", "left_semi").groupBy("z").agg(F.sum("t").alias("s"))
    out = kept.select("z").join(s, "z")
    return out.select("z", "s", (1 - F.col("s")).alias("leakage"), ratio(F.col("s"), 1 - F.col("s")).alias("attractor"))


def ev_variants(edge: DataFrame, stable: DataFrame, cost: float = DEFAULT.cost, horizon: int = DEFAULT.horizon, n: int = 3) -> DataFrame:
    """Membership of each positive-edge state in the seven selections A to G.

    A positive edge, B above the cost, C above the cost spread over the horizon, D ranked by edge times stability, E and F as C
    and B with stability above one half, G the n largest edges. Four classes: B cost, E stability, C horizon, G unstable.
    """
    rows = edge.where("e > 0").join(stable.select("z", "s"), "z")
    rank = lambda c: F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(c), "z"))
    rows = rows.withColumn("weighted", F.col("e") * F.col("s"))
    above, spread, firm = F.col("e") > cost, F.col("e") > cost / horizon, F.col("s") > 0.5
    return rows.select("z", F.lit(True).alias("a"), above.alias("b"), spread.alias("c"), rank("weighted").cast("long").alias("d_rank"), (firm & spread).alias("e"), (firm & above).alias("f"), (rank("e") <= n).alias("g"))


def spectrum(t: np.ndarray) -> dict[str, float]:
    """Eigenvalue sizes, gap, mixing time and leakage of a small substochastic matrix."""
    values = np.sort(np.abs(np.linalg.eigvals(t)))[::-1]
    second = float(values[1]) if len(values) > 1 else 0.0
    return {"first": float(values[0]), "second": second, "gap": float(values[0]) - second, "mixing": float(-1 / np.log(second)) if 0 < second < 1 else 0.0, "leakage": 1 - float(values[0])}


def equal_weights(states: DataFrame, kept: DataFrame) -> DataFrame:
    """date, code, weight: equal weight over the day's codes whose hidden state is in the set."""
    rows = states.join(F.broadcast(kept.select(F.col("z").alias("Z_t"))), "Z_t", "left_semi")
    return rows.select("date", "code", (1.0 / F.count(F.lit(1)).over(Window.partitionBy("date"))).alias("weight"))


def psi(reference: DataFrame, current: DataFrame, by: str, eps: float = 1e-6) -> DataFrame:
    """One row: population stability index over a discrete column."""
    share = lambda df, n: df.groupBy(by).agg(F.count(F.lit(1)).alias(n)).withColumn(n, F.col(n) / F.sum(n).over(Window.partitionBy(F.lit(0))))
    both = share(reference, "a").join(share(current, "b"), by, "full")
    a, b = (F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(eps)) for c in ("a", "b"))
    return both.agg(F.sum((b - a) * F.ln(b / a)).alias("psi"))


def ks(reference: DataFrame, current: DataFrame, value: str, buckets: int = 4096) -> DataFrame:
    """One row: Kolmogorov-Smirnov distance of a column in two tables.

    Values are counted in buckets of equal width between the least and the largest first, so that the running shares need no
    single sorted task; a value's bucket follows from the value alone. Null, NaN and infinite values take no part.
    """
    both = reference.select(F.col(value).alias("x"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(current.select(F.col(value).alias("x"), F.lit(0).alias("a"), F.lit(1).alias("b"))).where(finite(F.col("x")))
    cells = both.groupBy("x").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    ends = both.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    part = F.coalesce(F.floor(F.try_divide(F.col("x") - F.col("lo"), F.col("hi") - F.col("lo")) * buckets), F.lit(0)).cast("int")
    cells = cells.crossJoin(F.broadcast(ends)).select("x", "a", "b", part.alias("part"))
    sums = cells.groupBy("part").agg(F.sum("a").alias("sa"), F.sum("b").alias("sb"))
    before = sums.select("part", *((F.sum(c).over(Window.orderBy("part")) - F.col(c)).alias(f"before_{c}") for c in ("sa", "sb")))
    total = sums.agg(F.sum("sa").alias("ta"), F.sum("sb").alias("tb"))
    w = Window.partitionBy("part").orderBy("x")
    rows = cells.join(F.broadcast(before), "part").crossJoin(F.broadcast(total))
    gap = F.abs((F.sum("a").over(w) + F.col("before_sa")) / F.col("ta") - (F.sum("b").over(w) + F.col("before_sb")) / F.col("tb"))
    return rows.select(gap.alias("g")).agg(F.max("g").alias("ks"))


def occupancy(states: DataFrame, split: str) -> DataFrame:
    """state_id: shares before and from a date, and their difference."""
    late = F.col("date") >= F.lit(split).cast("date")
    g = states.where("state_id is not null").groupBy("state_id").agg(F.count_if(~late).alias("a"), F.count_if(late).alias("b"))
    t = g.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    return g.crossJoin(F.broadcast(t)).select("state_id", ratio(F.col("a"), F.col("ta")).alias("before"), ratio(F.col("b"), F.col("tb")).alias("after")).withColumn("drift", F.abs(F.col("after") - F.col("before")))


def five_state(features: DataFrame, eps: float = 1e-8) -> DataFrame:
    """The five-part state, standardised over the whole panel."""
    parts = features.select("code", "date", "r", "sigma", "v", "flow", (1 / (F.abs("r") + eps)).alias("calm")).dropna()
    cols = ["r", "sigma", "v", "flow", "calm"]
    m = parts.agg(*(F.avg(c).alias(f"m_{c}") for c in cols), *(F.stddev_samp(c).alias(f"s_{c}") for c in cols))
    return parts.crossJoin(F.broadcast(m)).select("code", "date", *(ratio(F.col(c) - F.col(f"m_{c}"), F.nullif(F.col(f"s_{c}"), F.lit(0.0))).alias(f"g_{c}") for c in cols))


def gmm_regimes(df: DataFrame, cols: list[str], k: int = 4, seed: int = 42) -> DataFrame:
    """regime of each row with finite values under a mixture of k Gaussians."""
    return mixture_regimes(df, cols, k, seed=seed)


def top_scores(scored: DataFrame, bonus: dict[str, float], n: int = 5) -> DataFrame:
    """The n best codes of each day by score plus regime bonus."""
    plus = F.lit(0.0)
    for regime, b in bonus.items():
        plus = F.when(F.col("regime") == regime, F.lit(b)).otherwise(plus)
    rows = scored.withColumn("total", F.col("score") + plus)
    w = Window.partitionBy("date").orderBy(F.desc("total"), "code")
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def snapshot(panel: DataFrame, rows: int = 20) -> DataFrame:
    """max_up and max_drawdown of each row over the next rows."""
    ahead = by_code().rowsBetween(1, rows)
    return panel.select("code", "date", (F.max("close").over(ahead) / F.col("close") - 1).alias("max_up"), (F.min("close").over(ahead) / F.col("close") - 1).alias("max_drawdown"))


def kernel_edge(states: DataFrame, cols: list[str], f: str, rows: int = 20) -> DataFrame:
    """code, date, edge, var, bound: kernel-weighted mean of f over the previous rows, less its deviation.

    The weight of a past row is exp(-squared distance) of the states. Past rows come from a bounded frame, not a self join.
    """
    w = by_code().rowsBetween(-rows, -1)
    past = F.collect_list(F.when(F.col(f).isNotNull(), F.struct(*cols, F.col(f).alias("f")))).over(w)
    rows_ = states.dropna(subset=cols).select("code", "date", *cols, past.alias("past"))
    dist = lambda s: sum(((s[c] - F.col(c)) * (s[c] - F.col(c)) for c in cols), F.lit(0.0))
    wf = rows_.withColumn("k", F.transform("past", lambda s: F.struct(F.exp(-dist(s)).alias("w"), s["f"].alias("f"))))
    add = lambda g: F.aggregate("k", F.lit(0.0), lambda a, x: a + g(x))
    sums = wf.select("code", "date", add(lambda x: x["w"]).alias("sw"), add(lambda x: x["w"] * x["f"]).alias("sf"), add(lambda x: x["w"] * x["f"] * x["f"]).alias("sff"))
    e = ratio(F.col("sf"), F.col("sw"))
    return sums.select("code", "date", e.alias("edge"), F.greatest(ratio(F.col("sff"), F.col("sw")) - e * e, F.lit(0.0)).alias("var")).withColumn("bound", F.col("edge") - F.sqrt("var"))


def long_run(edges: DataFrame, f: str = "f") -> DataFrame:
    """One row: corr(edge, f) and the mean of f where the bound is positive."""
    return edges.agg(F.corr("edge", f).alias("corr"), F.avg(F.when(F.col("bound") > 0, F.col(f))).alias("entry_mean"), F.count_if(F.col("bound") > 0).alias("entries"))


def positions(scored: DataFrame, enter: float, leave: float) -> DataFrame:
    """FLAT and LONG by hysteresis on a score per code (D18): long from a score at or above `enter` until one below `leave`."""
    last = F.last(F.when(F.col("score") >= enter, F.lit("LONG")).when(F.col("score") < leave, F.lit("FLAT")), ignorenulls=True).over(by_code())
    return scored.withColumn("position", F.coalesce(last, F.lit("FLAT")))


def occupancy_change(states: DataFrame, k: int = DEFAULT.latent, short: int = 5, long: int = 60, limit: float = 0.1) -> DataFrame:
    """date, z, recent, usual, changed: mean daily share over the last `short` and `long` dates, and whether they are apart."""
    seen = states.where("Z_t <> -1").groupBy("date", F.col("Z_t").cast("long").alias("z")).agg(F.count(F.lit(1)).alias("n"))
    days = seen.groupBy("date").agg(F.sum("n").alias("all"))
    grid = days.crossJoin(F.broadcast(states.sparkSession.range(k).withColumnRenamed("id", "z"))).join(seen, ["date", "z"], "left")
    share = F.coalesce(F.col("n") / F.col("all"), F.lit(0.0))
    over = lambda n: F.avg(share).over(Window.partitionBy("z").orderBy("date").rowsBetween(1 - n, 0))
    out = grid.select("date", "z", over(short).alias("recent"), over(long).alias("usual"))
    return out.withColumn("changed", F.round(F.abs(F.col("recent") - F.col("usual")), 9) > limit)


def turnover(weights: DataFrame) -> DataFrame:
    """date, turnover: half the absolute change of all weights since the date before; the first date buys everything."""
    days = weights.select("date").distinct().withColumn("day", F.row_number().over(Window.orderBy("date")))
    rows = weights.join(F.broadcast(days), "date")
    moved = rows.select("day", "code", F.col("weight").alias("w")).unionByName(rows.select((F.col("day") + 1).alias("day"), "code", (-F.col("weight")).alias("w")))
    net = moved.groupBy("day", "code").agg(F.sum("w").alias("w")).groupBy("day").agg((F.sum(F.abs("w")) / 2).alias("turnover"))
    return days.join(F.broadcast(net), "day").select("date", "turnover")


def calibration(labels: DataFrame, others: DataFrame, weights: DataFrame, states: DataFrame, dates: DataFrame, split: str, p: Params = DEFAULT, limits: tuple[float, ...] = (0.05, 0.03, 0.15, 0.05)) -> DataFrame:
    """gate, value, limit, passed of four gates, all of which must pass.

    CAL-1: share of hidden states whose label differs between two fits; CAL-2: cost of the yearly turnover of the weights;
    CAL-3: largest change of a hidden state's share at a date; CAL-4: share of dates without a candidate.
    """
    a, b = labels.select("z", "label"), others.select("z", F.col("label").alias("other"))
    one = a.join(b, "z", "full").agg(F.avg((~F.col("label").eqNullSafe(F.col("other"))).cast("double")).alias("value"))
    two = turnover(weights).agg((F.avg("turnover") * p.ann * p.cost).alias("value"))
    three = occupancy(states.where("Z_t <> -1").select("date", F.col("Z_t").alias("state_id")), split).agg(F.max("drift").alias("value"))
    held = weights.select("date").distinct().withColumn("held", F.lit(True))
    four = dates.select("date").distinct().join(held, "date", "left").agg(F.avg(F.col("held").isNull().cast("double")).alias("value"))
    rows = [x.select(F.lit(f"CAL-{i}").alias("gate"), F.coalesce("value", F.lit(0.0)).alias("value"), F.lit(limit).alias("limit")) for i, (x, limit) in enumerate(zip((one, two, three, four), limits), 1)]
    return reduce(DataFrame.unionByName, rows).withColumn("passed", F.col("value") < F.col("limit"))


def bear_exposure(states: DataFrame, edge: DataFrame, dd: DataFrame, most: float = 0.5, worst: float = -0.1, reduced: float = 0.5) -> DataFrame:
    """date, score, exposure (D11): the share of a date's codes in hidden states with a negative edge.

    No position where the score is above `most`; below that `reduced` of it while the market's drawdown is at or under `worst`.
    """
    bear = edge.select(F.col("z").alias("Z_t"), (F.coalesce("e", F.lit(0.0)) < 0).cast("double").alias("bear"))
    score = states.where("Z_t <> -1").join(F.broadcast(bear), "Z_t").groupBy("date").agg(F.avg("bear").alias("score"))
    exposure = F.when(F.col("score") > most, 0.0).when(F.col("dd") <= worst, reduced).otherwise(1.0)
    return score.join(dd.select("date", "dd"), "date", "left").select("date", "score", exposure.alias("exposure"))


def variation(values: DataFrame, value: str) -> DataFrame:
    """One row: mean, sample deviation and their ratio."""
    return values.agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std")).withColumn("cv", ratio(F.col("std"), F.col("mean")))


def aggregation_rule(metrics: DataFrame, baseline: float = 1.806, least_folds: int = 4) -> DataFrame:
    """One row: mean and worst Sharpe over folds, folds passed, and whether all three are good enough."""
    m = metrics.agg(F.avg("sharpe").alias("mean_sharpe"), F.min("sharpe").alias("worst_sharpe"), F.sum(F.col("passed").cast("long")).alias("n_passed"))
    good = (F.col("mean_sharpe") > baseline) & (F.col("worst_sharpe") > 0) & (F.col("n_passed") >= least_folds)
    return m.withColumn("passed", F.coalesce(good, F.lit(False)))
