"""Drift flags by date (D12): a rolling window of dates against a reference period, in values and in hidden states."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import finite, ratio
from .split import numbered

#: Dates of a window; the limits of the stability index, the p-value and the shift of a state's share; terms of the series.
DATES, PSI, P_VALUE, SHIFT, TERMS = 5, 0.2, 0.01, 0.15, 20


def kolmogorov_p(distance: Column, n: Column, m: Column) -> Column:
    """The chance of a distance as large between samples of n and m values: the asymptotic series, with the usual correction for small samples."""
    root = F.sqrt(n * m / (n + m))
    x = (root + 0.12 + 0.11 / root) * distance
    terms = [F.lit(2.0 * (-1) ** (j - 1)) * F.exp(F.lit(-2.0 * j * j) * x * x) for j in range(1, TERMS + 1)]
    return F.when(x < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), reduce(lambda a, b: a + b, terms))))


def _windows(rows: DataFrame, dates: int) -> DataFrame:
    """rows once for each window of dates they are in; window is the last of its dates. Only whole windows count."""
    w = Window.partitionBy(F.lit(0)).orderBy("date")
    days = rows.select("date").distinct()  # one row a date
    numbers = days.select("date", F.row_number().over(w).alias("k"))
    spans = numbers.select(F.col("k"), F.col("date").alias("window")).where(F.col("k") >= dates)
    parts = numbers.select("date", F.explode(F.sequence(F.col("k"), F.col("k") + dates - 1)).alias("k"))
    return rows.join(F.broadcast(parts.join(spans, "k").select("date", "window")), "date")


def rolling_ks(rows: DataFrame, value: str, since: str, dates: int = DATES) -> DataFrame:
    """window, n, m, ks, p of the values in each window of dates from `since` on against all values before (two samples).

    Each value is ranked once among those of the reference, by ranges; a window then needs its own values only: between two of
    them its share stands still, so the largest distance is at one of them or just before it. Null, NaN and infinite values
    take no part.
    """
    late = F.col("date") >= F.lit(since).cast("date")
    kept = rows.where(finite(F.col(value))).select("date", F.col(value).alias("x"), late.alias("late"))
    cells = kept.groupBy("x").agg(F.count_if(~F.col("late")).alias("ref"))  # equal values are one
    ranked = _running(cells)
    m = kept.agg(F.count_if(~F.col("late")).alias("m"))
    own = kept.where("late").join(ranked, "x").select("date", "x", "upto", "below")
    own = _windows(own, dates)
    w = Window.partitionBy("window").orderBy("x")
    counted = own.groupBy("window", "x").agg(F.count(F.lit(1)).alias("c"), F.first("upto").alias("upto"), F.first("below").alias("below"))
    counted = counted.select("window", "c", "upto", "below", F.sum("c").over(w).alias("seen"), F.sum("c").over(Window.partitionBy("window")).alias("n"))
    counted = counted.crossJoin(F.broadcast(m))
    gap = F.greatest(F.abs(F.col("seen") / F.col("n") - F.col("upto") / F.col("m")), F.abs((F.col("seen") - F.col("c")) / F.col("n") - F.col("below") / F.col("m")))
    out = counted.select("window", "n", "m", gap.alias("g")).groupBy("window").agg(F.first("n").alias("n"), F.first("m").alias("m"), F.max("g").alias("ks"))
    return out.withColumn("p", kolmogorov_p(F.col("ks"), F.col("n").cast("double"), F.col("m").cast("double")))


def _running(cells: DataFrame) -> DataFrame:
    """x, upto, below: the reference's rows up to and under each distinct value (x, ref); no single task sorts them.

    A value's rows of the reference are marks of as many copies, so values of many are split before they are numbered.
    """
    copies = cells.select(F.lit(0).alias("k"), "x", F.explode(F.sequence(F.lit(0), F.greatest(F.col("ref"), F.lit(1)) - 1)).alias("i"), (F.col("ref") > 0).alias("is_ref"))
    ranked = numbered(copies.select("k", "x", "is_ref"), ["k"], "x", "is_ref")
    return ranked.groupBy("x").agg(F.max("n_marked").alias("upto"), (F.min("n_marked") - F.max(F.col("is_ref").cast("int"))).alias("below"))


def rolling_shares(states: DataFrame, since: str, dates: int = DATES, eps: float = 1e-6) -> DataFrame:
    """window, psi, shift: the hidden states' shares in each window of dates against all rows before `since`."""
    late = F.col("date") >= F.lit(since).cast("date")
    rows = states.where("Z_t >= 0").select("date", F.col("Z_t").alias("z"), late.alias("late"))
    usual = rows.groupBy("z").agg(F.count_if(~F.col("late")).alias("a"))  # one row a hidden state
    usual = usual.crossJoin(F.broadcast(usual.agg(F.sum("a").alias("all")))).select("z", ratio(F.col("a"), F.col("all")).alias("usual"))
    recent = _windows(rows.where("late").groupBy("date", "z").agg(F.count(F.lit(1)).alias("b")), dates).groupBy("window", "z").agg(F.sum("b").alias("b"))
    grid = recent.select("window").distinct().crossJoin(F.broadcast(usual))
    both = grid.join(recent, ["window", "z"], "left").withColumn("b", F.coalesce("b", F.lit(0)))
    both = both.select("window", "usual", (F.col("b") / F.sum("b").over(Window.partitionBy("window"))).alias("recent"))
    a, b = (F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(eps)) for c in ("usual", "recent"))
    return both.groupBy("window").agg(F.sum((b - a) * F.ln(b / a)).alias("psi"), F.max(F.abs(F.col("recent") - F.col("usual"))).alias("shift"))


def drift_flags(rows: DataFrame, states: DataFrame, changes: DataFrame, value: str, since: str, dates: int = DATES, psi: float = PSI, p: float = P_VALUE, shift: float = SHIFT) -> DataFrame:
    """date, ks, p, psi, shift, drift, excluded, retrain: any of three limits, unless a regime change is flagged on the date.

    changes: date, changed (some hidden state's share has moved, D13).
    """
    both = rolling_ks(rows, value, since, dates).join(rolling_shares(states, since, dates), "window", "full")
    drift = (F.coalesce("psi", F.lit(0.0)) > psi) | (F.coalesce("p", F.lit(1.0)) < p) | (F.coalesce("shift", F.lit(0.0)) > shift)
    flagged = changes.groupBy("date").agg(F.max("changed").alias("changed"))
    out = both.withColumnRenamed("window", "date").join(flagged, "date", "left").withColumn("excluded", F.coalesce("changed", F.lit(False)))
    return out.select("date", "ks", "p", "psi", "shift", drift.alias("drift"), "excluded", (drift & ~F.col("excluded")).alias("retrain"))
