"""Stability of a latent model over fits: hidden states of two fits matched by what rows they share (CAL-1), shares by year (CAL-3)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ratio


def contingency(first: DataFrame, other: DataFrame) -> DataFrame:
    """z, z_other, n: rows (code, date) by their hidden state in two fits; rows without one in either don't count."""
    a, b = first.where("Z_t >= 0").select("code", "date", F.col("Z_t").alias("z")), other.where("Z_t >= 0").select("code", "date", F.col("Z_t").alias("z_other"))
    return a.join(b.hint("merge"), ["code", "date"]).groupBy("z", "z_other").agg(F.count(F.lit(1)).alias("n"))


def assignment(gain: np.ndarray) -> np.ndarray:
    """The column of each row of a square table, each column once, with the largest sum; by shortest augmenting paths."""
    k = len(gain)
    cost = gain.max(initial=0) - gain.astype(float)
    row_price, column_price, row_of = np.zeros(k + 1), np.zeros(k + 1), np.full(k + 1, -1)
    for row in range(k):
        row_of[k], at = row, k
        least, came, used = np.full(k, np.inf), np.full(k, k), np.zeros(k + 1, bool)
        while row_of[at] >= 0:
            used[at], r = True, row_of[at]
            free = ~used[:k]
            reduced = cost[r] - row_price[r] - column_price[:k]
            better = free & (reduced < least)
            least[better], came[better] = reduced[better], at
            to = int(np.where(free, least, np.inf).argmin())
            step = least[to]
            row_price[row_of[used]] += step
            column_price[used] -= step
            least[free] -= step
            at = to
        while at != k:
            row_of[at] = row_of[came[at]]
            at = int(came[at])
    out = np.empty(k, int)
    out[row_of[:k]] = np.arange(k)
    return out


def matched(counts: DataFrame, k: int) -> DataFrame:
    """z, z_other: the pairing of all k hidden states with the most rows in common; k x k numbers come to the driver."""
    table = np.zeros((k, k))
    for r in counts.where((F.col("z") < k) & (F.col("z_other") < k)).collect():
        table[r.z, r.z_other] = r.n
    return counts.sparkSession.createDataFrame([(i, int(j)) for i, j in enumerate(assignment(table))], "z long, z_other long")


def seed_stability(first: dict[str, DataFrame], other: dict[str, DataFrame], k: int, limit: float = 0.05) -> DataFrame:
    """One row: rows_moved, labels_changed, set_changed, value, passed (CAL-1). Fits: states (code, date, Z_t), labels (z, label), kept (z).

    After matching: the share of rows in another hidden state, the share of hidden states with another label, and of the states
    kept in either fit the share that only one of them keeps. value is the larger one of the latter two.
    """
    counts = contingency(first["states"], other["states"])
    pairs = F.broadcast(matched(counts, k))
    moved = counts.join(pairs.withColumn("same", F.lit(True)), ["z", "z_other"], "left").agg((1 - ratio(F.sum(F.when(F.col("same"), F.col("n")).otherwise(0)), F.sum("n"))).alias("rows_moved"))
    renamed = other["labels"].select(F.col("z").alias("z_other"), F.col("label").alias("label_other")).join(pairs, "z_other")
    labels = first["labels"].select("z", "label").join(renamed, "z", "full").agg(F.avg((~F.col("label").eqNullSafe(F.col("label_other"))).cast("double")).alias("labels_changed"))
    kept = other["kept"].select(F.col("z").alias("z_other")).join(pairs, "z_other").select("z", F.lit(1).alias("b"))
    sets = first["kept"].select("z", F.lit(1).alias("a")).join(kept, "z", "full").agg(F.avg((F.col("a").isNull() | F.col("b").isNull()).cast("double")).alias("set_changed"))
    out = moved.crossJoin(F.broadcast(labels)).crossJoin(F.broadcast(sets))
    value = F.greatest(F.coalesce("labels_changed", F.lit(0.0)), F.coalesce("set_changed", F.lit(0.0)))
    return out.select("*", value.alias("value")).withColumn("passed", F.col("value") < limit)


def yearly_shares(states: DataFrame, limit: float = 0.15) -> DataFrame:
    """z, year, share, shift, passed: each hidden state's share of a year's rows and its change from the year before (CAL-3)."""
    rows = states.where("Z_t >= 0").groupBy(F.year("date").alias("year"), F.col("Z_t").alias("z")).agg(F.count(F.lit(1)).alias("n"))
    years, zs = rows.groupBy("year").agg(F.sum("n").alias("all")), rows.select("z").distinct()
    cells = years.crossJoin(F.broadcast(zs)).join(rows, ["year", "z"], "left")  # some years times some hidden states
    shares = cells.select("z", "year", (F.coalesce("n", F.lit(0)) / F.col("all")).alias("share"))
    shift = F.abs(F.col("share") - F.lag("share").over(Window.partitionBy("z").orderBy("year")))
    return shares.withColumn("shift", shift).withColumn("passed", F.coalesce(F.col("shift") < limit, F.lit(True)))
