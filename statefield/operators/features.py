"""Features of the daily panel: returns, volatility, liquidity, flow, causal z-scores, bins and states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Params
from ..functions.columns import by_code, causal_moments, encode, equal_frequency_bin, finite, ratio, trailing

Z = ["r", "sigma", "v", "flow"]


def raw_features(panel: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """p, v, r, sigma, l, flow from close, volume, trade_value (W1, W2). Non-positive closes have no logarithm."""
    w = by_code()
    out = panel.select("*", F.ln(F.when(F.col("close") > 0, F.col("close"))).alias("p"), F.log1p("volume").alias("v"), F.log1p("trade_value").alias("_tv"))
    out = out.select("*", (F.col("p") - F.lag("p").over(w)).alias("r"), (F.col("_tv") - F.lag("_tv").over(w)).alias("flow")).drop("_tv")
    return out.select("*", trailing(F.col("r"), w, p.w_sigma, F.stddev_samp).alias("sigma"), trailing(F.col("v"), w, p.w_liq, F.avg).alias("l"))


def z_scores(df: DataFrame, cols: list[str] = Z, rows: int = DEFAULT.w_z) -> DataFrame:
    """z_<c> against the previous `rows` rows, this one excluded; a zero deviation gives null."""
    moments = causal_moments(df, cols, rows)
    z = [ratio(F.col(c) - F.col(f"mean_{c}"), F.nullif(F.col(f"std_{c}"), F.lit(0.0))).alias(f"z_{c}") for c in cols]
    return moments.select(*df.columns, *z)


def discretize(df: DataFrame, cols: list[str] = Z, p: Params = DEFAULT) -> DataFrame:
    """bin_<c> over each code's whole history, and state_id (W4, W17, P4). The bins look ahead; see live.rank_bins."""
    out = df.select("*", *(equal_frequency_bin(f"z_{c}", p.bins).alias(f"bin_{c}") for c in cols))
    return out.withColumn("state_id", encode([F.col(f"bin_{c}") for c in cols], p.bins))


def state_vector(panel: DataFrame, p: Params = DEFAULT) -> DataFrame:
    return discretize(z_scores(raw_features(panel, p), Z, p.w_z), Z, p)


def warmed_up(states: DataFrame) -> DataFrame:
    """Rows that have a state."""
    return states.where(F.col("state_id").isNotNull())


def forward(states: DataFrame) -> DataFrame:
    """next_r, next_r_z, next_state over the retained rows."""
    w = by_code()
    return states.select("*", *(F.lead(c).over(w).alias(n) for c, n in (("r", "next_r"), ("z_r", "next_r_z"), ("state_id", "next_state"))))


def valid_mask(df: DataFrame, cols: list[str]) -> DataFrame:
    """valid: all of cols finite."""
    ok = finite(F.col(cols[0]))
    for c in cols[1:]:
        ok = ok & finite(F.col(c))
    return df.withColumn("valid", ok)


def horizon_return(df: DataFrame, h: int) -> DataFrame:
    """ret_h and exit_date, h retained rows ahead."""
    w = by_code()
    return df.select("*", (ratio(F.lead("close", h).over(w), F.col("close")) - 1).alias("ret_h"), F.lead("date", h).over(w).alias("exit_date"))


def daily_return(df: DataFrame) -> DataFrame:
    """ret_d: simple return from the code's previous row."""
    return df.withColumn("ret_d", ratio(F.col("close"), F.lag("close").over(by_code())) - 1)
