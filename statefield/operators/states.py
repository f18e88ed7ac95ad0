"""State table: statistics, transitions, entropy, regimes, edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Params
from ..functions.columns import decode, deviation, ratio

NAMES = ["r", "sigma", "v", "flow"]


def pairs(forwarded: DataFrame) -> DataFrame:
    """Rows whose next return, next z and next state are known."""
    return forwarded.dropna(subset=["next_r", "next_r_z", "next_state"])


def state_stats(valid: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """One row for each of the possible states, visited or not."""
    stats = valid.groupBy("state_id").agg(
        F.count(F.lit(1)).alias("visits"),
        F.avg("next_r").alias("mu_r_raw"),
        deviation(F.col("next_r")).alias("sigma_r_raw"),
        F.avg("next_r_z").alias("mu_r"),
        deviation(F.col("next_r_z")).alias("sigma_r"),
        F.avg(F.when(F.col("next_state") == F.col("state_id"), 1.0).otherwise(0.0)).alias("p_stay"),
    )
    spine = valid.sparkSession.range(p.states).withColumnRenamed("id", "state_id")
    out = spine.join(stats, "state_id", "left").withColumn("visits", F.coalesce("visits", F.lit(0).cast("long")))
    return out.select("*", *(decode(F.col("state_id"), p.bins, i).alias(f"bin_{n}") for i, n in enumerate(NAMES)))


def transitions(valid: DataFrame, *by: str) -> DataFrame:
    """n and p of each seen (by.., s, s_next); rows of p add up to 1 (A3; with a regime in `by` A5)."""
    counts = valid.groupBy(*by, F.col("state_id").alias("s"), F.col("next_state").alias("s_next")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(*by, "s")))


def entropy(trans: DataFrame, eps: float = DEFAULT.eps) -> DataFrame:
    """Entropy of each seen state's row (A4)."""
    return trans.groupBy(F.col("s").alias("state_id")).agg(F.sum(-F.col("p") * F.ln(F.col("p") + eps)).alias("entropy"))


def with_entropy(table: DataFrame, trans: DataFrame, eps: float = DEFAULT.eps) -> DataFrame:
    """Unseen states have entropy 0."""
    return table.join(entropy(trans, eps), "state_id", "left").withColumn("entropy", F.coalesce("entropy", F.lit(0.0)))


def _limits() -> list[Column]:
    """Exact quantiles over the visited states."""
    at = lambda c, q: F.percentile(F.when(F.col("visits") > 0, c), F.lit(q))
    sigma, mu = F.col("sigma_r"), F.abs(F.col("mu_r"))
    return [
        at(sigma, 0.7).alias("q70_sigma"), at(sigma, 0.3).alias("q30_sigma"), at(sigma, 0.5).alias("med_sigma"),
        at(mu, 0.7).alias("q70_mu"), at(mu, 0.5).alias("med_mu"), at(F.col("entropy"), 0.5).alias("med_entropy"),
    ]


def thresholds(table: DataFrame) -> DataFrame:
    """Exact quantiles over the visited states, one row."""
    return table.agg(*_limits())


def regimes(table: DataFrame) -> DataFrame:
    """regime of each state; earlier labels take precedence.

    Quantiles come with the rows they are of, a fixed number: a state whose value is the quantile itself would meet another one, by
    the last bit, if the table were made a second time for them.
    """
    mu = F.abs(F.col("mu_r"))
    label = (
        F.when(F.col("visits") == 0, "UNKNOWN")
        .when((F.col("sigma_r") >= F.col("q70_sigma")) & (F.col("entropy") >= F.col("med_entropy")), "SHOCK")
        .when((mu >= F.col("q70_mu")) & (F.col("sigma_r") >= F.col("med_sigma")), "TREND")
        .when((F.col("sigma_r") <= F.col("q30_sigma")) & (mu < F.col("med_mu")), "RANGE")
        .otherwise("TRANSITION")
    )
    both = table.agg(*_limits(), F.collect_list(F.struct(*table.columns)).alias("_rows"))
    return both.select("*", F.inline("_rows")).select(*table.columns, label.alias("regime"))


def edges(table: DataFrame) -> DataFrame:
    """Edge columns; zero denominators give null (A10)."""
    nonzero = lambda c: F.nullif(c, F.lit(0.0))
    se = ratio(F.col("sigma_r_raw"), F.sqrt(nonzero(F.col("visits").cast("double"))))
    return table.select(
        "*",
        F.col("mu_r_raw").alias("E_raw"),
        F.col("mu_r").alias("E_z"),
        ratio(F.col("mu_r_raw"), nonzero(F.col("sigma_r_raw"))).alias("E_sharpe_raw"),
        ratio(F.col("mu_r"), nonzero(F.col("sigma_r"))).alias("E_sharpe_z"),
        (F.col("mu_r_raw") * F.col("p_stay")).alias("E_stay_raw"),
        (F.col("mu_r") * F.col("p_stay")).alias("E_stay_z"),
        ratio(F.col("mu_r_raw"), nonzero(se)).alias("t_stat"),
    )


def tradeable(edge: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """States worth trading."""
    return edge.where((F.col("E_raw") > 0) & (F.col("visits") >= p.min_visits) & (F.col("t_stat") >= p.t_least) & F.col("regime").isin(*p.regimes))


def labelled(states: DataFrame, table: DataFrame) -> DataFrame:
    """Panel rows with their state's regime (J11); the table has a fixed number of states."""
    return states.join(F.broadcast(table.select("state_id", "regime")), "state_id", "left")


def state_table(valid: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """state_stats with entropy and regime."""
    return regimes(with_entropy(state_stats(valid, p), transitions(valid), p.eps))
