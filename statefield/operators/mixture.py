"""Gaussian mixtures with full covariances by expectation-maximisation.

A step is one aggregation: of each component the sums of responsibilities, of values and of their products under them, which merge
over parts. Densities are column expressions made from the parameters, a few numbers a component, so rows stay in the JVM.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import finite
from .latent import fit_centres

#: Added to the variances of each step.
RIDGE = 1e-6


@dataclass
class Mixture:
    """weights (k), means (k, d), covariances (k, d, d)."""

    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray

    def log_densities(self, cols: list[str]) -> list[Column]:
        """log(weight x density) of each component."""
        out = []
        for w, mean, cov in zip(self.weights, self.means, self.covariances):
            inverse, d = np.linalg.inv(cov), [F.col(c) - F.lit(float(m)) for c, m in zip(cols, mean)]
            terms = [d[i] * d[j] * F.lit(float(inverse[i, j] * (1 if i == j else 2))) for i in range(len(cols)) for j in range(i, len(cols))]
            level = math.log(w) - 0.5 * (len(cols) * math.log(2 * math.pi) + float(np.linalg.slogdet(cov)[1]))
            out.append(F.lit(level) - F.lit(0.5) * reduce(lambda a, b: a + b, terms))
        return out


def responsibilities(df: DataFrame, cols: list[str], model: Mixture) -> DataFrame:
    """df with g0, g1, .., the chance of each component, and ll, the row's log-likelihood; rows without finite values are left out."""
    ok = reduce(lambda a, b: a & b, (finite(F.col(c)) for c in cols))
    k = len(model.weights)
    logs = df.where(ok).select("*", *(c.alias(f"_l{i}") for i, c in enumerate(model.log_densities(cols))))
    top = logs.withColumn("_top", F.greatest(*(F.col(f"_l{i}") for i in range(k))) if k > 1 else F.col("_l0"))
    total = reduce(lambda a, b: a + b, (F.exp(F.col(f"_l{i}") - F.col("_top")) for i in range(k)))
    summed = top.withColumn("ll", F.col("_top") + F.ln(total))
    return summed.select(*df.columns, *(F.exp(F.col(f"_l{i}") - F.col("ll")).alias(f"g{i}") for i in range(k)), "ll")


def next_mixture(df: DataFrame, cols: list[str], model: Mixture, ridge: float = RIDGE) -> tuple[Mixture, float]:
    """The mixture after one step, and the mean log-likelihood of rows before it. Products are taken about the old means, which keeps their digits."""
    k, d = len(model.weights), len(cols)
    rows = responsibilities(df, cols, model)
    sums = [F.sum("ll").alias("ll"), F.count(F.lit(1)).alias("n")]
    for i in range(k):
        x = [F.col(c) - F.lit(float(m)) for c, m in zip(cols, model.means[i])]
        sums += [F.sum(f"g{i}").alias(f"w{i}"), *(F.sum(F.col(f"g{i}") * x[a]).alias(f"m{i}_{a}") for a in range(d))]
        sums += [F.sum(F.col(f"g{i}") * x[a] * x[b]).alias(f"c{i}_{a}_{b}") for a in range(d) for b in range(a, d)]
    s = rows.agg(*sums).first()
    if not s.n:
        return model, 0.0
    weights, means, covariances = np.empty(k), np.empty((k, d)), np.empty((k, d, d))
    for i in range(k):
        w = max(s[f"w{i}"], 1e-12)
        shift = np.array([s[f"m{i}_{a}"] for a in range(d)]) / w
        weights[i], means[i] = w / s.n, model.means[i] + shift
        for a in range(d):
            for b in range(a, d):
                covariances[i, a, b] = covariances[i, b, a] = s[f"c{i}_{a}_{b}"] / w - shift[a] * shift[b]
        covariances[i] += ridge * np.eye(d)
    return Mixture(weights / weights.sum(), means, covariances), s.ll / s.n


def fit_mixture(df: DataFrame, cols: list[str], k: int, iterations: int = 100, tol: float = 1e-3, seed: int = 42) -> tuple[Mixture, list[float]]:
    """The mixture that steps from clusters' centres lead to, and the mean log-likelihood of rows before each step."""
    ok = reduce(lambda a, b: a & b, (finite(F.col(c)) for c in cols))
    rows = df.where(ok).select(*cols).persist()
    try:
        spread = rows.agg(*(F.var_samp(c).alias(c) for c in cols)).first()
        cov = np.diag([max(float(spread[c] or 0.0), RIDGE) for c in cols])
        model = Mixture(np.full(k, 1 / k), fit_centres(rows, cols, k, 4, seed, 50, 1e-3), np.tile(cov, (k, 1, 1)))
        seen: list[float] = []
        for _ in range(iterations):
            after, ll = next_mixture(rows, cols, model)
            seen.append(ll)
            if len(seen) > 1 and ll - seen[-2] < tol:
                break
            model = after
    finally:
        rows.unpersist()
    return model, seen


def mixture_regimes(df: DataFrame, cols: list[str], k: int, **how) -> DataFrame:
    """df's rows with finite values, and regime, the most likely component, the first of equal ones."""
    model, _ = fit_mixture(df, cols, k, **how)
    found = responsibilities(df, cols, model)
    best = F.array_position(F.array(*(F.col(f"g{i}") for i in range(k))), F.greatest(*(F.col(f"g{i}") for i in range(k))) if k > 1 else F.col("g0")) - 1
    return found.select(*df.columns, best.cast("int").alias("regime"))
