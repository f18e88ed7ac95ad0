"""Rolling drift flags against samples taken one by one."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from statefield.operators import drift

DAY = datetime.date(2020, 1, 1)


def distance(a, b):
    x = np.sort(np.concatenate([a, b]))
    return np.abs(np.searchsorted(np.sort(a), x, "right") / len(a) - np.searchsorted(np.sort(b), x, "right") / len(b)).max()


def series(d, n, m):
    root = np.sqrt(n * m / (n + m))
    x = (root + 0.12 + 0.11 / root) * d
    return 1.0 if x < 0.2 else min(1.0, max(0.0, sum(2 * (-1) ** (j - 1) * np.exp(-2 * j * j * x * x) for j in range(1, 200))))


@pytest.mark.parametrize("ties", [False, True])
def test_distances_of_windows(spark, ties):
    rng = np.random.default_rng(1)
    rows = [(DAY + datetime.timedelta(i), float(np.round(v, 1) if ties else v)) for i in range(30) for v in rng.normal(0.02 * i if i > 18 else 0, 1, rng.integers(3, 12))]
    since = DAY + datetime.timedelta(20)
    df = spark.createDataFrame([*rows, (DAY, None), (since, float("nan"))], "date date, v double")
    got = {r.window: r for r in drift.rolling_ks(df, "v", str(since), 3).collect()}
    assert len(got) == 8
    usual = np.array([v for d, v in rows if d < since])
    for end, r in got.items():
        own = np.array([v for d, v in rows if since <= d and end - datetime.timedelta(2) <= d <= end])
        assert (r.n, r.m) == (len(own), len(usual)) and r.ks == pytest.approx(distance(own, usual), abs=1e-12) and r.p == pytest.approx(series(r.ks, r.n, r.m), abs=1e-9)


def test_regime_changes_exclude(spark):
    rows = spark.createDataFrame([(DAY + datetime.timedelta(i), float(j + (50 if i >= 15 else 0))) for i in range(20) for j in range(30)], "date date, v double")
    states = rows.select("date", (F.col("v") % 2).cast("long").alias("Z_t"))
    changes = spark.createDataFrame([(DAY + datetime.timedelta(17), True), (DAY + datetime.timedelta(16), False)], "date date, changed boolean")
    got = {(r.date - DAY).days: (r.drift, r.excluded, r.retrain) for r in drift.drift_flags(rows, states, changes, "v", str(DAY + datetime.timedelta(10)), 2).collect()}
    assert got[13] == (False, False, False) and got[16] == (True, False, True) and got[17] == (True, True, False) and got[18] == (True, False, True)
