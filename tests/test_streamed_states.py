"""The daily path as a stream against the whole history computed at once."""

import datetime
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from statefield.config import DEFAULT
from statefield.operators import live
from statefield.streaming import live as streamed

P = replace(DEFAULT, live_window=12, w_sigma=5, w_liq=4)
DAY = datetime.date(2020, 1, 1)
SCHEMA = "code string, date date, close double, volume double, ingest_id long"


def history(codes=4, n=90, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(codes):
        close = 50 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
        for i in range(n):
            rows.append((f"c{c}", DAY + datetime.timedelta(i), float(0.0 if rng.random() < 0.03 else close[i]), float(rng.integers(1, 1000)), 1))
    return rows


def at_once(spark, rows):
    last = {(r[0], r[1]): r for r in rows}
    panel = spark.createDataFrame([r[:4] for r in last.values()], "code string, date date, close double, volume double").withColumn("close", F.when(F.col("close") > 0, F.col("close")))
    found = live.live_states(live.live_z(live.live_features(panel, P), P), P)
    return sorted((r.code, r.date, r.state_id) for r in found.collect())


def landed(spark, tmp_path, slices, late_rows):
    path, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    for s in slices:
        spark.createDataFrame(s, SCHEMA).repartition(2).write.mode("append").parquet(path)
        streamed.run_states(spark, path, spark.createDataFrame([], SCHEMA).schema, target, checkpoint, P, late_rows)
    return spark.read.parquet(target)


@pytest.mark.parametrize("kind", ["in order", "late and corrected"])
def test_slices_equal_the_whole(spark, tmp_path, kind):
    rows = history()
    if kind == "in order":
        slices = [[r for r in rows if a <= (r[1] - DAY).days < z] for a, z in ((0, 40), (40, 41), (41, 90))]
    else:
        rng = np.random.default_rng(1)
        slices, final = [[], [], []], []
        for r in rows:
            i = (r[1] - DAY).days
            k = 0 if i < 45 else 1 if i < 70 else 2
            near_end = k < 2 and i >= (45, 70)[k] - 6
            if near_end and rng.random() < 0.3:
                slices[k + 1].append(r)
            elif near_end and rng.random() < 0.5:
                slices[k].append((*r[:2], float(rng.choice([0.0, 7.0])), 1.0, 1))
                slices[k + 1].append(r)
            else:
                slices[k].append(r)
                if rng.random() < 0.05:  # an older copy of the same row in the same batch
                    slices[k].append((*r[:2], 1.0, 1.0, 0))
    found = landed(spark, tmp_path, slices, late_rows=8)
    assert found.where("too_late").isEmpty()
    got = sorted((r.code, r.date, r.state_id) for r in streamed.current_states(found).collect())
    assert len(got) > 100 and got == at_once(spark, rows)


def test_what_is_too_late_is_returned_and_changes_nothing(spark, tmp_path):
    rows = history(codes=1)
    held = rows[20]
    found = landed(spark, tmp_path, [[r for r in rows if r is not held][:70], [held, *rows[70:]]], late_rows=8)
    assert [(r.code, r.date, r.state_id) for r in found.where("too_late").collect()] == [(held[0], held[1], -1)]
    got = sorted((r.code, r.date, r.state_id) for r in streamed.current_states(found).collect())
    assert got == at_once(spark, [r for r in rows if r is not held])


def test_state_is_bounded_and_cut_rows_are_not_needed():
    rng = np.random.default_rng(0)
    n = 2000
    close, volume = 50 * np.exp(np.cumsum(rng.normal(0, 0.02, n))), rng.integers(1, 100, n).astype(float)
    close[rng.random(n) < 0.02] = -1
    at, bins, cut = streamed.live_rows(close, volume, n - 8, P)
    assert n - cut < 100
    again, same, _ = streamed.live_rows(close[cut:], volume[cut:], n - 8 - cut, P)
    assert (again + cut).tolist() == at.tolist() and same.tolist() == bins.tolist()
    less, other, _ = streamed.live_rows(close[cut + 25 :], volume[cut + 25 :], n - 8 - cut - 25, P)
    assert len(less) < len(at) or (other != bins).any()


def test_a_code_and_micro_batch_pass_over_the_history_once(monkeypatch):
    class Value:
        now = None

        def get(self):
            return self.now

        def exists(self):
            return self.now is not None

        def update(self, value):
            self.now = value

    class Handle:
        def getValueState(self, *a):
            return Value()

    calls, real = [], streamed.live_rows
    monkeypatch.setattr(streamed, "live_rows", lambda *a: calls.append(a) or real(*a))
    rows = pd.DataFrame([((r[1] - DAY).days, *r[2:]) for r in history(1)], columns=["day", "close", "volume", "ingest_id"])
    one = streamed.LiveStates(P, 20)
    one.init(Handle())
    found = list(one.handleInputRows(("c0",), iter([rows.iloc[30:60], rows.iloc[:30], rows.iloc[30:40].assign(close=1.0, ingest_id=0)]), None))
    assert len(calls) == 1 and [len(x) for x in found] == [len(real(rows.close[:60].to_numpy(), rows.volume[:60].to_numpy(), 0, P)[0])]
    assert (one.tail.now[0], one.tail.now[3]) == (np.arange(real(rows.close[:60].to_numpy(), rows.volume[:60].to_numpy(), 40, P)[2], 60).tobytes(), 1)
