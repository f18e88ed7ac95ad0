"""The daily path as a stream: keyed state for each code, with late and corrected rows.

Rows (code, date, close, volume) come in any order and any number at a time. The state of a code is the end of its history, as
far back as the rows that may still change need: their bins look at `live_window` complete rows before them, and the z-scores
of these at as many again. A row that comes late, or once more with other values, is put in its place, and the rows after it
are worked out anew, so that the table of all results, the last version of each row, is at any time that of the whole history
computed at once. What comes later than `late_rows` rows of its code is returned as such, and changes nothing.

The work of a micro-batch grows with its rows and the window, not with the history, and a code's state with the window alone.
State is on disk (RocksDB) and restarts from the checkpoint.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import DEFAULT, Params
from ..operators.live import LIVE, bins_below

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_EPOCH = datetime.date(1970, 1, 1).toordinal()
BINS = [f"z_{c}_bin" for c in LIVE]


def _moments(x: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each `rows` values of x in a row, some thousand windows at a time."""
    windows = np.lib.stride_tricks.sliding_window_view(x, rows, axis=0)
    parts = [windows[a : a + 4096] for a in range(0, len(windows), 4096)]
    return np.concatenate([w.mean(-1) for w in parts]), np.concatenate([w.std(-1, ddof=1) for w in parts])


def live_rows(close: np.ndarray, volume: np.ndarray, first: int, p: Params, open_from: int | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """(positions, bins) of the rows from `first` on that have a state, and the position that the values of the rows from `open_from` on
    (without it, from `first` on) hang on from.

    Rows without features and rows without z-scores don't count in the windows after them, as in operators.live.
    """
    n, w, k = len(close), p.live_window, p.bins
    with np.errstate(divide="ignore", invalid="ignore"):
        logs, v = np.log(np.where(close > 0, close, np.nan)), np.log1p(volume)
        r = np.concatenate([[np.nan], np.diff(logs)])
        sigma, level = np.full(n, np.nan), np.full(n, np.nan)
        if n >= p.w_sigma:
            sigma[p.w_sigma - 1 :] = _moments(r, p.w_sigma)[1]
        if n >= p.w_liq:
            level[p.w_liq - 1 :] = _moments(volume, p.w_liq)[0]
    x = np.column_stack([r, sigma, v, level, logs])
    full = np.flatnonzero(np.isfinite(x).all(1))  # the rows with features, by position
    x = x[full]
    z_at = full[w:]
    if len(x) > w:
        mean, deviation = _moments(x[:-1], w)
        z = (x[w:] - mean) / (np.maximum(deviation, p.std_floor) + p.live_eps)
        z = np.round(np.clip(z, -p.z_clip, p.z_clip), 9)
    else:
        z = np.empty((0, len(LIVE)))
    # of the rows from `first` on: the first with a state, and how far back its windows reach
    start = max(w, int(np.searchsorted(z_at, first)))
    new = z[start - w :] if len(z) > start else z[:0]
    bins = bins_below(new, w, k) if len(new) else np.empty((0, len(LIVE)), np.int64)
    reach = lambda at: int(full[at]) - max(p.w_sigma, p.w_liq)
    oldest = int(np.searchsorted(z_at, first if open_from is None else open_from)) - w
    return z_at[start:], bins, max(0, reach(oldest)) if oldest >= 0 else 0


class LiveStates(StatefulProcessor):
    """The end of a code's history, as three arrays, and the number of its versions."""

    def __init__(self, p: Params, late_rows: int):
        self.p, self.late_rows = p, late_rows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tail = handle.getValueState("tail", "dates binary, closes binary, volumes binary, version long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        frames = list(rows)
        taken = [np.concatenate([f[c].to_numpy() for f in frames]) for c in ("day", "close", "volume", "ingest_id")]
        order = np.lexsort((taken[3], taken[0]))
        order = order[np.append(np.diff(taken[0][order]) != 0, True)]  # of each day the row with the largest ingest_id
        day, close, volume = (x[order].astype(t) for x, t in zip(taken, (np.int64, np.float64, np.float64)))
        days, closes, volumes, version = np.empty(0, np.int64), np.empty(0), np.empty(0), 0
        if (tail := self.tail.get()) is not None:
            d, c, v, version = tail
            days, closes, volumes = (np.frombuffer(x, t) for x, t in ((d, np.int64), (c, np.float64), (v, np.float64)))
        version += 1
        # what is older than the last late_rows rows can't be put in its place any more
        bound = days[-self.late_rows] if len(days) >= self.late_rows else None
        too_late = day < bound if bound is not None else np.zeros(len(day), bool)
        if too_late.any():
            late = day[too_late]
            yield self._shown(key, late, np.full((len(late), len(LIVE)), -1), version, True)
            day, close, volume = (x[~too_late] for x in (day, close, volume))
        if len(day):
            before, kept = days, ~np.isin(days, day)
            days = np.concatenate([days[kept], day])
            order = np.argsort(days, kind="stable")
            days = days[order]
            closes = np.concatenate([closes[kept], close])[order]
            volumes = np.concatenate([volumes[kept], volume])[order]
            first = int(np.searchsorted(days, day[0]))
            at, bins, cut = live_rows(closes, volumes, first, self.p, max(0, len(days) - self.late_rows))
            if len(at):
                yield self._shown(key, days[at], bins, version, False)
            # rows that a corrected one may have taken their state from
            none = np.setdiff1d(np.intersect1d(days[first:], before), days[at])
            if len(none):
                yield self._shown(key, none, np.full((len(none), len(LIVE)), -1), version, False)
            days, closes, volumes = days[cut:], closes[cut:], volumes[cut:]
        self.tail.update((days.tobytes(), closes.tobytes(), volumes.tobytes(), version))

    def _shown(self, key: Any, days: np.ndarray, bins: np.ndarray, version: int, late: bool) -> pd.DataFrame:
        state = np.where(bins[:, 0] < 0, -1, bins @ self.p.bins ** np.arange(len(LIVE)))
        n = len(days)
        columns = {"code": np.repeat(key[0], n), "day": days.astype(np.int32), **dict(zip(BINS, bins.T)), "state_id": state}
        return pd.DataFrame(columns | {"version": np.full(n, version, np.int64), "too_late": np.full(n, late)}, copy=False)

    def close(self) -> None:
        pass


def stream_states(rows: DataFrame, p: Params = DEFAULT, late_rows: int = 20) -> DataFrame:
    """code, date, z_<c>_bin, state_id, version, too_late for a stream of code, date, close, volume, ingest_id.

    A row is returned once, and again with a higher version whenever an earlier one comes late or is corrected. Of several rows
    of a code and date in one micro-batch the one with the largest ingest_id counts, and later micro-batches replace earlier
    ones. Where a row has no state, or no more, bins and state_id are -1. Rows without code, date, close or volume are left out.
    """
    code = dict(rows.dtypes)["code"]
    keyed = rows.dropna(subset=["code", "date", "close", "volume"])
    keyed = keyed.select("code", F.datediff("date", F.lit("1970-01-01").cast("date")).alias("day"), F.col("close").cast("double").alias("close"), F.col("volume").cast("double").alias("volume"), "ingest_id")
    out = keyed.groupBy("code").transformWithStateInPandas(
        LiveStates(p, late_rows), f"code {code}, day int, " + ", ".join(f"{b} long" for b in BINS) + ", state_id long, version long, too_late boolean", outputMode="Append", timeMode="None"
    )
    return out.select("code", F.date_add(F.lit("1970-01-01").cast("date"), "day").alias("date"), *BINS, "state_id", "version", "too_late")


def run_states(spark: SparkSession, landing: str, schema: str, target: str, checkpoint: str, p: Params = DEFAULT, late_rows: int = 20, files: int = 1000) -> None:
    """Takes in all files that have landed since the checkpoint, at most `files` at a time, appends their states to target, stops."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    try:
        landed = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(landing)
        query = stream_states(landed, p, late_rows).writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target)
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def current_states(found: DataFrame) -> DataFrame:
    """The last version of each row that run_states wrote, if it has a state."""
    w = Window.partitionBy("code", "date").orderBy(F.desc("version"))
    return found.where("not too_late").withColumn("_k", F.row_number().over(w)).where("_k = 1 and state_id >= 0").drop("_k", "version", "too_late")
