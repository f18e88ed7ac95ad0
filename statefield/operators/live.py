"""Daily path: cleaned scan, causal z-scores and rank bins, signals, ingest checks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Params
from ..functions.columns import by_code, causal_moments, encode, trailing

LIVE = ["r", "sigma", "v", "l", "p"]


def clean_panel(raw: DataFrame, ingest: str = "ingest_id") -> DataFrame:
    """Padded codes, the last row by ingest order of each (date, code), rows without close or volume dropped."""
    rows = raw.withColumn("code", F.lpad(F.col("code").cast("string"), 6, "0")).withColumn("date", F.to_date("date"))
    w = Window.partitionBy("date", "code").orderBy(F.desc(ingest))
    last = rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
    return last.dropna(subset=["close", "volume"]).select("date", "code", F.col("close").cast("double").alias("close"), F.col("volume").cast("double").alias("volume"))


def first_close(raw: DataFrame, ingest: str = "ingest_id") -> DataFrame:
    """The first row by ingest order of each (date, code) that has a close."""
    w = Window.partitionBy("date", "code").orderBy(ingest)
    return raw.withColumn("_k", F.row_number().over(w)).where("_k = 1 and close is not null").select("date", "code", "close")


def live_features(panel: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """p, r, sigma, v, l with l the mean of the raw volume; incomplete rows dropped."""
    w = by_code()
    out = panel.select("code", "date", "close", "volume", F.ln("close").alias("p"), F.log1p("volume").alias("v"))
    out = out.withColumn("r", F.col("p") - F.lag("p").over(w))
    out = out.select("code", "date", "p", "r", trailing(F.col("r"), w, p.w_sigma, F.stddev_samp).alias("sigma"), "v", trailing(F.col("volume"), w, p.w_liq, F.avg).alias("l"))
    return out.dropna(subset=LIVE)


def live_z(features: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Clipped z-scores with a floor under the deviation; incomplete rows dropped."""
    m = causal_moments(features, LIVE, p.live_window)
    z = lambda c: (F.col(c) - F.col(f"mean_{c}")) / (F.greatest(F.col(f"std_{c}"), F.lit(p.std_floor)) + p.live_eps)
    out = m.select(*features.columns, *(F.when(F.col(f"std_{c}").isNotNull(), F.greatest(F.lit(-p.z_clip), F.least(F.lit(p.z_clip), z(c)))).alias(f"z_{c}") for c in LIVE))
    return out.dropna(subset=[f"z_{c}" for c in LIVE])


def bins_below(x: np.ndarray, rows: int, k: int) -> np.ndarray:
    """Bins of x[rows:] by the share of each one's previous `rows` values strictly below; x is (n, columns)."""
    out = np.empty((len(x) - rows, x.shape[1]), np.int64)
    past = np.lib.stride_tricks.sliding_window_view(x, rows, axis=0)[:-1]
    for a in range(0, len(out), 2048):
        below = (past[a : a + 2048] < x[rows + a : rows + a + 2048, :, None]).sum(2)
        out[a : a + 2048] = np.minimum(k - 1, below * k // rows)
    return out


def rank_bins(df: DataFrame, cols: list[str], rows: int, k: int) -> DataFrame:
    """df's rows that have `rows` rows of their code before them, with <col>_bin for each column.

    Values count to nine digits, so that ties don't hang on the last bit. A code's rows pass in order; only the last `rows` of
    them are held, whatever the length of its history.
    """
    kept, at, n = df.columns, [df.columns.index(c) for c in cols], len(cols)
    code = kept.index("code")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, tail = None, np.empty((0, n))
        for b in batches:
            codes = np.asarray(b.column(code).to_pylist(), object)
            x = np.round(np.column_stack([b.column(i).to_numpy(zero_copy_only=False) for i in at]), 9) if b.num_rows else np.empty((0, n))
            cuts = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), b.num_rows]
            for s, e in zip(cuts[:-1], cuts[1:]):
                if s == e:
                    continue
                if codes[s] != last:
                    last, tail = codes[s], np.empty((0, n))
                seen = np.concatenate([tail, x[s:e]])
                if len(seen) > rows:
                    found = bins_below(seen, rows, k)
                    yield pa.RecordBatch.from_arrays([*b.slice(e - len(found), len(found)).columns, *(pa.array(c) for c in found.T)], [*kept, *(f"{c}_bin" for c in cols)])
                tail = seen[-rows:]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + "".join(f", {c}_bin long" for c in cols)
    return df.repartition("code").sortWithinPartitions("code", "date").mapInArrow(run, schema)


def live_states(z: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Causal bins and state_id in base `bins` over five features."""
    out = rank_bins(z.dropna(subset=[f"z_{c}" for c in LIVE]), [f"z_{c}" for c in LIVE], p.live_window, p.bins)
    return out.withColumn("state_id", encode([F.col(f"z_{c}_bin") for c in LIVE], p.bins))


def signals(states: DataFrame, priorities: DataFrame, n: int, date: str | None = None, names: DataFrame | None = None) -> DataFrame:
    """The n tradeable codes with the largest edge on a date, by default the latest.

    priorities: state_id, edge, of the tradeable states. An unknown date raises.
    """
    day = states.agg(F.max("date").alias("d")).first()["d"] if date is None else date
    today = states.where(F.col("date") == F.lit(day).cast("date"))
    if date is not None and today.isEmpty():
        raise ValueError(f"no states on {date}")
    out = today.join(priorities, "state_id")
    out = out.join(names, "code", "left").withColumn("name", F.coalesce("name", F.lit("(unknown)"))) if names is not None else out.withColumn("name", F.lit("(unknown)"))
    return out.select("date", "code", "name", "state_id", "edge", F.lit(1.0 / n).alias("weight")).orderBy(F.desc("edge"), "code").limit(n)


def render_json(signal: DataFrame) -> DataFrame:
    """One row: the day's signals as JSON."""
    row = F.struct(F.col("code").cast("string").alias("symbol"), "state_id", F.bround("weight", 4).alias("weight"), F.bround("edge", 6).alias("edge"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("edge")).alias("k"), F.col("code").alias("c"), row.alias("s"))))
    return signal.agg(F.max("date").alias("d"), F.count(F.lit(1)).alias("n_signals"), ranked.alias("x")).select(F.to_json(F.struct(F.date_format("d", "yyyy-MM-dd").alias("date"), "n_signals", F.transform("x", lambda v: v["s"]).alias("signals"))).alias("report"))


def render_text(signal: DataFrame) -> DataFrame:
    """One row: the day's signals as text (K8)."""
    line = F.format_string("  BUY: %s %-10s (state=%d, edge=%+.4f, w=%.2f)", F.col("code").cast("string"), "name", "state_id", "edge", "weight")
    lines = F.array_sort(F.collect_list(F.struct((-F.col("edge")).alias("k"), F.col("code").alias("c"), line.alias("t"))))
    out = signal.agg(F.max("date").alias("d"), F.count(F.lit(1)).alias("n"), lines.alias("x"))
    head = F.concat(F.lit("["), F.date_format("d", "yyyy-MM-dd"), F.lit("]\n"))
    return out.select(F.when(F.col("n") == 0, F.lit("  (no signal)")).otherwise(F.concat(head, F.format_string("  signals: %d\n", "n"), F.array_join(F.transform("x", lambda v: v["t"]), "\n"))).alias("report"))


def previous_close(panel: DataFrame) -> DataFrame:
    """Last close per code."""
    return panel.groupBy("code").agg(F.max_by("close", "date").alias("prev_close"))


def change_rate(landed: DataFrame, previous: DataFrame) -> DataFrame:
    """change_rate against the row before in the batch, else the last close known, else as delivered."""
    w = by_code()
    prev = F.coalesce(F.lag("close").over(w), F.col("prev_close"))
    return landed.join(previous, "code", "left").withColumn("change_rate", F.coalesce(F.try_divide(F.col("close"), prev) - 1, F.col("change_rate"))).drop("prev_close")


def year_boundaries(panel: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """First rows of a year whose change_rate differs from the chained closes beyond the tolerance."""
    w = by_code()
    rows = panel.select("*", F.lag(F.year("date")).over(w).alias("_y"), F.lag("close").over(w).alias("_c")).where(F.col("_y") != F.year("date"))
    return rows.withColumn("expected", F.try_divide(F.col("close"), F.col("_c")) - 1).where(F.abs(F.col("expected") - F.col("change_rate")) > tolerance).drop("_y", "_c")


def leaked(panel: DataFrame, universe: DataFrame) -> DataFrame:
    """Codes outside the universe."""
    return panel.select("code").distinct().join(universe.select("code"), "code", "left_anti")
