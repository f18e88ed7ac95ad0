"""Sinks: panels by year, idempotent appends, JSON reports, charts."""

from __future__ import annotations

import html
import json
import logging
import math
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The columns of a written state vector, in order.
STATE_COLUMNS = ["date", "code", "close", "p", "r", "sigma", "v", "l", "flow", "z_r", "z_sigma", "z_v", "z_flow", "bin_r", "bin_sigma", "bin_v", "bin_flow", "state_id"]


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share, spark.checkpoint.dir; only a local session may do without one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="statefield-")
        spark.conf.set("spark.checkpoint.dir", where)
    return f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read back: cuts the lineage and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_by_year(df: DataFrame, path: str, columns: list[str] | None = None, dry: bool = False) -> DataFrame:
    """Writes rows under year=YYYY folders (K1); dry: everything but the write."""
    out = df.select(*(columns or df.columns)).withColumn("year", F.year("date"))
    if not dry:
        out.repartition("year", F.pmod(F.xxhash64("code"), F.lit(16))).sortWithinPartitions("year", "code", "date").write.partitionBy("year").mode("overwrite").parquet(path)
    return out


def write_state_vector(states: DataFrame, path: str, dry: bool = False) -> DataFrame:
    """The warmed-up rows and 18 columns of the state vector (K1)."""
    return write_by_year(states.where("state_id is not null"), path, STATE_COLUMNS, dry)


def write_tables(tables: dict[str, DataFrame], path: str, dry: bool = False) -> None:
    """Each table under its name (K2, K4 to K6)."""
    for name, df in {} if dry else tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def write_meta(spark: SparkSession, path: str, values: dict, dry: bool = False) -> str:
    """A JSON file of settings and counts beside tables (K4 to K6); NaN and infinities become null."""
    clean = lambda x: {k: clean(v) for k, v in x.items()} if isinstance(x, dict) else [clean(v) for v in x] if isinstance(x, (list, tuple)) else None if isinstance(x, float) and not math.isfinite(x) else x
    text = json.dumps(clean(values), allow_nan=False, default=str)
    if not dry:
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return text


def write_label_map(labels: DataFrame, path: str, dry: bool = False) -> DataFrame:
    """z, label of hidden states as a JSON file with a label_map (S9); the map has one entry a state. Without states it is empty."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col("z").cast("string").alias("z"), "label")))
    out = labels.agg(F.to_json(F.struct(F.map_from_entries(pairs).alias("label_map"))).alias("value"))
    if not dry:
        out.write.mode("overwrite").text(path)
    return out


def new_rows(landed: DataFrame, existing: DataFrame, keys: tuple[str, ...] = ("date", "code")) -> DataFrame:
    """Landed rows, one for each key, whose key isn't there yet."""
    return landed.dropDuplicates(list(keys)).join(existing.select(*keys).hint("merge"), list(keys), "left_anti")


def append_new(landed: DataFrame, path: str, dry: bool = False) -> DataFrame:
    """Appends rows with new keys; repeating it changes nothing (K3)."""
    spark = landed.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)
    fresh = landed.dropDuplicates(["date", "code"])
    if there:
        years = [r[0] for r in landed.select(F.year("date")).distinct().collect()]
        fresh = new_rows(landed, spark.read.parquet(path).where(F.col("year").isin(years)))
    fresh = fresh.withColumn("year", F.year("date"))
    if not dry:
        fresh.write.partitionBy("year").mode("append").parquet(path)
    return fresh


def finite_tree(x) -> bool:
    """Whether a nested report has neither NaN nor infinities."""
    if isinstance(x, dict):
        return all(map(finite_tree, x.values()))
    if isinstance(x, (list, tuple)):
        return all(map(finite_tree, x))
    return not isinstance(x, float) or math.isfinite(x)


def report_json(parts: dict[str, DataFrame | dict], path: str | None = None) -> str:
    """A report of small tables as JSON; NaN and infinities raise (K7)."""
    tree = {k: [r.asDict(recursive=True) for r in v.collect()] if isinstance(v, DataFrame) else v for k, v in parts.items()}
    if not finite_tree(tree):
        raise ValueError("a report value isn't finite")
    text = json.dumps(tree, allow_nan=False, default=str, indent=1)
    if path:
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
    return text


def line_chart(series: dict[str, list[tuple[float, float]]], path: str, title: str = "", width: int = 900, height: int = 400) -> None:
    """Lines over a common pair of axes as an SVG file (K9); series without points are left out."""
    shown = {k: [(float(x), float(y)) for x, y in v if math.isfinite(x) and math.isfinite(y)] for k, v in series.items()}
    points = [p for v in shown.values() for p in v]
    if not points:
        raise ValueError("nothing to draw")
    (x0, x1), (y0, y1) = ((min(v), max(v)) for v in zip(*points))
    at = lambda v, a, b, n: round(40 + (v - a) / ((b - a) or 1.0) * (n - 60), 1)
    lines = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}"><text x="40" y="16">{html.escape(title)}</text>', f'<text x="2" y="{height - 36}">{y0:.4g}</text><text x="2" y="30">{y1:.4g}</text>']
    for i, (name, v) in enumerate(shown.items()):
        if v:
            trail = " ".join(f"{at(x, x0, x1, width)},{round(height - at(y, y0, y1, height), 1)}" for x, y in sorted(v))
            colour = f"hsl({i * 360 // len(shown)},60%,45%)"
            lines.append(f'<polyline fill="none" stroke="{colour}" points="{trail}"/><text x="{50 + 140 * i}" y="{height - 8}" fill="{colour}">{html.escape(name)}</text>')
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join([*lines, "</svg>"]))


def bar_chart(bars: list[tuple[str, dict[str, float]]], path: str, title: str = "", across: bool = False, counts: bool = False, width: int = 900) -> None:
    """Bars by label, one beside the other for each series, as an SVG file (K9).

    across: bars go to the right, one label a line, and the picture grows with them; counts: each bar has its value at its end.
    Values that aren't finite are left out; without any, nothing is drawn and a ValueError raised.
    """
    names = list(dict.fromkeys(n for _, values in bars for n in values))
    shown = [(i, j, float(values[n])) for i, (_, values) in enumerate(bars) for j, n in enumerate(names) if n in values and math.isfinite(values[n])]
    if not shown:
        raise ValueError("nothing to draw")
    height = max(400, 60 + 16 * len(bars)) if across else 400
    low, high = min(0.0, *(v for *_, v in shown)), max(0.0, *(v for *_, v in shown))
    long, wide = (width - 160, height - 60) if across else (height - 80, width - 80)
    size, slot = (lambda v: (v - low) / ((high - low) or 1.0) * long), wide / len(bars)
    thick = 0.8 * slot / len(names)
    lines = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}"><text x="40" y="16">{html.escape(title)}</text>']

    def place(a: float, b: float, off: float, thick: float) -> tuple[float, ...]:
        """x, y, width and height of a bar from value a to b, `off` along the labels."""
        at, end = size(min(a, b)), size(max(a, b))
        return tuple(round(v, 1) for v in ((100 + at, 30 + off, end - at, thick) if across else (40 + off, 30 + long - end, thick, end - at)))

    for i, j, v in shown:
        x, y, w, h = place(0.0, v, slot * (i + 0.1) + thick * j, thick)
        lines.append(f'<rect x="{x}" y="{y}" width="{w}" height="{h}" fill="hsl({j * 360 // len(names)},60%,45%)"><title>{html.escape(names[j])} {v:.6g}</title></rect>')
        if counts:
            lines.append(f'<text x="{x + w + 4 if across else x}" y="{y + h if across else y - 4}">{v:.6g}</text>')
    for i, (label, _) in enumerate(bars):
        x, y = (4, 30 + slot * (i + 0.7)) if across else (40 + slot * (i + 0.1), height - 28)
        lines.append(f'<text x="{x:.1f}" y="{y:.1f}">{html.escape(label)}</text>')
    if len(names) > 1:
        lines += [f'<text x="{50 + 140 * j}" y="{height - 8}" fill="hsl({j * 360 // len(names)},60%,45%)">{html.escape(n)}</text>' for j, n in enumerate(names)]
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join([*lines, "</svg>"]))


def charts(drawings: dict[str, Callable[[str], None]], folder: str) -> list[str]:
    """Draws each chart to an SVG file; one that fails doesn't stop the others (K9)."""
    done = []
    for name, draw in drawings.items():
        try:
            draw(f"{folder}/{name}.svg")
            done.append(name)
        except Exception:
            logging.getLogger(__name__).warning("chart %s failed", name, exc_info=True)
    return done
