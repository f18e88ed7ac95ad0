"""Bucketed tables, label maps, panels in one file or by parts, bars."""

import datetime
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from statefield.sources import bucketed, sinks, tables

DAY = datetime.date(2020, 1, 1)


def test_bucketed_tables_meet_without_exchange(spark):
    rows = spark.createDataFrame([(c, DAY + datetime.timedelta(i), float(i + c)) for c in range(13) for i in range(30)], "code long, date date, close double")
    states = rows.where("close % 3 > 0").select("code", "date", F.col("close").cast("long").alias("state_id"))
    regimes = rows.where("code % 2 = 0").select("code", "date", F.lit("TREND").alias("regime"))
    names = [bucketed.write_bucketed(df, n, 4) for df, n in ((rows, "raw"), (states, "states"), (regimes, "regimes"))]
    before = spark.conf.get(bucketed.SUBSET_KEYS)
    got = bucketed.joined_buckets(spark, *names).withColumn("next", F.lead("close").over(Window.partitionBy("code").orderBy("date")))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Window" in plan and "Exchange" not in plan and spark.conf.get(bucketed.SUBSET_KEYS) == before
    want = tables.joined_panel(rows, states, regimes).withColumn("next", F.lead("close").over(Window.partitionBy("code").orderBy("date")))
    key = lambda r: (r.code, r.date)
    assert sorted(got.collect(), key=key) == sorted(want.select(*got.columns).collect(), key=key)
    bucketed.drop_bucketed(spark, *names)
    assert not any(spark.catalog.tableExists(n) for n in names)


def test_label_map_comes_back(spark, tmp_path):
    labels = spark.createDataFrame([(0, "TREND"), (10, "SHOCK"), (2, None)], "z long, label string")
    path = str(tmp_path / "map")
    sinks.write_label_map(labels, path, dry=True)
    assert tables.read_label_map(spark, path).count() == 0
    sinks.write_label_map(labels, path)
    assert sorted((r.z, r.label) for r in tables.read_label_map(spark, path).where("label is not null").collect()) == [(0, "TREND"), (10, "SHOCK")]
    (tmp_path / "other.json").write_text('{\n "k": 8,\n "label_map": {"1": "RANGE"}\n}')
    assert [tuple(r) for r in tables.read_label_map(spark, str(tmp_path / "other.json")).collect()] == [(1, "RANGE")]
    (tmp_path / "none.json").write_text("{}")
    assert tables.read_label_map(spark, str(tmp_path / "none.json")).count() == 0
    sinks.write_label_map(labels.where("false"), str(tmp_path / "empty"))
    assert tables.read_label_map(spark, str(tmp_path / "empty")).count() == 0


def test_single_panel_comes_before_parts(spark, tmp_path):
    rows = spark.createDataFrame([(1, DAY, 5.0), (2, DAY, 6.0)], "code long, date date, p double")
    folder = str(tmp_path / "v")
    sinks.write_by_year(rows, folder)
    assert sorted(tables.single_or_parts(spark, folder, ["code", "p"]).collect()) == [(1, 5.0), (2, 6.0)]
    rows.where("code = 1").write.parquet(f"{folder}/panel.parquet")
    assert tables.single_or_parts(spark, folder, ["code", "p"]).collect() == [(1, 5.0)]


def boxes(path):
    return [tuple(map(float, m)) for m in re.findall(r'<rect x="([^"]+)" y="([^"]+)" width="([^"]+)" height="([^"]+)"', path.read_text())]


def test_bars_have_their_values_lengths(tmp_path):
    path = tmp_path / "a.svg"
    sinks.bar_chart([("BEAR", {"gross": -1.0, "net": -2.0}), ("B<LL", {"gross": 4.0, "net": float("nan")})], str(path), "R&D", counts=True)
    (_, y1, w1, h1), (_, y2, _, h2), (_, y3, _, h3) = boxes(path)
    assert h2 == pytest.approx(2 * h1, abs=0.2) and h3 == pytest.approx(4 * h1, abs=0.3) and w1 > 0
    assert y1 == pytest.approx(y2, abs=0.1) and y1 == pytest.approx(y3 + h3, abs=0.2)  # losses hang from the line that gains stand on
    assert "B&lt;LL" in path.read_text() and "R&amp;D" in path.read_text()
    sinks.bar_chart([(str(i), {"kl": float(i)}) for i in range(50)], str(path), across=True)
    wide = [w for _, _, w, _ in boxes(path)]
    assert len(wide) == 50 and wide[40] == pytest.approx(4 * wide[10], abs=0.3) and max(y + h for _, y, _, h in boxes(path)) < 860
    with pytest.raises(ValueError):
        sinks.bar_chart([("a", {"x": float("inf")})], str(path))
