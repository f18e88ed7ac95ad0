"""Windows in blocks and ranks by ranges against windows by code."""

import datetime

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from statefield.config import Params
from statefield.operators import features, latent, split

P = Params(w_sigma=4, w_liq=3, w_z=9)
DAY = datetime.date(2001, 1, 1)


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(6)
    rows = []
    for code, n in (("a", 500), ("b", 37), ("c", 1), ("d", 60)):
        for i in range(n):
            rows.append((code, DAY + datetime.timedelta(i), float(np.exp(rng.normal())) if rng.random() > 0.02 else None, float(rng.integers(1, 5)) + 1e-3 * float(rng.random()), float(rng.random())))
    return spark.createDataFrame(rows, "code string, date date, close double, volume double, trade_value double").repartition(3).cache()


def near(a, b):
    return a is None and b is None or a is not None and b is not None and abs(a - b) < 1e-9


def test_states_equal_those_of_whole_codes(spark, panel):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    try:
        got = {(r.code, r.date): r for r in split.state_vector(panel, P, 20).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = {(r.code, r.date): r for r in features.state_vector(panel, P).collect()}
    assert set(got) == set(want) and len([r for r in want.values() if r.state_id is not None]) > 300
    for k, w in want.items():
        assert all(near(got[k][c], w[c]) for c in ("r", "sigma", "l", "flow", "z_r", "z_sigma", "z_v", "z_flow")), k
        assert got[k].state_id == w.state_id


def test_numbers_ranks_and_counts(spark, panel):
    w = Window.partitionBy("code")
    rows = panel.withColumn("odd", F.floor("volume") % 2 == 1)
    got = split.numbered(rows, ["code"], "date", "odd").select("code", "date", "n_rows", "n_marked").collect()
    want = rows.select("code", "date", (F.row_number().over(w.orderBy("date")) - 1).alias("n_rows"), F.sum(F.col("odd").cast("int")).over(w.orderBy("date")).alias("n_marked")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    ties = panel.where("close is not null").withColumn("close", F.round("close", 1))
    by_value = split.numbered(ties, ["code"], "close").select("code", "date", "n_less").collect()
    ranks = ties.select("code", "date", (F.rank().over(w.orderBy("close")) - 1).alias("n_less")).collect()
    assert sorted(map(tuple, by_value)) == sorted(map(tuple, ranks))


def test_sequences_equal_those_of_whole_codes(panel):
    df = panel.withColumn("valid", F.col("close").isNotNull() & (F.col("volume") > 1))
    show = lambda x: sorted((r.code, r.date, r.seq_id) for r in x.collect())
    assert show(split.sequences(df)) == show(latent.sequences(df))


def test_a_long_code_is_many_tasks(panel):
    rows = split.numbered(panel.where("code = 'a'"), ["code"], "date")
    seen = []
    split.in_blocks(rows, lambda df: seen.append(df.select("code").distinct().count()) or df, 10, 50).count()
    assert seen == [11]  # ten blocks, and one of a halo alone
    with pytest.raises(ValueError):
        split.in_blocks(rows, lambda df: df, 50, 50)


def test_empty_tables(panel):
    assert split.state_vector(panel.where("false"), P, 20).count() == 0
