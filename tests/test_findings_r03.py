"""What the findings of round 3 were about."""

import itertools
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from statefield.functions.columns import equal_frequency_bin
from statefield.operators import features, latent, split
from statefield.plans import catalog
from statefield.sources import sinks, tables

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_joins_by_date_and_code_broadcast_no_rows(spark):
    rows = spark.range(40).select((F.col("id") % 4).alias("code"), F.expr("date_add(DATE '2000-01-01', cast(id div 4 as int))").alias("date"), (F.col("id") + 1.0).alias("close"))
    part = rows.where("code > 0").select("code", "date", F.lit("TREND").alias("regime"))
    out = tables.joined_panel(rows, rows.select("code", "date", F.lit(1).alias("state_id")), part)
    assert "Broadcast" not in plan_of(out)
    assert out.count() == 40 and out.where("regime is null").count() == 10
    assert "Broadcast" not in plan_of(tables.merge_checked(rows.select("code", "date", "close"), rows.select("code", "date")))
    new = sinks.new_rows(rows, part)
    assert "Broadcast" not in plan_of(new) and new.count() == 10


def test_bins_of_equal_scores_do_not_hang_on_the_last_bit(spark):
    # the fourth and fifth values are equal but for the last bits; six values a bin each without ties
    xs = [-2.0, -1.0, 0.0, 0.5, 0.5 + 2e-16, 1.5, 2.5]
    df = spark.createDataFrame([(1, i, x + 0.0) for i, x in enumerate(xs)], "code int, date int, z_r double").withColumn("z_r", F.when(F.col("date") == 4, F.lit(0.5000000000000002)).otherwise(F.col("z_r")))
    at = {r.date: r.b for r in df.select("date", equal_frequency_bin("z_r", 6).alias("b")).collect()}
    assert at[3] == at[4]
    starts = {r.code: r.starts for r in split.bin_starts(df, ["z_r"], 6).collect()}[1]["z_r"]
    assert all(s is None or s == round(s, 9) for s in starts)
    assert {i: sum(s is not None and s <= round(x, 9) for s in starts) for i, x in enumerate(xs)} == at


def test_panel_is_dealt_by_code_into_parts_that_do_not_grow(spark):
    rows = spark.range(1050).select((F.col("id") % 50).alias("l_suppkey"), F.expr("date_add(DATE '2000-01-01', cast(id div 50 as int))").alias("l_shipdate"), (F.col("id") + 1.0).alias("l_extendedprice"), F.lit(2.0).alias("l_quantity"))
    assert [tables.parts_of(rows, n) for n in (100, 1050, 2000)] == [11, 1, 1]
    folder = sinks.scratch(spark, "lines")
    rows.write.parquet(f"{folder}/lineitem.parquet")
    text = plan_of(features.state_vector(tables.lineitem_panel(spark, folder)))
    assert text.count("Exchange") == 1  # one for the groups and all windows


def test_steps_of_the_learned_chain_add_up_over_kept_blocks(spark, monkeypatch):
    rows = spark.range(0, 3000, 1, 5).select((F.col("id") % 30).cast("string").alias("seq_id"), F.col("id").alias("date"), (F.col("id") * 7919 % 4).cast("int").alias("C_t"), *(F.round(F.randn(i), 6).alias(x) for i, x in enumerate("ab"))).localCheckpoint()
    centres = lambda: latent.fit_centres(rows, ["a", "b"], 3, 2, 42, 20, 1e-4)
    one, fit = centres(), latent.fit_hmm(rows, 2, 4, 5)
    x = np.array(rows.select("a", "b").collect(), float)
    near = latent._nearest(x, one)[0]
    assert np.allclose([x[near == i].mean(0) for i in range(3)], one, atol=0.05)
    monkeypatch.setattr(latent, "PARTS", 0)  # sums added up by executors
    assert np.allclose(centres(), one)
    again = latent.fit_hmm(rows, 2, 4, 5, rows=100)
    assert np.allclose(again.trans, fit.trans) and np.allclose(again.emit, fit.emit)


def test_expected_counts_of_uneven_sequences_equal_sums_over_paths():
    model = latent.CategoricalHMM.initial(2, 3)
    seqs = [[0, 1, 2, 1], [2, 0], [1]]
    (obs, lengths), = latent._padded([np.array(s) for s in seqs])
    ll, first, moves, emits = model.expected(obs, lengths)
    want_ll, want_first, want_moves, want_emits = 0.0, np.zeros(2), np.zeros((2, 2)), np.zeros((2, 3))
    for s in seqs:
        paths = list(itertools.product(range(2), repeat=len(s)))
        p = np.array([model.start[z[0]] * np.prod([model.emit[a, o] for a, o in zip(z, s)]) * np.prod([model.trans[a, b] for a, b in zip(z, z[1:])]) for z in paths])
        want_ll += np.log(p.sum())
        for z, w in zip(paths, p / p.sum()):
            want_first[z[0]] += w
            for a, b in zip(z, z[1:]):
                want_moves[a, b] += w
            for a, o in zip(z, s):
                want_emits[a, o] += w
    assert np.isclose(ll, want_ll) and np.allclose(first, want_first) and np.allclose(moves, want_moves) and np.allclose(emits, want_emits)


def test_rows_of_one_code_meet_what_is_known_of_it_in_many_tasks(spark, monkeypatch):
    rows = spark.range(2000).select(F.lit(1).alias("code"), F.col("id").alias("date"))
    small = spark.createDataFrame([(1, {"z": [0.5]})], "code int, starts map<string, array<double>>")
    assert "SortMergeJoin" not in plan_of(split.beside(rows, small, ["code"], "small"))
    monkeypatch.setattr(split, "KEYS", 0)  # too many to broadcast
    many = split.beside(rows, small, ["code"], "small")
    assert "_salt" in plan_of(many) and "Broadcast" not in plan_of(many)
    assert many.where("starts['z'][0] = 0.5").select("date").distinct().count() == 2000 and many.count() == 2000
    z = rows.select("code", "date", F.sin("date").alias("z_r"))
    salted = {tuple(r) for r in split.discretize(z, ["r"]).select("date", "bin_r").collect()}
    assert salted == {tuple(r) for r in features.discretize(z, ["r"]).select("date", "bin_r").collect()}


def test_a_step_of_all_restarts_equals_one_restart_after_another():
    rng = np.random.default_rng(3)
    x, centres = rng.normal(size=(1500, 3)), rng.normal(size=(5, 4, 3))
    centres[1, 2] = centres[1, 0]  # rows equally near go to the first
    found = latent._step_sums(x, centres)
    for c, sums in zip(centres, found):
        near, far = latent._nearest(x, c)
        own = sums[1:].reshape(4, 4)
        assert np.isclose(sums[0], far.sum()) and own[:, 0].tolist() == np.bincount(near, minlength=4).tolist()
        assert np.allclose(own[:, 1:], [x[near == i].sum(0) for i in range(4)])
    assert found[1, 1:].reshape(4, 4)[2].tolist() == [0, 0, 0, 0]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
def test_what_comes_next_is_kept_with_the_rows(spark):
    for df in (catalog.valid_pairs(spark, SF), catalog.labelled(spark, SF)):
        assert "hashpartitioning" not in plan_of(df)  # no row of a kept stage moves for it
    cols = ["code", "date", "next_r", "next_r_z", "next_state"]
    kept, again = (sorted(df.select(*cols).collect(), key=lambda x: x[:2]) for df in (catalog.forward_rows(spark, SF), features.forward(catalog.state_rows(spark, SF))))
    assert len(kept) > 2000 and kept == again
