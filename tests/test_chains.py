"""Chains by blocks and scans against row-by-row recursions."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_latent_queries import one_by_one

from statefield.operators import chains, latent

DAY = datetime.date(2000, 1, 1)


@pytest.fixture(scope="module")
def long_rows(spark):
    """A sequence of most rows, one of a block, one of a row, and others."""
    rng = np.random.default_rng(4)
    seqs = {"long": rng.integers(0, 4, 700), "block": rng.integers(0, 4, 10), "one": rng.integers(0, 4, 1), **{f"s{i}": rng.integers(0, 4, rng.integers(1, 60)) for i in range(8)}}
    rows = [(s, DAY + datetime.timedelta(i), int(c)) for s, o in seqs.items() for i, c in enumerate(o)]
    return seqs, spark.createDataFrame(rows, "seq_id string, date date, C_t int").repartition(5)


def test_blocks_are_short_and_whole(long_rows):
    seqs, df = long_rows
    got = {}
    for b in chains.blocks_of(df, 10).orderBy("seq_id", "block").collect():
        assert len(b.obs) == len(b.days) <= 10
        got.setdefault(b.seq_id, []).append(b)
    for s, o in seqs.items():
        assert [b.block for b in got[s]] == list(range(got[s][0].blocks)) and sum((b.obs for b in got[s]), []) == o.tolist()


@pytest.mark.parametrize("fanout", [2, 64])
def test_counts_equal_row_by_row(long_rows, fanout):
    seqs, df = long_rows
    model = latent.CategoricalHMM.initial(3, 4)
    blocks = chains.blocks_of(df, 10)
    got = {r.seq_id: r for r in chains.log_likelihoods(blocks, model, fanout).collect()}
    want = {s: one_by_one(model, o) if s != "long" else None for s, o in seqs.items()}
    whole = model.expected(seqs["long"][None], np.array([700]))
    want["long"] = (whole[0], whole[1], whole[2], whole[3])
    for s, o in seqs.items():
        assert got[s].n == len(o) and got[s].log_likelihood == pytest.approx(want[s][0], abs=1e-8)
    ll, first, moves, emits = chains.summed_counts(blocks, model, fanout)
    for x, i in ((ll, 0), (first, 1), (moves, 2), (emits, 3)):
        assert np.allclose(x, sum(np.asarray(w[i]) for w in want.values()), atol=1e-8)


@pytest.mark.parametrize(("fanout", "steps"), [(2, 1024), (64, 1024), (3, 1)])
def test_paths_equal_row_by_row(long_rows, fanout, steps):
    """Also with many ties, where parameters are whole numbers."""
    seqs, df = long_rows
    model = latent.CategoricalHMM.initial(3, 4, 9)
    logs = [np.round(np.log(x) * steps) / steps for x in (model.start, model.trans, model.emit)]
    got = {(r.seq_id, r.date): r.Z_t for r in chains.best_paths(chains.blocks_of(df, 10), *logs, fanout).collect()}
    rounded = latent.CategoricalHMM(*(np.exp(x) for x in logs))
    for s, o in seqs.items():
        score, back = logs[0] + logs[2][:, o[0]], []
        for c in o[1:]:
            step = score[:, None] + logs[1]
            back.append(step.argmax(0))
            score = step.max(0) + logs[2][:, c]
        path = [int(score.argmax())]
        for b in back[::-1]:
            path.append(int(b[path[-1]]))
        assert [got[s, DAY + datetime.timedelta(i)] for i in range(len(o))] == path[::-1]
        if steps == 1024:
            assert rounded.viterbi(o).tolist() == path[::-1]


def test_empty_tables_give_no_blocks(spark, long_rows):
    _, df = long_rows
    blocks = chains.blocks_of(df.where(F.lit(False)), 10)
    model = latent.CategoricalHMM.initial(3, 4)
    assert blocks.count() == 0 and chains.log_likelihoods(blocks, model).count() == 0
    assert chains.best_paths(blocks, np.log(model.start), np.log(model.trans), np.log(model.emit)).count() == 0
