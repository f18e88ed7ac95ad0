"""Matching of two fits' hidden states against enumeration."""

import datetime
import itertools

import numpy as np
import pytest

from statefield.operators import seeds


@pytest.mark.parametrize("k", [1, 2, 5, 6])
def test_assignment_equals_enumeration(k):
    rng = np.random.default_rng(k)
    for _ in range(30):
        gain = rng.integers(0, 20, (k, k)) * (rng.random((k, k)) < 0.7)
        found = seeds.assignment(gain)
        assert sorted(found) == list(range(k))
        assert gain[np.arange(k), found].sum() == max(sum(gain[i, p[i]] for i in range(k)) for p in itertools.permutations(range(k)))


def test_renamed_fits_are_stable_and_changes_are_seen(spark):
    rng, day = np.random.default_rng(0), datetime.date(2020, 1, 1)
    z = rng.integers(0, 4, 200).tolist()
    rename = [2, 0, 3, 1]
    rows = lambda zs: spark.createDataFrame([(c, day, int(x)) for c, x in enumerate(zs)], "code long, date date, Z_t long")
    table = lambda v: spark.createDataFrame(v, "z long, label string")
    kept = lambda v: spark.createDataFrame([(x,) for x in v], "z long")
    first = {"states": rows([*z, -1]), "labels": table(list(enumerate("ABCD"))), "kept": kept([0, 1])}
    same = {"states": rows([*(rename[x] for x in z), 2]), "labels": table([(rename[i], x) for i, x in enumerate("ABCD")]), "kept": kept([rename[0], rename[1]])}
    r = seeds.seed_stability(first, same, 4).first()
    assert (r.rows_moved, r.labels_changed, r.set_changed, r.passed) == (0, 0, 0, True)
    changed = same | {"labels": table([(rename[i], x) for i, x in enumerate("ABCC")]), "kept": kept([rename[0]])}
    r = seeds.seed_stability(first, changed, 4).first()
    assert (r.labels_changed, r.set_changed, r.value, r.passed) == (0.25, 0.5, 0.5, False)
