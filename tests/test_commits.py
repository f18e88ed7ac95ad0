"""Appends by commits: replayed, interleaved and failed batches."""

import datetime

import pytest

from statefield.sources import commits
from statefield.streaming import ingest

DAY = datetime.date(2024, 1, 1)
SCHEMA = "date date, code string, close double"


def rows(spark, *codes, close=1.0):
    return spark.createDataFrame([(DAY, c, close) for c in codes], SCHEMA)


def there(spark, path):
    return sorted((r.code, r.close) for r in commits.read_committed(spark, path, SCHEMA).collect())


def test_replayed_and_repeated_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    assert there(spark, path) == []
    assert commits.append_batch(rows(spark, "a", "b", "b"), path, "one")
    assert not commits.append_batch(rows(spark, "c"), path, "one")
    assert commits.append_batch(rows(spark, "b", "c", close=2.0), path, "two")
    assert there(spark, path) == [("a", 1.0), ("b", 1.0), ("c", 2.0)]
    assert [(c["number"], c["batch"]) for c in commits.commits(spark, path)] == [(0, "one"), (1, "two")]


def test_interleaved_writers(spark, tmp_path, monkeypatch):
    """A second writer commits while the first one is between its files and its commit."""
    path, once, stage = str(tmp_path / "t"), [], commits.stage

    def disturbed(df, *args):
        folder = stage(df, *args)
        if not once:
            once.append(True)
            monkeypatch.setattr(commits, "stage", stage)
            commits.append_batch(rows(spark, "a", "x", close=9.0), path, "other")
        return folder

    monkeypatch.setattr(commits, "stage", disturbed)
    assert commits.append_batch(rows(spark, "a", "b"), path, "mine")
    assert there(spark, path) == [("a", 9.0), ("b", 1.0), ("x", 9.0)]
    assert [c["batch"] for c in commits.commits(spark, path)] == ["other", "mine"] and commits.clean(spark, path) == 0


def test_failed_batches_are_not_read(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    commits.append_batch(rows(spark, "a"), path, "one")
    monkeypatch.setattr(commits, "publish", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        commits.append_batch(rows(spark, "b"), path, "two")
    monkeypatch.undo()
    assert there(spark, path) == [("a", 1.0)]
    assert commits.clean(spark, path) == 1 and there(spark, path) == [("a", 1.0)]
    assert commits.append_batch(rows(spark, "b"), path, "two") and there(spark, path) == [("a", 1.0), ("b", 1.0)]


def test_two_streams_into_one_table(spark, tmp_path):
    path = str(tmp_path / "t")
    for i, name in enumerate(("x", "y")):
        for j in range(2):
            rows(spark, "same", f"{name}{j}", close=float(i)).write.mode("append").parquet(str(tmp_path / name))
            ingest.ingest_committed(spark, str(tmp_path / name), rows(spark).schema, path, str(tmp_path / f"{name}-check"), name).awaitTermination()
    assert there(spark, path) == [("same", 0.0), ("x0", 0.0), ("x1", 0.0), ("y0", 1.0), ("y1", 1.0)]
