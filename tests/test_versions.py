import os

import pytest

from wayfold.sources import versions


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_one_of_two_writers_succeeds(spark, tmp_path):
    path = str(tmp_path / "t")
    table = lambda *x: spark.createDataFrame(list(x), "code string, a int, b string")
    assert versions.current(spark, path) == 0
    assert versions.commit(table(("A", 1, "x"), ("B", 2, None)), path, 0) == 1
    pinned = versions.read(spark, path)
    one, two = versions.read(spark, path, 1), versions.read(spark, path, 1)  # two writers from one base
    assert versions.commit(one.where("code = 'A'"), path, 1) == 2
    with pytest.raises(versions.Stale):
        versions.commit(two.where("code = 'B'"), path, 1)
    assert rows(versions.read(spark, path)) == [("A", 1, "x")] and rows(pinned) == [("A", 1, "x"), ("B", 2, None)]
    assert versions.upsert(spark, path, table(("A", None, "y"), ("C", 3, "z")), "code") == 3
    assert rows(versions.read(spark, path)) == [("A", 1, "y"), ("C", 3, "z")]
    with pytest.raises(versions.Stale):
        versions.upsert(spark, path, table(("D", 1, "d")), "code", base=2)
    assert versions.current(spark, path) == 3


def test_the_rename_decides_between_writers_at_the_same_moment(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    versions.commit(spark.range(3), path, 0)
    # both have seen that version 1 is current before either commits
    monkeypatch.setattr(versions, "current", lambda *_: 1)
    assert versions.commit(spark.range(4), path, 1) == 2
    with pytest.raises(versions.Stale):
        versions.commit(spark.range(5), path, 1)
    assert versions.read(spark, path, 2).count() == 4


def test_a_crash_leaves_the_old_version(spark, tmp_path):
    path = str(tmp_path / "t")
    versions.commit(spark.range(3), path, 0)
    broken = spark.range(9).selectExpr("raise_error('the writer dies') AS id")
    with pytest.raises(Exception, match="the writer dies"):
        versions.commit(broken, path, 1)
    os.makedirs(f"{path}/data/half")  # rows of a writer that died before its rename
    assert versions.current(spark, path) == 1 and versions.read(spark, path).count() == 3
    assert versions.commit(spark.range(1), path, 1) == 2
