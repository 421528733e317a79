"""Versioned results: two writers of one cell, a crash between data and commit, conflicts, and older versions."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from vigilar.sources import versions as V

CELL = ["method", "scenario"]


def rows(spark, writer, cells, n=50):
    data = [(m, s, writer, i) for m, s in cells for i in range(n)]
    return spark.createDataFrame(data, "method string, scenario string, writer string, i long").repartition(3)


def writers(spark, path, version=None):
    got = V.read_version(spark, path, CELL, version).groupBy(*CELL).agg(F.collect_set("writer").alias("w"), F.count("*").alias("n")).collect()
    return {(r.method, r.scenario): (sorted(r.w), r.n) for r in got}


def test_a_rerun_replaces_its_own_cells_only(spark, tmp_path):
    path = str(tmp_path / "t")
    assert V.last_version(spark, path) == 0
    with pytest.raises(ValueError):
        V.read_version(spark, path, CELL)
    assert V.commit(rows(spark, "a", [("ae", "x"), ("ae", "y"), ("lof", "x")]), path, CELL) == 1
    assert V.commit(rows(spark, "b", [("ae", "y"), ("lof", "z")], 20), path, CELL) == 2
    assert writers(spark, path) == {("ae", "x"): (["a"], 50), ("ae", "y"): (["b"], 20), ("lof", "x"): (["a"], 50), ("lof", "z"): (["b"], 20)}
    assert writers(spark, path, 1) == {("ae", "x"): (["a"], 50), ("ae", "y"): (["a"], 50), ("lof", "x"): (["a"], 50)}


def test_writers_at_the_same_time_do_not_mix(spark, tmp_path):
    path = str(tmp_path / "t")
    with ThreadPoolExecutor(4) as pool:
        versions = list(pool.map(lambda k: V.commit(rows(spark, f"w{k}", [("ae", "x"), ("ae", f"own{k}")], 10 + k), path, CELL), range(4)))
    assert sorted(versions) == [1, 2, 3, 4]
    got = writers(spark, path)
    last = versions.index(4)
    assert got["ae", "x"] == ([f"w{last}"], 10 + last) and all(got["ae", f"own{k}"] == ([f"w{k}"], 10 + k) for k in range(4))


def test_a_crash_before_the_commit_leaves_nothing_to_read(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    V.commit(rows(spark, "a", [("ae", "x")]), path, CELL)

    def die(*args):
        raise RuntimeError("killed")

    monkeypatch.setattr(V, "publish", die)
    with pytest.raises(RuntimeError):
        V.commit(rows(spark, "b", [("ae", "x"), ("ae", "y")]), path, CELL)
    monkeypatch.undo()
    assert writers(spark, path) == {("ae", "x"): (["a"], 50)}
    assert len(V.vacuum(spark, path, CELL)) == 1 and writers(spark, path) == {("ae", "x"): (["a"], 50)}


def test_a_crash_inside_the_log_is_no_commit(spark, tmp_path):
    path = str(tmp_path / "t")
    V.commit(rows(spark, "a", [("ae", "x")]), path, CELL)
    (tmp_path / "t" / "_log" / "000000000002.json").write_text('{"version": 2, "folder": "abc", "ce')
    assert writers(spark, path) == {("ae", "x"): (["a"], 50)}
    assert V.commit(rows(spark, "c", [("ae", "x")], 7), path, CELL) == 3
    assert writers(spark, path) == {("ae", "x"): (["c"], 7)}


def test_conflicts_are_refused_where_a_version_is_expected(spark, tmp_path):
    path = str(tmp_path / "t")
    seen = V.commit(rows(spark, "a", [("ae", "x"), ("ae", "y")]), path, CELL)
    V.commit(rows(spark, "b", [("ae", "x")]), path, CELL)
    with pytest.raises(V.ConflictError):
        V.commit(rows(spark, "c", [("ae", "x")]), path, CELL, expected=seen)
    assert V.commit(rows(spark, "c", [("ae", "y")]), path, CELL, expected=seen) == 3
    assert writers(spark, path) == {("ae", "x"): (["b"], 50), ("ae", "y"): (["c"], 50)}
