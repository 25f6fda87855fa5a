"""The run log: a run is read once or not at all."""

import pytest

from costlens.operators import runlog


def rows(spark, path, **kw):
    return sorted((r["run_id"], r["experiment"], r["key"], r["value"], r["text"]) for r in runlog.read_runs(spark, path, **kw).collect())


def test_runs_are_read_once_or_not(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "log")
    assert rows(spark, path) == []
    record = lambda x: spark.createDataFrame([(x, 2)], "auc double, n int")
    params = runlog.params_long(spark, {"depth": 4, "kind": "trees"}, "a/1", "first")
    for value in (0.5, 0.75):  # committed twice: the later one counts
        runlog.commit_run([runlog.metrics_long(record(value), "a/1", "first"), params], path, "a/1", "first")
    runlog.commit_run([runlog.metrics_long(record(0.25), "b", "second")], path, "b", "second")
    whole = [("a/1", "first", "auc", 0.75, None), ("a/1", "first", "depth", 4.0, "4"), ("a/1", "first", "kind", None, "trees"), ("a/1", "first", "n", 2.0, None)]
    assert sorted(rows(spark, path), key=str) == sorted(whole + [("b", "second", "auc", 0.25, None), ("b", "second", "n", 2.0, None)], key=str)
    assert [r[0] for r in rows(spark, path, experiment="second")] == ["b", "b"]

    def lost(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(runlog, "replace_text", lost)
    for run in ("b", "c"):  # rows are written, the entry is not
        with pytest.raises(RuntimeError):
            runlog.commit_run([runlog.metrics_long(record(9.0), run, "second")], path, run, "second")
    assert [r[3] for r in rows(spark, path, experiment="second")] == [0.25, 2.0]
