"""Nulls and odd numbers in profiling and sampling: the results that the docstrings state."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from costlens.operators import profile, sampling

NAN, INF = float("nan"), float("inf")


def test_correlation_leaves_out_pairs_with_a_null(spark):
    rows = [(1.0, 2.0, None), (2.0, None, 1.0), (3.0, 7.0, 4.0), (5.0, 1.0, 2.0), (None, 3.0, 3.0), (4.0, 4.0, 9.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = {(r["a"], r["b"]): r["corr"] for r in profile.correlation_matrix(df, ["a", "b", "c"]).collect()}
    x = np.array([[NAN if v is None else v for v in r] for r in rows])
    for i, j in ((0, 1), (0, 2), (1, 2)):
        both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
        assert got["abc"[i], "abc"[j]] == pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1], abs=1e-6)


def test_density_of_finite_values_only(spark):
    values = [0.0, 1.0, 1.5, 4.0, None, NAN, INF, -INF, 2.0, 3.0]
    rows = [(y, v) for v in values for y in (0, 1, None)]
    df = spark.createDataFrame(rows, "label int, x double").repartition(3)
    out = profile.density_histogram(df, "x", bins=4).collect()
    want = np.histogram([0.0, 1.0, 1.5, 4.0, 2.0, 3.0], bins=4, range=(0, 4), density=True)[0]
    assert len(out) == 12
    for y in (0, 1, None):
        got = [r["density"] for r in sorted((r for r in out if r["label"] == y), key=lambda r: r["bin"])]
        assert np.allclose(got, want)
    assert profile.density_histogram(df.filter(F.isnan("x")), "x").collect() == []


def test_rows_without_a_label_are_in_neither_class(spark):
    rows = [(i, 1 if i < 4 else None if i < 50 else 0) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, label int")
    few = sampling.undersample_majority(df, ["id"], ratio=2)
    assert {r["label"]: r["count"] for r in few.groupBy("label").count().collect()} == {1: 4, 0: 8}
    all_of_them = sampling.undersample_majority(df, ["id"], ratio=20)
    assert {r["label"]: r["count"] for r in all_of_them.groupBy("label").count().collect()} == {1: 4, 0: 10}
    capped = sampling.capped_sample(df, ["id"], cap=9)
    assert {r["label"]: r["count"] for r in capped.groupBy("label").count().collect()} == {1: 4, 0: 5}
