import numpy as np
import pytest

from conftest import lattice_scores, scored_frame
from costlens.operators import metrics


def test_precision_at_k(spark):
    df = scored_frame(spark, [1, 0, 0, 1, 1, 0, 0, 0], [0.97, 0.6, 0.11, 0.93, 0.88, 0.71, 0.4, 0.02])
    got = {k: metrics.precision_at_k(df, k, ["id"]).first()[0] for k in (0, 1, 3, 5, 8, 50)}
    assert got == {0: 0.0, 1: 1.0, 3: 1.0, 5: 0.6, 8: 0.375, 50: 0.375}


def test_confusion_counts(spark):
    df = scored_frame(spark, [1] * 4 + [0] * 8, [0.4, 0.81, 0.66, 0.9, 0.7, 0.1, 0.2, 0.65, 0.3, 0.05, 0.64, 0.99])
    r = metrics.evaluate_full(df, 0.65, 3, ["id"]).first()
    assert (r["true_positives"], r["false_negatives"], r["false_positives"], r["true_negatives"]) == (3, 1, 3, 5)
    assert r["false_positive_rate"] == 0.375 and r["false_negative_rate"] == 0.25


def test_metric_keys(spark):
    cols = metrics.evaluate_full(scored_frame(spark, *lattice_scores(40, 5)), 0.5, 3, ["id"]).columns
    assert len(cols) == 13
    assert set(cols) == {  # fixed values: the record's field names
        "threshold", "precision", "recall", "f1", "pr_auc", "roc_auc", "true_positives", "true_negatives",
        "false_positives", "false_negatives", "false_positive_rate", "false_negative_rate", "precision_at_3",
    }


def _ap_auc_reference(y, p):
    order = np.argsort(-p, kind="stable")
    y, p = y[order], p[order]
    P, N = y.sum(), len(y) - y.sum()
    ap, tp, n, prev_r = 0.0, 0, 0, 0.0
    i = 0
    while i < len(p):
        j = i
        while j < len(p) and p[j] == p[i]:
            j += 1
        tp += y[i:j].sum()
        n += j - i
        r = tp / P
        ap += (r - prev_r) * tp / n
        prev_r = r
        i = j
    ranks_pos = [((p[y == 0] < s).sum() + 0.5 * (p[y == 0] == s).sum()) for s in p[y == 1]]
    return ap, sum(ranks_pos) / (P * N)


def test_rank_metrics_match_definitions_with_ties(spark):
    rng = np.random.default_rng(1)
    y = (rng.random(400) < 0.2).astype(int)
    p = np.round(np.clip(0.3 * y + rng.random(400) * 0.7, 0, 1), 2)  # many ties
    df = scored_frame(spark, y, p)
    for nb in (1, 3, 64):
        from costlens.operators import ordered

        old = ordered._bucket_count
        ordered._bucket_count = lambda d, n, nb=nb: nb
        try:
            r = metrics.rank_metrics(df).first()
        finally:
            ordered._bucket_count = old
        ap, auc = _ap_auc_reference(y, p)
        assert abs(r["pr_auc"] - ap) < 1e-6
        assert abs(r["roc_auc"] - auc) < 1e-12


def test_brier_extremes(spark):
    labels = [int(i % 3 == 0) for i in range(11)]
    assert metrics.brier_score(scored_frame(spark, labels, labels)).first()[0] == 0.0
    assert metrics.brier_score(scored_frame(spark, labels, [1 - y for y in labels])).first()[0] == 1.0
    assert metrics.brier_score(scored_frame(spark, labels, [0.5] * 11)).first()[0] == 0.25


def test_reliability_curve_bins(spark):
    labels, scores = lattice_scores(1300, 7)
    rows = metrics.reliability_curve(scored_frame(spark, labels, scores), 10).collect()
    assert 1 <= len(rows) <= 10
    assert sum(r["n"] for r in rows) == 1300
    assert sum(r["n"] * r["prob_true"] for r in rows) == pytest.approx(sum(labels))


def test_percentile_report_pins(spark):
    from costlens.operators import profile

    empty = spark.createDataFrame([], "v double")
    r = profile.percentile_report(empty, "v", (50, 95)).first()
    assert (r["count"], r["p50"], r["p95"]) == (0, None, None)
    vals = [float(x) for x in range(1, 101)]
    r = profile.percentile_report(spark.createDataFrame([(v,) for v in vals], "v double"), "v", (50, 95)).first()
    assert (r["count"], r["p50"], r["p95"]) == (100, float(np.percentile(vals, 50)), round(float(np.percentile(vals, 95)), 6))


def test_density_histogram_edges(spark):
    from costlens.operators import profile

    empty = spark.createDataFrame([], "label int, x double")
    assert profile.density_histogram(empty, "x", 4).count() == 0
    df = spark.createDataFrame([(0, 0.0), (0, 1.0), (1, 4.0), (1, 4.0)], "label int, x double")
    rows = {(r["label"], r["bin"]): (r["count"], r["density"]) for r in profile.density_histogram(df, "x", 4).collect()}
    assert len(rows) == 8  # every class x bin, empty bins included
    assert rows[(1, 3)] == (2, 2 / (2 * 1.0))  # the maximum falls in the closed last bin
    assert rows[(0, 0)] == (1, 0.5) and rows[(0, 1)] == (1, 0.5) and rows[(0, 2)] == (0, 0.0)


def test_clipped_histogram_edges(spark):
    from costlens.operators import profile

    assert profile.clipped_histogram(spark.createDataFrame([], "v double"), "v").count() == 0
    vals = [float(x) for x in range(1, 1001)]
    rows = profile.clipped_histogram(spark.createDataFrame([(v,) for v in vals], "v double"), "v", 10, 99.5).collect()
    cap = np.percentile(vals, 99.5)
    assert sum(r["n"] for r in rows) == sum(1 for v in vals if v <= cap)


def test_roc_auc_of_very_many_rows(spark):
    """Counts as 10^12 rows would give: their products do not fit a long."""
    from costlens.operators import metrics as m

    g = spark.createDataFrame([(0.9, 10**9, 2 * 10**9), (0.1, 7 * 10**8, 10**12)], "score double, pos long, cnt long")
    old, m.score_counts = m.score_counts, lambda *a, **k: g
    try:
        auc = m.rank_metrics(g).first()["roc_auc"]
    finally:
        m.score_counts = old
    p1, n1, p2, n2 = 10**9, 10**9, 7 * 10**8, 10**12 - 7 * 10**8
    want = (p1 * n2 + (p1 * n1 + p2 * n2) / 2) / ((p1 + p2) * (n1 + n2))
    assert auc == pytest.approx(want, abs=1e-12)
