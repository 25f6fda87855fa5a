import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from costlens.operators import models
from costlens.operators.features import FeatureSpec

FEATS = [f"V{i}" for i in range(1, 31)]
SPEC = FeatureSpec(features=tuple(FEATS), scaled=("V29", "V30"), label="y", id_cols=("rid",))


def _frame(spark, n, rare=False):
    """Waves of different lengths; the label follows the sum of three of them (the rarest tenth, or the upper half)."""
    t = np.arange(n)[:, None] * 1.0
    x = np.sin(t * (np.arange(30) + 1.3) * 0.37) * (1 + np.arange(30) % 4)
    drive = x[:, 3] + 0.5 * x[:, 10] - x[:, 21]
    y = (drive > np.quantile(drive, 0.9 if rare else 0.5)).astype(int)
    rows = [(i, int(y[i]), *map(float, x[i])) for i in range(n)]
    return spark.createDataFrame(rows, "rid long, y int, " + ", ".join(f"{c} double" for c in FEATS))


def test_logistic_probabilities(spark):
    df = _frame(spark, 260)
    m = models.fit_logistic(df, SPEC)
    p = [r["score"] for r in models.score(m, df).collect()]
    assert all(0.0 <= v <= 1.0 for v in p)
    s = models.score(m, df).select(F.col("y").alias("label"), "score")
    from costlens.operators.metrics import evaluate_basic

    assert set(evaluate_basic(s).columns) == {"pr_auc", "roc_auc", "f1_at_0.5"}


def test_strategies_run(spark):
    df = _frame(spark, 330, rare=True)
    train, test = df.where("rid % 3 > 0"), df.where("rid % 3 = 0")
    out = models.strategy_metrics(train, test, SPEC, max_iter=5).collect()
    assert {r["strategy"] for r in out} == {"none", "class_weight", "smote"}
    for r in out:
        for k in ("pr_auc", "roc_auc", "f1_at_0.5"):
            assert 0.0 <= r[k] <= 1.0


def test_unknown_strategy(spark):
    with pytest.raises(ValueError):
        models.train_strategy("bogus", _frame(spark, 10), SPEC)


def test_served_equals_offline(spark, tmp_path):
    df = _frame(spark, 330, rare=True)
    fit, sel = df.where("rid % 3 > 0"), df.where("rid % 3 = 0")
    meta = models.train_production(fit, sel, SPEC, str(tmp_path / "prod"), max_iter=5)
    model, loaded = models.load_production(spark, str(tmp_path / "prod"))
    assert loaded == meta
    served = {r["rid"]: (r["fraud_probability"], r["is_fraud"]) for r in models.score_batch(model, loaded, sel, ["rid"]).collect()}
    zero = spark.createDataFrame([(999, 0, *([0.0] * 30))], sel.schema)
    assert models.score_batch(model, loaded, zero, ["rid"]).count() == 1
    # offline: the pipeline trained anew in memory scores the same rows
    t = loaded["optimal_threshold"]
    offline = models.train_strategy("class_weight", fit, SPEC, max_iter=5)
    scores = {r["rid"]: r["score"] for r in models.score(offline, sel).select("rid", "score").collect()}
    assert set(scores) == set(served)
    for rid, (p, flag) in served.items():
        assert abs(p - scores[rid]) < 1e-6 and flag == (scores[rid] >= t)


def test_models_train_at_the_same_time(spark):
    """Every one waits for the others to have begun; results come in the order asked for."""
    begun = threading.Barrier(3, timeout=60)

    def make(k):
        begun.wait()
        return spark.range(k).count()

    assert models.train_together(spark, [lambda k=k: make(k) for k in (5, 6, 7)]) == [5, 6, 7]
