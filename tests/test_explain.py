import math
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from costlens.operators import explain, models, profile
from costlens.operators.features import FeatureSpec
from costlens.operators.trees import TreeEnsemble

FEATS = [f"V{i}" for i in range(1, 31)]


def test_informative_feature_first_and_additivity(spark):
    t = np.arange(260)[:, None]
    x = ((t * (2 * np.arange(30) + 7) * 31) % 113) / 113.0  # columns of unlike steps through one lattice
    y = ((x[:, 16] > 0.62) | (x[:, 16] < 0.2)).astype(int)
    rows = [(i, int(y[i]), *map(float, x[i])) for i in range(260)]
    df = spark.createDataFrame(rows, "rid long, label int, " + ", ".join(f"{c} double" for c in FEATS))
    spec = FeatureSpec(features=tuple(FEATS), scaled=("V29", "V30"), label="label")
    m = models.fit_boosted_trees(df, spec, max_iter=8, max_depth=3)
    long, base = explain.tree_shap(m, df, ["rid"])
    imp = profile.mean_abs_by_feature(long, "contribution", top=None).collect()
    assert imp[0]["feature"] == "V17"
    vals = [r["mean_abs"] for r in imp]
    assert vals == sorted(vals, reverse=True)
    sums = long.groupBy("rid").agg(F.sum("contribution").alias("s"))
    mg = explain.margin(m, df, ["rid"]).join(sums, "rid").collect()
    assert max(abs(r["s"] + base - r["margin"]) for r in mg) < 1e-9


SPLITS = [  # (node, feature, threshold, missing_left), leaves hold i - 9
    (0, 0, 2.0, True), (1, 1, 1.0, False), (2, 0, 4.0, False), (3, 2, 3.0, True), (5, 1, 2.0, True), (6, 2, 1.0, False),
]


def hand_model(features):
    rows, inner = [], {s[0] for s in SPLITS}
    for node, feature, threshold, missing_left in SPLITS:
        rows.append({"tree": 0, "node": node, "feature": feature, "threshold": threshold, "missing_left": missing_left, "value": 0.0, "cover": 40.0 - 5 * node})
    for i in (c for n in inner for c in (2 * n + 1, 2 * n + 2) if c not in inner):
        rows.append({"tree": 0, "node": i, "feature": -1, "threshold": None, "missing_left": None, "value": i - 9.0, "cover": 16.0 - i})
    return TreeEnsemble.of_nodes(features, 0.25, rows)


def test_contributions_are_sums_over_all_feature_subsets():
    model = hand_model(["a", "b", "c"])
    tree = model.trees[0]
    x = np.array([[p, q, r] for p in (0.0, 3.0, 5.0, np.nan) for q in (0.0, 1.5, 9.0, np.nan) for r in (0.0, 1.0, 3.0, np.nan)])

    def value(row, known, i=0):
        f = tree.feature[i]
        if f < 0:
            return tree.value[i]
        if f in known:
            left = tree.missing_left[i] if np.isnan(row[f]) else row[f] < tree.threshold[i]
            return value(row, known, 2 * i + 1 if left else 2 * i + 2)
        return sum(tree.cover[c] / tree.cover[i] * value(row, known, c) for c in (2 * i + 1, 2 * i + 2))

    phi, base = explain.shap_matrix(x, explain.leaf_terms(model))
    assert abs(base - value(x[0], ())) < 1e-12
    for row, got in zip(x, phi):
        for f in range(3):
            others = [g for g in range(3) if g != f]
            weight = lambda known: math.factorial(len(known)) * math.factorial(2 - len(known)) / 6
            subsets = [known for size in range(3) for known in combinations(others, size)]
            want = sum(weight(k) * (value(row, (*k, f)) - value(row, k)) for k in subsets)
            assert abs(got[f] - want) < 1e-12


def test_queries_explain_every_row_of_the_test_part(spark, monkeypatch):
    from costlens.plans import q_anomaly
    from costlens.plans.q_models import SPEC

    n = 2500  # a sample of 2,000 rows leaves some out
    test = spark.range(n).select(
        F.col("id").alias("l_orderkey"), *[F.lit(1).alias(c) for c in ("l_linenumber", "l_partkey", "l_suppkey")],
        *[F.pmod(F.col("id") * k, F.lit(7)).cast("double").alias(c) for k, c in ((1, "l_quantity"), (3, "l_extendedprice"), (5, "l_discount"), (2, "l_tax"))],
        F.col("id").alias("time_us"), F.when(F.col("id") % 50 == 0, 1).otherwise(0).alias("label"),
    )
    monkeypatch.setattr(q_anomaly, "parts", lambda *_: (test, test))
    monkeypatch.setattr(q_anomaly, "strategy_model", lambda *_: hand_model(SPEC.pipeline_order()))
    long = q_anomaly.q_tree_shap(spark, "").cache()
    assert long.count() == n * len(SPEC.features)
    assert long.select("l_orderkey").distinct().count() == n
    whole = {r["feature"]: r["m"] for r in long.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("m")).collect()}
    for r in q_anomaly.q_shap_importance(spark, "").collect():
        assert abs(r["mean_abs"] - whole[r["feature"]]) < 1e-6
    long.unpersist()
