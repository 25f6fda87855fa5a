"""Models of given numbers on the scored view (A8, T1-T3, T5-T7, K8, L1, L3), each checked by SQL.

A fitted model's numbers are not SQL's business; what is done with them is.  Here a small tree ensemble, a logistic
regression and a Platt curve are fixed, saved and loaded again; every row of the view is scored, flagged, compared,
calibrated and explained from them."""

from __future__ import annotations

from itertools import combinations
from math import factorial

from pyspark.sql import functions as F

from costlens.functions import portable_hash_sql
from costlens.operators import calibration, explain, models, sampling
from costlens.operators.trees import TreeEnsemble
from costlens.plans.q_calibration import _ISO_CTES
from costlens.plans.q_cost import GRID_SQL
from costlens.plans.q_models import SPEC
from costlens.plans.q_split import _RN_SQL, _SPLIT3_SQL, KEYS, KEYS_SQL, split3
from costlens.plans.registry import register
from costlens.plans.views import SCORED_SQL, scored, with_sql
from costlens.session import scratch_path

FEATURES = SPEC.pipeline_order()
BASE = -2.25
#: tree, node, feature, threshold, value, cover; children of node i are 2i + 1 and 2i + 2.
NODES = [
    (0, 0, "l_quantity", 25.0, 0.0, 96.0), (0, 1, "l_extendedprice", 30000.0, 0.0, 40.0), (0, 2, "l_discount", 0.05, 0.0, 56.0),
    (0, 3, None, None, -0.4, 30.0), (0, 4, None, None, -0.1, 10.0), (0, 5, None, None, 0.2, 20.0), (0, 6, None, None, 0.55, 36.0),
    (1, 0, "l_extendedprice", 50000.0, 0.0, 80.0), (1, 1, None, None, -0.15, 50.0), (1, 2, "l_quantity", 40.0, 0.0, 30.0),
    (1, 5, None, None, 0.1, 12.0), (1, 6, None, None, 0.35, 18.0),
    (2, 0, "l_tax", 0.04, 0.0, 64.0), (2, 1, "l_quantity", 30.0, 0.0, 24.0), (2, 2, "l_quantity", 10.0, 0.0, 40.0),
    (2, 3, None, None, -0.05, 16.0), (2, 4, None, None, 0.08, 8.0), (2, 5, None, None, -0.2, 5.0), (2, 6, None, None, 0.12, 35.0),
]
LINEAR = models.LinearModel(
    ["l_extendedprice", "l_quantity", "l_discount", "l_tax"], [0.45, 0.03125, -1.5, 0.75], -3.5, {"l_extendedprice": (36000.0, 21000.0)}
)
PLATT = (3.75, -4.5)


def given_trees() -> TreeEnsemble:
    rows = []
    for tree, node, feature, threshold, value, cover in NODES:
        at = FEATURES.index(feature) if feature else -1
        rows.append({"tree": tree, "node": node, "feature": at, "threshold": threshold, "missing_left": True, "value": value, "cover": cover})
    return TreeEnsemble.of_nodes(FEATURES, BASE, rows)


def saved_trees(spark) -> TreeEnsemble:
    path = scratch_path(spark, "given-trees")
    given_trees().save(spark, path)
    return TreeEnsemble.load(spark, path)


def saved_linear(spark) -> models.LinearModel:
    path = scratch_path(spark, "given-linear")
    LINEAR.save(spark, path)
    return models.LinearModel.load(spark, path)


_BY_PLACE = {(t, n): rest for t, n, *rest in NODES}


def _tree_sql(tree: int, known: frozenset | None = None, node: int = 0) -> str:
    """The tree's value; with ``known`` features alone, the others' sides weighed by cover."""
    feature, threshold, value, cover = _BY_PLACE[tree, node]
    if feature is None:
        return f"{value!r}::DOUBLE"
    left, right = (_tree_sql(tree, known, 2 * node + k) for k in (1, 2))
    if known is None or feature in known:
        return f"CASE WHEN {feature} < {threshold!r} THEN {left} ELSE {right} END"
    shares = [_BY_PLACE[tree, 2 * node + k][3] / cover for k in (1, 2)]
    return f"({shares[0]!r}::DOUBLE * ({left}) + {shares[1]!r}::DOUBLE * ({right}))"


def _sigmoid_sql(margin: str) -> str:
    return f"1.0::DOUBLE / (1.0::DOUBLE + exp(-({margin})))"


_MARGIN = " + ".join([f"{BASE!r}::DOUBLE", *[f"({_tree_sql(t)})" for t in range(3)]])
_LINEAR = " + ".join(
    [f"{LINEAR.intercept!r}::DOUBLE"]
    + [
        f"{c!r}::DOUBLE * (({n} - {LINEAR.scale.get(n, (0.0, 1.0))[0]!r}::DOUBLE) / {LINEAR.scale.get(n, (0.0, 1.0))[1]!r}::DOUBLE)"
        for n, c in zip(LINEAR.features, LINEAR.coefficients)
    ]
)
_PLATT = _sigmoid_sql(f"{PLATT[0]!r}::DOUBLE * score + {PLATT[1]!r}::DOUBLE")
_ALL = f"scored_by AS (SELECT *, {_sigmoid_sql(_MARGIN)} AS trees, {_sigmoid_sql(_LINEAR)} AS linear, {_PLATT} AS platt FROM split3)"
_CTES = (SCORED_SQL, _RN_SQL, _SPLIT3_SQL, _ALL)


@register("trees_given", with_sql(SCORED_SQL, body=f"SELECT {KEYS_SQL}, round({_MARGIN}, 6) AS margin, round({_sigmoid_sql(_MARGIN)}, 6) AS probability FROM scored"))
def q_trees_given(spark, sf):
    """Margin and probability of every row under the saved ensemble."""
    model = saved_trees(spark)
    out = model.score(model.margin(scored(spark, sf)), "probability")
    return out.select(*KEYS, F.round("margin", 6).alias("margin"), F.round("probability", 6).alias("probability"))


@register("logistic_given", with_sql(SCORED_SQL, body=f"SELECT {KEYS_SQL}, round({_sigmoid_sql(_LINEAR)}, 6) AS probability FROM scored"))
def q_logistic_given(spark, sf):
    """Probability of every row under the saved coefficients."""
    return models.score(saved_linear(spark), scored(spark, sf)).select(*KEYS, F.round("score", 6).alias("probability"))


def _counts(name: str, score: str, part: str) -> str:
    return f"""{name}_counts AS (SELECT g.threshold, 500.0::DOUBLE * sum(CASE WHEN label = 1 AND {score} < g.threshold THEN 1 ELSE 0 END)
    + 5.0::DOUBLE * sum(CASE WHEN label = 0 AND {score} >= g.threshold THEN 1 ELSE 0 END) AS cost
  FROM grid g CROSS JOIN scored_by s WHERE part = '{part}' GROUP BY g.threshold),
{name}_best AS (SELECT threshold AS t, cost FROM {name}_counts ORDER BY cost, threshold LIMIT 1)"""


def _saved_production(spark, sf):
    parts = split3(spark, sf)
    path = scratch_path(spark, "given-production")
    models.save_production(given_trees(), parts.where(F.col("part") == "calib"), SPEC, path)
    return models.load_production(spark, path), parts.where(F.col("part") == "test")


@register(
    "production_given",
    with_sql(
        *_CTES, GRID_SQL, _counts("calib", "trees", "calib"),
        body=f"SELECT t AS optimal_threshold, 500.0::DOUBLE AS cost_fn, 5.0::DOUBLE AS cost_fp, CAST({len(SPEC.features)} AS INTEGER) AS n_features FROM calib_best",
    ),
)
def q_production_given(spark, sf):
    """The cost-optimal threshold of given scores on the calibration slice, as the metadata record holds it."""
    (_, meta), _ = _saved_production(spark, sf)
    row = (float(meta["optimal_threshold"]), float(meta["cost_fn"]), float(meta["cost_fp"]), len(meta["feature_columns"]))
    return spark.createDataFrame([row], "optimal_threshold double, cost_fn double, cost_fp double, n_features int")


@register(
    "score_batch_given",
    with_sql(
        *_CTES, GRID_SQL, _counts("calib", "trees", "calib"),
        body=f"SELECT {KEYS_SQL}, round(trees, 6) AS fraud_probability, trees >= t AS is_fraud, t AS threshold FROM scored_by, calib_best WHERE part = 'test'",
    ),
)
def q_score_batch_given(spark, sf):
    """Every test row scored and flagged by the saved model and its threshold."""
    (model, meta), test = _saved_production(spark, sf)
    out = models.score_batch(model, meta, test, keep=KEYS)
    return out.withColumn("fraud_probability", F.round("fraud_probability", 6))


def _ap_sql(score: str) -> str:
    return f"""(SELECT round(sum(pos * cum_pos / cum_cnt) / sum(pos), 6) FROM (
    SELECT *, sum(pos) OVER (ORDER BY s DESC) AS cum_pos, sum(cnt) OVER (ORDER BY s DESC) AS cum_cnt
    FROM (SELECT {score} AS s, sum(label) AS pos, count(*) AS cnt FROM test GROUP BY 1) a) b)"""


def _auc_sql(score: str) -> str:
    return f"""(SELECT (2 * sum(cnt - pos) * sum(pos) - sum(pos * (2 * (cum_cnt - cum_pos) - (cnt - pos))))::DOUBLE / (2.0::DOUBLE * sum(pos) * sum(cnt - pos)) FROM (
    SELECT *, sum(pos) OVER (ORDER BY s DESC) AS cum_pos, sum(cnt) OVER (ORDER BY s DESC) AS cum_cnt
    FROM (SELECT {score} AS s, sum(label) AS pos, count(*) AS cnt FROM test GROUP BY 1) a) b)"""


def _f1_sql(score: str) -> str:
    return f"""(SELECT CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE (2 * tp)::DOUBLE / (2 * tp + fp + fn) END FROM (
    SELECT count(CASE WHEN label = 1 AND {score} >= 0.5 THEN 1 END) AS tp, count(CASE WHEN label = 0 AND {score} >= 0.5 THEN 1 END) AS fp,
           count(CASE WHEN label = 1 AND {score} < 0.5 THEN 1 END) AS fn FROM test) x)"""


#: The view's own score and the given models' stand for the compared strategies.
_COMPARED = (("none", "score"), ("class_weight", "r_trees"), ("smote", "r_linear"))
_TEST = "test AS (SELECT *, round(trees, 6) AS r_trees, round(linear, 6) AS r_linear, round(platt, 6) AS r_platt FROM scored_by WHERE part = 'test')"


def _test_scores(spark, sf):
    rows = split3(spark, sf).where(F.col("part") == "test")
    rows = models.score(given_trees(), models.score(LINEAR, rows, "linear"), "trees")
    rows = rows.withColumn("r_trees", F.round("trees", 6)).withColumn("r_linear", F.round("linear", 6))
    return rows.select("label", "score", "r_trees", "r_linear")


@register(
    "strategies_given",
    with_sql(
        *_CTES, _TEST,
        body="\nUNION ALL ".join(f"""SELECT '{n}' AS strategy, {_ap_sql(s)} AS pr_auc, {_auc_sql(s)} AS roc_auc, {_f1_sql(s)} AS "f1_at_0.5\"""" for n, s in _COMPARED),
    ),
)
def q_strategies_given(spark, sf):
    """The strategies' metrics over given score columns."""
    rows = _test_scores(spark, sf)
    return models.strategy_rows([(n, rows.select("label", F.col(s).alias("score"))) for n, s in _COMPARED])


def _cost_sql(score: str, t: str) -> str:
    return f"""(SELECT 500.0::DOUBLE * count(CASE WHEN label = 1 AND {score} < {t} THEN 1 END) + 5.0::DOUBLE * count(CASE WHEN label = 0 AND {score} >= {t} THEN 1 END) FROM test)"""


_ABLATED = ((models.ABLATION[0], "score", "0.5"), (models.ABLATION[1], "r_trees", "0.5"), (models.ABLATION[2], "r_trees", "(SELECT t FROM trees_best)"),
            (models.ABLATION[3], "r_linear", "(SELECT t FROM linear_best)"))


@register(
    "ablation_given",
    with_sql(
        *_CTES, _TEST, GRID_SQL, _counts("trees", "round(trees, 6)", "test"), _counts("linear", "round(linear, 6)", "test"),
        body="\nUNION ALL ".join(f"SELECT '{n}' AS configuration, {_ap_sql(s)} AS pr_auc, {_cost_sql(s, t)} AS expected_cost" for n, s, t in _ABLATED),
    ),
)
def q_ablation_given(spark, sf):
    """K8: the ablation's rows over given score columns."""
    rows = _test_scores(spark, sf)
    frame = lambda s: rows.select("label", F.col(s).alias("score"))
    return models.ablation_rows([(n, frame(s), float(t) if t == "0.5" else models.select_threshold) for n, s, t in _ABLATED], 500.0, 5.0)


@register("platt_given", with_sql(SCORED_SQL, body=f"SELECT {KEYS_SQL}, score, round({_PLATT}, 6) AS platt_score FROM scored"))
def q_platt_given(spark, sf):
    """L1: a given curve applied to every row."""
    out = calibration.apply_platt(scored(spark, sf), PLATT)
    return out.select(*KEYS, "score", F.round("platt_score", 6).alias("platt_score"))


@register(
    "calibration_given",
    with_sql(
        *_ISO_CTES, GRID_SQL,
        f"""meth AS (SELECT 'score' AS method, label, score AS s FROM iso UNION ALL SELECT 'isotonic_score', label, isotonic_score FROM iso
          UNION ALL SELECT 'platt_score', label, round({_PLATT}, 6) FROM iso)""",
        """cc AS (SELECT mt.method, g.threshold, sum(CASE WHEN mt.label = 1 AND mt.s < g.threshold THEN 1 ELSE 0 END) AS fn,
            sum(CASE WHEN mt.label = 0 AND mt.s >= g.threshold THEN 1 ELSE 0 END) AS fp
          FROM meth mt CROSS JOIN grid g GROUP BY mt.method, g.threshold)""",
        "costs AS (SELECT method, threshold, fn * 500.0::DOUBLE + fp * 5.0::DOUBLE AS cost FROM cc)",
        "best AS (SELECT * FROM costs QUALIFY row_number() OVER (PARTITION BY method ORDER BY cost, threshold) = 1)",
        "brier AS (SELECT method, round(avg(power(s - label, 2)), 6) AS brier_score FROM meth GROUP BY method)",
        body="SELECT b.method, b.brier_score, best.threshold AS optimal_threshold, best.cost AS optimal_cost FROM brier b JOIN best ON b.method = best.method",
    ),
)
def q_calibration_given(spark, sf):
    """L3: raw, Platt (given curve) and isotonic (fitted) scores of the test slice compared."""
    parts = split3(spark, sf)
    iso = calibration.fit_isotonic(parts.where(F.col("part") == "calib"))
    test = calibration.apply_platt(parts.where(F.col("part") == "test").select("label", "score"), PLATT)
    both = calibration.apply_isotonic(test, iso)
    both = both.withColumn("platt_score", F.round("platt_score", 6)).withColumn("isotonic_score", F.round("isotonic_score", 6))
    return calibration.calibration_comparison(both)


def _shapley_sql(feature: str) -> str:
    others, terms = [f for f in FEATURES if f != feature], []
    used = {r[2] for r in NODES}
    others = [f for f in others if f in used]  # the rest change no value
    if feature not in used:
        return "0.0::DOUBLE"
    value = lambda known: " + ".join(f"({_tree_sql(t, frozenset(known))})" for t in range(3))
    for size in range(len(others) + 1):
        w = factorial(size) * factorial(len(others) - size) / factorial(len(others) + 1)
        for known in combinations(others, size):
            terms.append(f"{w!r}::DOUBLE * (({value([*known, feature])}) - ({value(known)}))")
    return "\n  + ".join(terms)


_ID = KEYS[:-1]
_CAPPED = f"""c AS (SELECT CAST(sum(label) AS BIGINT) AS p, count(*) - CAST(sum(label) AS BIGINT) AS q FROM test),
neg AS (SELECT *, row_number() OVER (ORDER BY {portable_hash_sql(0, *_ID)}, {", ".join(_ID)}) AS k FROM test WHERE label <> 1),
capped AS (SELECT * EXCLUDE k FROM neg WHERE k <= (SELECT greatest(0, least(2000 - p, q)) FROM c) UNION ALL SELECT * FROM test WHERE label = 1)"""


@register(
    "shap_given",
    with_sql(
        SCORED_SQL, _RN_SQL, _SPLIT3_SQL, "test AS (SELECT * FROM split3 WHERE part = 'test')", _CAPPED,
        body="\nUNION ALL ".join(f"SELECT {', '.join(_ID)}, '{f}' AS feature, round({_shapley_sql(f)}, 6) + 0.0::DOUBLE AS contribution FROM capped" for f in FEATURES),
    ),
)
def q_shap_given(spark, sf):
    """Contributions of the given ensemble, against the sum over all feature subsets."""
    test = split3(spark, sf).where(F.col("part") == "test")
    sample = sampling.capped_sample(test, _ID, "label", cap=2000, seed=0)
    long, _ = explain.tree_shap(given_trees(), sample, _ID)
    return long.withColumn("contribution", F.round("contribution", 6) + F.lit(0.0))
