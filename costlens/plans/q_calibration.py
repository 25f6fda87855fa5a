"""Registered calibration queries (L1-L3): fit on the calib slice of the
three-way split of the scored view, evaluate on its test slice."""

from __future__ import annotations

from pyspark.sql import functions as F

from costlens.operators import calibration
from costlens.plans.q_cost import GRID_SQL
from costlens.plans.q_split import _RN_SQL, _SPLIT3_SQL, KEYS, KEYS_SQL, split3
from costlens.functions import portable_hash_sql
from costlens.plans.registry import register
from costlens.plans.views import SCORED_SQL, with_sql

_ISO_CTES = [
    SCORED_SQL,
    _RN_SQL,
    _SPLIT3_SQL,
    """g AS (SELECT score AS x, sum(label)::DOUBLE AS s, count(*)::DOUBLE AS w, row_number() OVER (ORDER BY score) AS i
          FROM split3 WHERE part = 'calib' GROUP BY score)""",
    "c AS (SELECT *, sum(s) OVER (ORDER BY i) AS cs, sum(w) OVER (ORDER BY i) AS cw FROM g)",
    "pairs AS (SELECT a.i AS a, b.i AS b, (b.cs - a.cs + a.s) / (b.cw - a.cw + a.w) AS av FROM c a JOIN c b ON a.i <= b.i)",
    """m AS (SELECT a, b, min(av) OVER (PARTITION BY a ORDER BY b DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS mn
          FROM pairs)""",
    "fit AS (SELECT b AS i, max(mn) AS y FROM m GROUP BY b)",
    "knots AS (SELECT c.x, fit.y FROM c JOIN fit ON c.i = fit.i)",
    f"test AS (SELECT {KEYS_SQL}, score FROM split3 WHERE part = 'test')",
    """lo AS (SELECT t.*, k.x AS lo_x, k.y AS lo_y FROM test t ASOF LEFT JOIN knots k ON t.score >= k.x)""",
    """hl AS (SELECT l.*, k.x AS hi_x, k.y AS hi_y FROM lo l ASOF LEFT JOIN knots k ON l.score <= k.x)""",
    f"""iso AS (SELECT {KEYS_SQL}, score, round(CASE WHEN lo_x IS NULL THEN hi_y WHEN hi_x IS NULL THEN lo_y
  WHEN lo_x = hi_x THEN lo_y ELSE lo_y + (hi_y - lo_y) * (score - lo_x) / (hi_x - lo_x) END, 6) AS isotonic_score
FROM hl)""",
]
_ISO_SQL = with_sql(*_ISO_CTES, body="SELECT * FROM iso")


@register("isotonic", _ISO_SQL)
def q_isotonic(spark, sf):
    s = split3(spark, sf)
    model = calibration.fit_isotonic(s.where(F.col("part") == "calib"))
    test = s.where(F.col("part") == "test").select(*KEYS, "score")
    out = calibration.apply_isotonic(test, model)
    return out.select(*KEYS, "score", F.round("isotonic_score", 6).alias("isotonic_score"))


@register("platt")
def q_platt(spark, sf):
    """Platt-scaled test scores (rows-only: an iterative fit, checked by invariants)."""
    s = split3(spark, sf)
    model = calibration.fit_platt(s.where(F.col("part") == "calib"))
    test = s.where(F.col("part") == "test").select(*KEYS, "score")
    return calibration.apply_platt(test, model).select(*KEYS, "score", F.round("platt_score", 6).alias("platt_score"))


@register("calibration_comparison")
def q_calibration_comparison(spark, sf):
    """raw / platt / isotonic: Brier score, optimal threshold and cost on the test slice."""
    s = split3(spark, sf)
    calib = s.where(F.col("part") == "calib")
    test = s.where(F.col("part") == "test").select("label", "score")
    return calibration.calibration_comparison(calibration.calibrated_scores(test, calib))


_CMP_SQL = with_sql(
    *_ISO_CTES,
    GRID_SQL,
    """meth AS (SELECT 'score' AS method, label, score AS s FROM iso
          UNION ALL SELECT 'isotonic_score' AS method, label, isotonic_score AS s FROM iso)""",
    """cc AS (SELECT mt.method, g.threshold,
            sum(CASE WHEN mt.label = 1 AND mt.s < g.threshold THEN 1 ELSE 0 END) AS fn,
            sum(CASE WHEN mt.label = 0 AND mt.s >= g.threshold THEN 1 ELSE 0 END) AS fp
          FROM meth mt CROSS JOIN grid g GROUP BY mt.method, g.threshold)""",
    """best AS (SELECT * FROM (SELECT method, threshold, fn * 500.0::DOUBLE + fp * 5.0::DOUBLE AS cost,
            row_number() OVER (PARTITION BY method ORDER BY fn * 500.0::DOUBLE + fp * 5.0::DOUBLE, threshold) AS rn FROM cc) t
          WHERE rn = 1)""",
    "brier AS (SELECT method, round(avg(power(s - label, 2)), 6) AS brier_score FROM meth GROUP BY method)",
    body="""SELECT b.method, b.brier_score, best.threshold AS optimal_threshold, best.cost AS optimal_cost
FROM brier b JOIN best ON b.method = best.method""",
)


@register("calibration_raw_vs_isotonic", _CMP_SQL)
def q_calibration_raw_vs_isotonic(spark, sf):
    """L3 for the raw and isotonic scores (isotonic rounded to 1e-6 in both engines)."""
    iso = q_isotonic(spark, sf)
    return calibration.calibration_comparison(iso, methods=("score", "isotonic_score"))


_INT_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "time_us"]
_UNDER_HASH = portable_hash_sql(0, *_INT_KEYS)
_REL_SQL = with_sql(
    *_ISO_CTES,
    """ic AS (SELECT CAST(sum(label) AS BIGINT) AS p, count(*) - CAST(sum(label) AS BIGINT) AS q FROM iso)""",
    f"""neg AS (SELECT *, row_number() OVER (ORDER BY {_UNDER_HASH}, {KEYS_SQL}) AS rn FROM iso WHERE label <> 1)""",
    """plot AS (SELECT label, score, isotonic_score FROM iso WHERE label = 1
      UNION ALL SELECT label, score, isotonic_score FROM neg WHERE rn <= (SELECT least(20 * p, q) FROM ic))""",
    """long AS (SELECT 'score' AS method, label, score AS s FROM plot
      UNION ALL SELECT 'isotonic_score' AS method, label, isotonic_score AS s FROM plot)""",
    """e AS (SELECT method, quantile_cont(s, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM long GROUP BY method)""",
    body="""SELECT l.method, CAST(len(list_filter(e.q, lambda x: x < l.s)) AS INTEGER) AS bin,
  sum(l.label) / count(*) AS prob_true, round(avg(l.s), 6) AS prob_pred, count(*) AS n
FROM long l JOIN e ON l.method = e.method GROUP BY l.method, 2""",
)


@register("reliability_raw_vs_isotonic", _REL_SQL)
def q_reliability_raw_vs_isotonic(spark, sf):
    """Reliability curves (10 quantile bins) of the raw and isotonic test scores on
    the fraud-oversampled plotting subset: all positives + 20x negatives."""
    from costlens.operators import metrics, sampling

    iso = q_isotonic(spark, sf)
    plot = sampling.undersample_majority(iso, KEYS[:-1], ratio=20, seed=0, hash_cols=_INT_KEYS)
    out = None
    for method in ("score", "isotonic_score"):
        curve = metrics.reliability_curve(plot, 10, score=method).select(F.lit(method).alias("method"), "*")
        out = curve if out is None else out.unionByName(curve)
    return out
