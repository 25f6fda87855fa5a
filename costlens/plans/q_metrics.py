"""Registered metric queries (M1-M9, G10) on the scored lineitem view."""

from __future__ import annotations

from costlens.operators import metrics
from costlens.plans.registry import register
from costlens.plans.views import SCORED_ID, SCORED_ID_SQL, SCORED_SQL, scored, with_sql

_CONF_SQL = """conf AS (
  SELECT
    CAST(count(CASE WHEN label = 1 AND score >= 0.5 THEN 1 END) AS BIGINT) AS true_positives,
    CAST(count(CASE WHEN label = 0 AND score < 0.5 THEN 1 END) AS BIGINT) AS true_negatives,
    CAST(count(CASE WHEN label = 0 AND score >= 0.5 THEN 1 END) AS BIGINT) AS false_positives,
    CAST(count(CASE WHEN label = 1 AND score < 0.5 THEN 1 END) AS BIGINT) AS false_negatives
  FROM scored)"""

_RATES = """
  CASE WHEN true_positives + false_positives = 0 THEN 0.0 ELSE true_positives::DOUBLE / (true_positives + false_positives) END AS precision,
  CASE WHEN true_positives + false_negatives = 0 THEN 0.0 ELSE true_positives::DOUBLE / (true_positives + false_negatives) END AS recall,
  CASE WHEN 2 * true_positives + false_positives + false_negatives = 0 THEN 0.0
       ELSE (2 * true_positives)::DOUBLE / (2 * true_positives + false_positives + false_negatives) END AS f1"""
_RATES2 = """
  CASE WHEN false_positives + true_negatives = 0 THEN 0.0 ELSE false_positives::DOUBLE / (false_positives + true_negatives) END AS false_positive_rate,
  CASE WHEN false_negatives + true_positives = 0 THEN 0.0 ELSE false_negatives::DOUBLE / (false_negatives + true_positives) END AS false_negative_rate"""

_RANK_SQL = """g AS (SELECT score, CAST(sum(label) AS BIGINT) AS pos, count(*) AS cnt FROM scored GROUP BY score),
c AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS cum_pos, sum(cnt) OVER (ORDER BY score DESC) AS cum_cnt FROM g),
rank AS (
  SELECT round(sum(pos * cum_pos / cum_cnt) / sum(pos), 6) AS pr_auc,
    (2 * sum(cnt - pos) * sum(pos) - sum(pos * (2 * (cum_cnt - cum_pos) - (cnt - pos))))::DOUBLE
      / (2.0::DOUBLE * sum(pos) * sum(cnt - pos)) AS roc_auc
  FROM c)"""

_PAK_SQL = f"""pak AS (SELECT avg(label::DOUBLE) AS precision_at_100 FROM (
  SELECT label FROM scored ORDER BY score DESC, {SCORED_ID_SQL} LIMIT 100) t)"""


@register("confusion", with_sql(SCORED_SQL, _CONF_SQL, body="SELECT * FROM conf"))
def q_confusion(spark, sf):
    return metrics.confusion(scored(spark, sf), 0.5)


@register("rates", with_sql(SCORED_SQL, _CONF_SQL, body=f"SELECT 0.5::DOUBLE AS threshold, {_RATES}, {_RATES2} FROM conf"))
def q_rates(spark, sf):
    return metrics.rates(scored(spark, sf), 0.5)


@register("average_precision", with_sql(SCORED_SQL, _RANK_SQL, body="SELECT pr_auc FROM rank"))
def q_average_precision(spark, sf):
    return metrics.average_precision(scored(spark, sf))


@register("roc_auc", with_sql(SCORED_SQL, _RANK_SQL, body="SELECT roc_auc FROM rank"))
def q_roc_auc(spark, sf):
    return metrics.roc_auc(scored(spark, sf))


@register("precision_at_k", with_sql(SCORED_SQL, _PAK_SQL, body="SELECT precision_at_100 FROM pak"))
def q_precision_at_k(spark, sf):
    return metrics.precision_at_k(scored(spark, sf), 100, SCORED_ID)


@register(
    "evaluate_full",
    with_sql(
        SCORED_SQL,
        _CONF_SQL,
        _RANK_SQL,
        _PAK_SQL,
        body=f"""SELECT 0.5::DOUBLE AS threshold, {_RATES}, pr_auc, roc_auc,
  true_positives, true_negatives, false_positives, false_negatives, {_RATES2}, precision_at_100
FROM conf, rank, pak""",
    ),
)
def q_evaluate_full(spark, sf):
    return metrics.evaluate_full(scored(spark, sf), 0.5, 100, SCORED_ID)


@register(
    "evaluate_basic",
    with_sql(
        SCORED_SQL,
        _CONF_SQL,
        _RANK_SQL,
        body="""SELECT pr_auc, roc_auc,
  CASE WHEN 2 * true_positives + false_positives + false_negatives = 0 THEN 0.0
       ELSE (2 * true_positives)::DOUBLE / (2 * true_positives + false_positives + false_negatives) END AS "f1_at_0.5"
FROM rank, conf""",
    ),
)
def q_evaluate_basic(spark, sf):
    return metrics.evaluate_basic(scored(spark, sf))


@register(
    "evaluate_by_segment",
    with_sql(
        SCORED_SQL,
        """g AS (SELECT segment, score, CAST(sum(label) AS BIGINT) AS pos, count(*) AS cnt FROM scored GROUP BY segment, score),
c AS (SELECT *, sum(pos) OVER (PARTITION BY segment ORDER BY score DESC) AS cum_pos,
               sum(cnt) OVER (PARTITION BY segment ORDER BY score DESC) AS cum_cnt FROM g),
rank AS (
  SELECT segment,
    CASE WHEN sum(pos) > 0 THEN round(sum(pos * cum_pos / cum_cnt) / sum(pos), 6) END AS pr_auc,
    CASE WHEN sum(pos) > 0 AND sum(cnt - pos) > 0 THEN
    (2 * sum(cnt - pos) * sum(pos) - sum(pos * (2 * (cum_cnt - cum_pos) - (cnt - pos))))::DOUBLE
      / (2.0::DOUBLE * sum(pos) * sum(cnt - pos)) END AS roc_auc
  FROM c GROUP BY segment),
f AS (SELECT segment,
  CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE (2 * tp)::DOUBLE / (2 * tp + fp + fn) END AS "f1_at_0.5"
  FROM (SELECT segment, count(CASE WHEN label = 1 AND score >= 0.5 THEN 1 END) AS tp,
               count(CASE WHEN label = 0 AND score >= 0.5 THEN 1 END) AS fp,
               count(CASE WHEN label = 1 AND score < 0.5 THEN 1 END) AS fn FROM scored GROUP BY segment) x)""",
        body="SELECT rank.segment, pr_auc, roc_auc, \"f1_at_0.5\" FROM rank JOIN f ON rank.segment = f.segment",
    ),
)
def q_evaluate_by_segment(spark, sf):
    return metrics.evaluate_basic(scored(spark, sf), by=["segment"])


@register(
    "reliability_curve",
    with_sql(
        SCORED_SQL,
        "e AS (SELECT quantile_cont(score, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM scored)",
        body="""SELECT CAST(len(list_filter(e.q, lambda x: x < s.score)) AS INTEGER) AS bin,
  sum(s.label) / count(*) AS prob_true, round(avg(s.score), 6) AS prob_pred, count(*) AS n
FROM scored s, e GROUP BY 1""",
    ),
)
def q_reliability_curve(spark, sf):
    return metrics.reliability_curve(scored(spark, sf), 10)


@register("brier_score", with_sql(SCORED_SQL, body="SELECT round(avg(power(score - label, 2)), 6) AS brier_score FROM scored"))
def q_brier_score(spark, sf):
    return metrics.brier_score(scored(spark, sf))
