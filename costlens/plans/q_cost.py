"""Registered cost-engine queries (K1-K7) on the scored lineitem view."""

from __future__ import annotations

from costlens.operators import cost
from costlens.plans.registry import register
from costlens.plans.views import SCORED_SQL, scored, with_sql

GRID_SQL = "grid AS (SELECT i AS ti, i * 0.01::DOUBLE AS threshold FROM range(101) t(i))"


def _counts_sql(by: str = "") -> str:
    """Naive oracle: every threshold against every row (cross join)."""
    sel_by = f"s.{by}, " if by else ""
    grp_by = f", s.{by}" if by else ""
    return f"""counts AS (
  SELECT {sel_by}g.threshold,
    CAST(sum(CASE WHEN s.label = 1 AND s.score >= g.threshold THEN 1 ELSE 0 END) AS BIGINT) AS tp,
    CAST(sum(CASE WHEN s.label = 0 AND s.score >= g.threshold THEN 1 ELSE 0 END) AS BIGINT) AS fp,
    CAST(sum(CASE WHEN s.label = 1 AND s.score < g.threshold THEN 1 ELSE 0 END) AS BIGINT) AS fn,
    CAST(sum(CASE WHEN s.label = 0 AND s.score < g.threshold THEN 1 ELSE 0 END) AS BIGINT) AS tn
  FROM grid g CROSS JOIN scored s
  GROUP BY g.threshold{grp_by}
)"""


def _list_grid(values) -> str:
    rows = ", ".join(f"({float(v)!r}::DOUBLE)" for v in values)
    return f"grid AS (SELECT threshold FROM (VALUES {rows}) v(threshold))"


_CURVE_SQL = with_sql(
    SCORED_SQL,
    GRID_SQL,
    _counts_sql(),
    body="SELECT threshold, tp, fp, fn, tn, fn * 500.0::DOUBLE + fp * 5.0::DOUBLE AS cost FROM counts",
)


@register("threshold_cost_curve", _CURVE_SQL)
def q_threshold_cost_curve(spark, sf):
    return cost.threshold_cost_curve(scored(spark, sf))


@register(
    "optimal_threshold",
    with_sql(
        SCORED_SQL,
        GRID_SQL,
        _counts_sql(),
        body="""SELECT threshold AS optimal_threshold, fn * 500.0::DOUBLE + fp * 5.0::DOUBLE AS optimal_cost
FROM counts ORDER BY optimal_cost, optimal_threshold LIMIT 1""",
    ),
)
def q_optimal_threshold(spark, sf):
    return cost.optimize_threshold(cost.threshold_cost_curve(scored(spark, sf)))


@register(
    "expected_cost_fixed",
    with_sql(
        SCORED_SQL,
        body="""SELECT 0.5::DOUBLE AS threshold,
  CAST(sum(CASE WHEN label = 1 AND score < 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS false_negatives,
  CAST(sum(CASE WHEN label = 0 AND score >= 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS false_positives,
  sum(CASE WHEN label = 1 AND score < 0.5 THEN 500.0::DOUBLE WHEN label = 0 AND score >= 0.5 THEN 5.0::DOUBLE ELSE 0.0::DOUBLE END) AS expected_cost
FROM scored""",
    ),
)
def q_expected_cost_fixed(spark, sf):
    return cost.expected_cost(scored(spark, sf), 0.5)


_OPT_CTE = """opt AS (SELECT threshold AS t_opt FROM counts ORDER BY fn * 500.0::DOUBLE + fp * 5.0::DOUBLE, threshold LIMIT 1)"""


@register(
    "fixed_threshold_table",
    with_sql(
        SCORED_SQL,
        GRID_SQL,
        _counts_sql(),
        _OPT_CTE,
        _list_grid(cost.FIXED_THRESHOLDS).replace("grid AS", "fixed AS"),
        """fc AS (
  SELECT f.threshold,
    CAST(sum(CASE WHEN s.label = 1 AND s.score >= f.threshold THEN 1 ELSE 0 END) AS BIGINT) AS tp,
    CAST(sum(CASE WHEN s.label = 0 AND s.score >= f.threshold THEN 1 ELSE 0 END) AS BIGINT) AS fp,
    CAST(sum(CASE WHEN s.label = 1 AND s.score < f.threshold THEN 1 ELSE 0 END) AS BIGINT) AS fn
  FROM fixed f CROSS JOIN scored s GROUP BY f.threshold)""",
        body="""SELECT threshold,
  CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp::DOUBLE / (tp + fp) END AS precision,
  CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp::DOUBLE / (tp + fn) END AS recall,
  fp AS false_positives, fn AS false_negatives,
  fn * 500.0::DOUBLE + fp * 5.0::DOUBLE AS expected_cost,
  abs(threshold - (SELECT t_opt FROM opt)) < 1e-9 AS is_cost_optimal
FROM fc""",
    ),
)
def q_fixed_threshold_table(spark, sf):
    return cost.fixed_threshold_table(scored(spark, sf))


@register(
    "cost_reduction_pct",
    with_sql(
        SCORED_SQL,
        GRID_SQL,
        _counts_sql(),
        _OPT_CTE,
        """two AS (
  SELECT
    sum(CASE WHEN label = 1 AND score < 0.5 THEN 500.0::DOUBLE WHEN label = 0 AND score >= 0.5 THEN 5.0::DOUBLE ELSE 0.0 END) AS default_cost,
    sum(CASE WHEN label = 1 AND score < (SELECT t_opt FROM opt) THEN 500.0::DOUBLE
             WHEN label = 0 AND score >= (SELECT t_opt FROM opt) THEN 5.0::DOUBLE ELSE 0.0 END) AS threshold_cost
  FROM scored)""",
        body="""SELECT (SELECT t_opt FROM opt) AS threshold, 0.5::DOUBLE AS default_threshold, default_cost, threshold_cost,
  CASE WHEN default_cost = 0 THEN 0.0 ELSE 100.0 * (default_cost - threshold_cost) / default_cost END AS cost_reduction_pct
FROM two""",
    ),
)
def q_cost_reduction_pct(spark, sf):
    s = scored(spark, sf)
    return cost.cost_reduction_pct(s, cost.optimal_threshold_value(s), 0.5)


_RATIOS_SQL = "ratios AS (SELECT r::DOUBLE AS cost_ratio FROM (VALUES " + ", ".join(
    f"({r})" for r in cost.SENSITIVITY_RATIOS
) + ") v(r))"

_SWEEP_SQL = """sweep AS (
  SELECT * FROM (
    SELECT r.cost_ratio, c.threshold, c.tp, c.fp, c.fn, c.tn,
      c.fn * r.cost_ratio * 5.0::DOUBLE + c.fp * 5.0::DOUBLE AS cost,
      row_number() OVER (PARTITION BY r.cost_ratio ORDER BY c.fn * r.cost_ratio * 5.0::DOUBLE + c.fp * 5.0::DOUBLE, c.threshold) AS rn
    FROM counts c CROSS JOIN ratios r) x
  WHERE rn = 1)"""


@register(
    "cost_ratio_sweep",
    with_sql(
        SCORED_SQL,
        GRID_SQL,
        _counts_sql(),
        _RATIOS_SQL,
        _SWEEP_SQL,
        body="""SELECT cost_ratio, cost_ratio * 5.0::DOUBLE AS cost_fn, 5.0::DOUBLE AS cost_fp,
  threshold AS optimal_threshold, cost AS optimal_cost FROM sweep""",
    ),
)
def q_cost_ratio_sweep(spark, sf):
    return cost.cost_ratio_sweep(scored(spark, sf))


@register(
    "enriched_sensitivity",
    with_sql(
        SCORED_SQL,
        GRID_SQL,
        _counts_sql(),
        _RATIOS_SQL,
        _SWEEP_SQL,
        body="""SELECT cost_ratio, threshold AS optimal_threshold,
  CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp::DOUBLE / (tp + fp) END AS precision,
  CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp::DOUBLE / (tp + fn) END AS recall,
  CASE WHEN fp + tn = 0 THEN 0.0 ELSE fp::DOUBLE / (fp + tn) END AS false_positive_rate
FROM sweep""",
    ),
)
def q_enriched_sensitivity(spark, sf):
    return cost.enriched_sensitivity(scored(spark, sf))


@register(
    "per_segment_threshold",
    with_sql(
        SCORED_SQL,
        GRID_SQL,
        _counts_sql("segment"),
        _RATIOS_SQL,
        body="""SELECT segment, cost_ratio, cost_ratio * 5.0::DOUBLE AS cost_fn, 5.0::DOUBLE AS cost_fp,
  threshold AS optimal_threshold, cost AS optimal_cost
FROM (
  SELECT c.segment, r.cost_ratio, c.threshold,
    c.fn * r.cost_ratio * 5.0::DOUBLE + c.fp * 5.0::DOUBLE AS cost,
    row_number() OVER (PARTITION BY c.segment, r.cost_ratio
                       ORDER BY c.fn * r.cost_ratio * 5.0::DOUBLE + c.fp * 5.0::DOUBLE, c.threshold) AS rn
  FROM counts c CROSS JOIN ratios r) x
WHERE rn = 1""",
    ),
)
def q_per_segment_threshold(spark, sf):
    return cost.cost_ratio_sweep(scored(spark, sf), by=["segment"])
