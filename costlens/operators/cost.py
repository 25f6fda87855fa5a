"""Cost engine: expected cost, threshold sweeps, cost-ratio sensitivity.

Design: the data is scanned once per question.  Each row is placed in the
threshold bucket ``b = #(grid <= score)`` (a 7-level CASE tree for the default
101-point grid), then rows collapse to at most (grid+1) x 2 counts per group
(map-side partial aggregation, so the shuffle is tiny even at 100 TB).  Every
threshold's confusion counts are suffix sums over that tiny frame, and every
cost ratio reuses the same cost-independent counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costlens.functions import count_le, default_grid, safe_div

# Fixed values (must equal the reference): illustrative dollar costs of a
# missed positive (false negative) and of a false alarm (false positive), the
# thresholds of the fixed comparison table and the sensitivity cost ratios.
DEFAULT_COST_FN = 500.0
DEFAULT_COST_FP = 5.0
FIXED_THRESHOLDS = [0.50, 0.20, 0.08, 0.05, 0.02]
SENSITIVITY_RATIOS = [1, 5, 10, 25, 50, 100, 250, 500]


def counts_curve(
    scored: DataFrame,
    grid: Sequence[float] | None = None,
    *,
    by: Sequence[str] = (),
    score: str = "score",
    label: str = "label",
) -> DataFrame:
    """(by..., ti, threshold, tp, fp, fn, tn) for every threshold of ``grid``.

    A row is flagged at threshold t when score >= t (inclusive).
    """
    by = list(by)
    g = sorted(float(t) for t in (grid if grid is not None else default_grid()))
    n = len(g)
    agg = scored.groupBy(*by, count_le(score, g).alias("_b")).agg(
        F.sum(F.col(label).cast("long")).alias("_pos"), F.count(F.lit(1)).alias("_cnt")
    )
    if not by:
        # a zero-count row changes no sum but makes every threshold present even for empty input
        zero = scored.sparkSession.range(1).select(
            F.lit(0).alias("_b"), F.lit(0).cast("long").alias("_pos"), F.lit(0).cast("long").alias("_cnt")
        )
        agg = agg.unionByName(zero)
    exploded = agg.select(
        *by,
        "_b",
        "_pos",
        (F.col("_cnt") - F.col("_pos")).alias("_neg"),
        F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("ti"),
    )
    flagged = F.col("_b") > F.col("ti")
    curve = exploded.groupBy(*by, "ti").agg(
        F.sum(F.when(flagged, F.col("_pos")).otherwise(F.lit(0))).alias("tp"),
        F.sum(F.when(flagged, F.col("_neg")).otherwise(F.lit(0))).alias("fp"),
        F.sum("_pos").alias("_P"),
        F.sum("_neg").alias("_N"),
    )
    grid_arr = F.array(*[F.lit(t) for t in g])
    return curve.select(
        *by,
        "ti",
        F.element_at(grid_arr, F.col("ti") + 1).alias("threshold"),
        "tp",
        "fp",
        (F.col("_P") - F.col("tp")).alias("fn"),
        (F.col("_N") - F.col("fp")).alias("tn"),
    )


def _cost(cost_fn: float, cost_fp: float):
    return F.col("fn") * F.lit(float(cost_fn)) + F.col("fp") * F.lit(float(cost_fp))


def threshold_cost_curve(
    scored: DataFrame,
    cost_fn: float = DEFAULT_COST_FN,
    cost_fp: float = DEFAULT_COST_FP,
    grid: Sequence[float] | None = None,
    *,
    by: Sequence[str] = (),
) -> DataFrame:
    """Expected cost fn*cost_fn + fp*cost_fp at each threshold of the grid."""
    c = counts_curve(scored, grid, by=by)
    return c.select(*by, "threshold", "tp", "fp", "fn", "tn", _cost(cost_fn, cost_fp).alias("cost"))


def optimize_threshold(curve: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """Argmin of cost; equal costs go to the lowest threshold."""
    best = F.min_by(F.struct("threshold", "cost"), F.struct("cost", "threshold")).alias("_best")
    agg = curve.groupBy(*by).agg(best)
    return agg.select(*by, F.col("_best.threshold").alias("optimal_threshold"), F.col("_best.cost").alias("optimal_cost"))


def expected_cost(
    scored: DataFrame, threshold: float, cost_fn: float = DEFAULT_COST_FN, cost_fp: float = DEFAULT_COST_FP
) -> DataFrame:
    c = counts_curve(scored, [threshold])
    return c.select(
        "threshold",
        F.col("fn").alias("false_negatives"),
        F.col("fp").alias("false_positives"),
        _cost(cost_fn, cost_fp).alias("expected_cost"),
    )


def cost_ratio_sweep(
    scored: DataFrame,
    ratios: Sequence[float] = SENSITIVITY_RATIOS,
    cost_fp: float = DEFAULT_COST_FP,
    grid: Sequence[float] | None = None,
    *,
    by: Sequence[str] = (),
    with_rates: bool = False,
) -> DataFrame:
    """Optimum threshold per cost ratio (cost_fn = ratio * cost_fp).

    The counts curve does not depend on costs, so it is computed once and
    each ratio is an ``explode`` of that tiny frame (no rescan, no join).
    """
    by = list(by)
    c = counts_curve(scored, grid, by=by)
    ratio_arr = F.array(*[F.lit(float(r)) for r in ratios])
    per = c.select("*", F.explode(ratio_arr).alias("cost_ratio")).withColumn(
        "cost", F.col("fn") * F.col("cost_ratio") * F.lit(float(cost_fp)) + F.col("fp") * F.lit(float(cost_fp))
    )
    best = F.min_by(
        F.struct("threshold", "cost", "tp", "fp", "fn", "tn"), F.struct("cost", "threshold")
    ).alias("_b")
    agg = per.groupBy(*by, "cost_ratio").agg(best)
    cols = [
        *by,
        "cost_ratio",
        (F.col("cost_ratio") * F.lit(float(cost_fp))).alias("cost_fn"),
        F.lit(float(cost_fp)).alias("cost_fp"),
        F.col("_b.threshold").alias("optimal_threshold"),
        F.col("_b.cost").alias("optimal_cost"),
    ]
    if with_rates:
        cols += [
            safe_div(F.col("_b.tp"), F.col("_b.tp") + F.col("_b.fp")).alias("precision"),
            safe_div(F.col("_b.tp"), F.col("_b.tp") + F.col("_b.fn")).alias("recall"),
            safe_div(F.col("_b.fp"), F.col("_b.fp") + F.col("_b.tn")).alias("false_positive_rate"),
        ]
    return agg.select(*cols)


def enriched_sensitivity(
    scored: DataFrame, ratios: Sequence[float] = SENSITIVITY_RATIOS, cost_fp: float = DEFAULT_COST_FP
) -> DataFrame:
    """Sensitivity sweep with precision / recall / FPR at each ratio's optimum."""
    s = cost_ratio_sweep(scored, ratios, cost_fp, with_rates=True)
    return s.select("cost_ratio", "optimal_threshold", "precision", "recall", "false_positive_rate")


def optimal_threshold_value(
    scored: DataFrame, cost_fn: float = DEFAULT_COST_FN, cost_fp: float = DEFAULT_COST_FP
) -> float:
    """Scalar optimum on the default grid (one bounded row to the driver)."""
    return float(optimize_threshold(threshold_cost_curve(scored, cost_fn, cost_fp)).first()["optimal_threshold"])


def fixed_threshold_table(
    scored: DataFrame,
    thresholds: Sequence[float] = FIXED_THRESHOLDS,
    cost_fn: float = DEFAULT_COST_FN,
    cost_fp: float = DEFAULT_COST_FP,
    optimal_threshold: float | None = None,
) -> DataFrame:
    """Head-to-head table of fixed thresholds with a cost-optimal marker."""
    if optimal_threshold is None:
        optimal_threshold = optimal_threshold_value(scored, cost_fn, cost_fp)
    c = counts_curve(scored, thresholds)
    return c.select(
        "threshold",
        safe_div(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        safe_div(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
        F.col("fp").alias("false_positives"),
        F.col("fn").alias("false_negatives"),
        _cost(cost_fn, cost_fp).alias("expected_cost"),
        (F.abs(F.col("threshold") - F.lit(float(optimal_threshold))) < F.lit(1e-9)).alias("is_cost_optimal"),
    )


def cost_reduction_pct(
    scored: DataFrame,
    threshold: float,
    default_threshold: float = 0.5,
    cost_fn: float = DEFAULT_COST_FN,
    cost_fp: float = DEFAULT_COST_FP,
    *,
    by: Sequence[str] = (),
) -> DataFrame:
    """100 * (cost@default - cost@threshold) / cost@default, 0 when cost@default is 0."""
    by = list(by)
    c = counts_curve(scored, sorted({float(threshold), float(default_threshold)}), by=by)
    cost = _cost(cost_fn, cost_fp)
    agg = c.groupBy(*by).agg(
        F.max(F.when(F.col("threshold") == F.lit(float(default_threshold)), cost)).alias("default_cost"),
        F.max(F.when(F.col("threshold") == F.lit(float(threshold)), cost)).alias("threshold_cost"),
    )
    pct = F.when(F.col("default_cost") == 0, F.lit(0.0)).otherwise(
        F.lit(100.0) * (F.col("default_cost") - F.col("threshold_cost")) / F.col("default_cost")
    )
    return agg.select(
        *by,
        F.lit(float(threshold)).alias("threshold"),
        F.lit(float(default_threshold)).alias("default_threshold"),
        "default_cost",
        "threshold_cost",
        pct.alias("cost_reduction_pct"),
    )
