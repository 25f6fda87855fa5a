"""Ranking and threshold metrics over a scored table (label 0/1, score double).

* confusion counts / precision / recall / F1 / FPR / FNR: one aggregation of
  conditional sums (labels fixed to {0, 1}; empty denominators give 0);
* average precision (step sum over distinct scores, not a trapezoid) and
  ROC-AUC (Mann-Whitney, ties get half credit): the rows are grouped by score
  (map-side combine), then one distributed prefix sum in descending score
  order feeds both; the AUC numerator is an exact integer;
* precision@k: a top-k (TakeOrderedAndProject, k rows per task);
* reliability curve: exact quantile edges, bin = #interior edges < score;
* Brier score.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costlens.functions import count_lt, round6, safe_div
from costlens.operators.frames import materialize, side_by_side
from costlens.operators.ordered import percentile_values, prefix_sums


def confusion(scored: DataFrame, threshold: float = 0.5, *, by: Sequence[str] = (), score="score", label="label") -> DataFrame:
    flag = F.col(score) >= F.lit(float(threshold))
    pos = F.col(label) == 1
    one = F.lit(1)
    return scored.groupBy(*by).agg(
        F.count(F.when(pos & flag, one)).alias("true_positives"),
        F.count(F.when(~pos & ~flag, one)).alias("true_negatives"),
        F.count(F.when(~pos & flag, one)).alias("false_positives"),
        F.count(F.when(pos & ~flag, one)).alias("false_negatives"),
    )


def rate_columns() -> list:
    tp, tn, fp, fn = (F.col(c) for c in ("true_positives", "true_negatives", "false_positives", "false_negatives"))
    return [
        safe_div(tp, tp + fp).alias("precision"),
        safe_div(tp, tp + fn).alias("recall"),
        safe_div(2 * tp, 2 * tp + fp + fn).alias("f1"),
        safe_div(fp, fp + tn).alias("false_positive_rate"),
        safe_div(fn, fn + tp).alias("false_negative_rate"),
    ]


def rates(scored: DataFrame, threshold: float = 0.5, *, by: Sequence[str] = ()) -> DataFrame:
    c = confusion(scored, threshold, by=by)
    return c.select(*by, F.lit(float(threshold)).alias("threshold"), *rate_columns())


def score_counts(scored: DataFrame, *, by: Sequence[str] = (), score="score", label="label") -> DataFrame:
    """(by..., score, pos, cnt): rows collapsed to distinct scores (map-side combine)."""
    return scored.groupBy(*by, score).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.count(F.lit(1)).alias("cnt"))


def confusion_from_counts(g: DataFrame, threshold: float, *, by: Sequence[str] = (), score="score") -> DataFrame:
    """Confusion counts from the distinct-score frame (shares its shuffle with the rank metrics)."""
    flag = F.col(score) >= F.lit(float(threshold))
    neg = F.col("cnt") - F.col("pos")
    zero = F.lit(0).cast("long")
    return g.groupBy(*by).agg(
        F.sum(F.when(flag, F.col("pos")).otherwise(zero)).alias("true_positives"),
        F.sum(F.when(~flag, neg).otherwise(zero)).alias("true_negatives"),
        F.sum(F.when(flag, neg).otherwise(zero)).alias("false_positives"),
        F.sum(F.when(~flag, F.col("pos")).otherwise(zero)).alias("false_negatives"),
    )


#: Counts of up to 10^19 rows: their products fit decimal(38, 0) where a long overflows.
_EXACT = "decimal(19,0)"


def rank_metrics(scored: DataFrame, *, by: Sequence[str] = (), score="score", label="label") -> DataFrame:
    """(by..., pr_auc, roc_auc) — AP as a step sum, AUC with half credit for ties."""
    return rank_from_counts(score_counts(scored, by=by, score=score, label=label), by=by, score=score)


def rank_from_counts(g: DataFrame, *, by: Sequence[str] = (), score="score") -> DataFrame:
    """(by..., pr_auc, roc_auc) from the distinct-score frame."""
    by = list(by)
    ps = prefix_sums(g, score, ["pos", "cnt"], by=by, descending=True)
    neg = F.col("cnt") - F.col("pos")
    cum_neg = F.col("cum_cnt") - F.col("cum_pos")
    agg = ps.groupBy(*by).agg(
        F.sum("pos").alias("_P"),
        F.sum(neg).alias("_N"),
        F.sum(F.col("pos") * F.col("cum_pos") / F.col("cum_cnt")).alias("_ap"),
        F.sum(F.col("pos").cast(_EXACT) * (2 * cum_neg - neg)).cast("decimal(38,0)").alias("_s"),
    )
    P, N = F.col("_P"), F.col("_N")
    return agg.select(
        *by,
        F.when(P > 0, round6(F.col("_ap") / P)).alias("pr_auc"),
        F.when((P > 0) & (N > 0), ((2 * N).cast(_EXACT) * P.cast(_EXACT) - F.col("_s")).cast("double") / (F.lit(2.0) * P * N)).alias("roc_auc"),
    )


def average_precision(scored: DataFrame, **kw) -> DataFrame:
    return rank_metrics(scored, **kw).drop("roc_auc")


def roc_auc(scored: DataFrame, **kw) -> DataFrame:
    return rank_metrics(scored, **kw).drop("pr_auc")


def precision_at_k(scored: DataFrame, k: int, id_cols: Sequence[str], *, score="score", label="label") -> DataFrame:
    """Mean label of the k highest scores (ties by id); k <= 0 gives 0."""
    name = f"precision_at_{k}"
    if k <= 0:
        return scored.agg(F.lit(0.0).alias(name))
    top = scored.select(score, label, *id_cols).orderBy(F.col(score).desc(), *[F.col(c).asc() for c in id_cols]).limit(int(k))
    return top.agg(F.coalesce(F.avg(F.col(label).cast("double")), F.lit(0.0)).alias(name))


def evaluate_full(scored: DataFrame, threshold: float = 0.5, k: int = 100, id_cols: Sequence[str] = ()) -> DataFrame:
    """The 13-metric record of one operating point."""
    g = materialize(score_counts(scored))  # one scan and one shuffle of the rows for both
    c = confusion_from_counts(g, threshold)
    r = rank_from_counts(g)
    p = precision_at_k(scored, k, id_cols)
    row = side_by_side(c, r, p)
    rc = rate_columns()
    return row.select(
        F.lit(float(threshold)).alias("threshold"),
        *rc[:3],
        "pr_auc",
        "roc_auc",
        "true_positives",
        "true_negatives",
        "false_positives",
        "false_negatives",
        *rc[3:],
        f"precision_at_{k}",
    )


def evaluate_basic(scored: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """pr_auc, roc_auc, f1_at_0.5 — the model-comparison triple."""
    by = list(by)
    g = materialize(score_counts(scored, by=by))
    c = confusion_from_counts(g, 0.5, by=by).select(*by, rate_columns()[2].alias("f1_at_0.5"))
    r = rank_from_counts(g, by=by)
    if by:
        return r.join(c, by)
    return side_by_side(r, c)


def reliability_curve(scored: DataFrame, n_bins: int = 10, *, score="score", label="label") -> DataFrame:
    """Quantile-binned calibration curve: (bin, prob_true, prob_pred, n); empty bins dropped."""
    edges = percentile_values(scored, score, [i / n_bins for i in range(n_bins + 1)])
    interior = [e for e in edges[1:-1] if e is not None]
    b = count_lt(score, interior) if interior else F.lit(0)
    return scored.groupBy(b.alias("bin")).agg(
        (F.sum(F.col(label).cast("long")) / F.count(F.lit(1))).alias("prob_true"),
        round6(F.avg(score)).alias("prob_pred"),
        F.count(F.lit(1)).alias("n"),
    )


def brier_score(scored: DataFrame, *, by: Sequence[str] = (), score="score", label="label") -> DataFrame:
    return scored.groupBy(*by).agg(round6(F.avg(F.pow(F.col(score) - F.col(label), 2))).alias("brier_score"))
