"""Distributed model fitting and scoring.

* logistic regression: L2 with C = 1 on the summed loss -> regParam = 1 / n, no standardisation beyond the feature
  contract's scaler (population statistics of the training part), maxIter 1000, by MLlib's distributed L-BFGS; kept as
  plain numbers (:class:`LinearModel`) and scored as column arithmetic;
* boosted trees: second-order trees of ``operators.trees``, 200 of depth 4, rate 0.1; class weighting through a weight
  column.  Trees need no scaler: a monotone change of a feature leaves its splits as they are;
* production model: weighted trees, threshold chosen by the cost engine on the frame passed as ``select`` (the calibration
  slice, or any other), model and JSON metadata saved and reloaded as the single source of truth for batch and streaming
  scoring.

A model has ``score(df, out)``, ``save(spark, path)`` and ``load(spark, path)``."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field

from pyspark import inheritable_thread_target
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from costlens.operators.cost import DEFAULT_COST_FN, DEFAULT_COST_FP, expected_cost, optimize_threshold, threshold_cost_curve
from costlens.operators.features import FeatureSpec, apply_scaler, fit_scaler
from costlens.operators.frames import attach_one_row, ensure_parallelism, materialize
from costlens.operators.metrics import evaluate_basic, rank_metrics
from costlens.operators.sampling import class_weight
from costlens.operators.trees import TreeEnsemble, fit_trees
from costlens.session import checkpoint_dir, ship_package

STRATEGIES = ("none", "class_weight", "smote")


def expand_array(df: DataFrame, array_col: str, n: int, prefix: str = "f", keep: Sequence[str] = ()) -> DataFrame:
    """array<double> -> named columns f0..f{n-1} (features are resolved by name)."""
    return df.select(*keep, *[F.col(array_col)[i].cast("double").alias(f"{prefix}{i}") for i in range(n)])


@dataclass
class LinearModel:
    """Logistic regression as numbers: features in order, (mean, divisor) of the scaled ones, coefficients, intercept."""

    features: list[str]
    coefficients: list[float]
    intercept: float
    scale: dict[str, tuple[float, float]] = field(default_factory=dict)

    def score(self, df: DataFrame, out: str = "score") -> DataFrame:
        """``df`` and the probability of label 1, as column arithmetic; a null feature gives a null."""
        margin = F.lit(float(self.intercept))
        for name, c in zip(self.features, self.coefficients):
            mean, divisor = self.scale.get(name, (0.0, 1.0))
            margin = margin + F.lit(float(c)) * ((F.col(f"`{name}`") - F.lit(float(mean))) / F.lit(float(divisor)))
        return df.withColumn(out, F.lit(1.0) / (F.lit(1.0) + F.exp(-margin)))

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(json.dumps(asdict(self)),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> LinearModel:
        facts = json.loads(spark.read.text(path).first()["value"])
        return LinearModel(**facts | {"scale": {k: tuple(v) for k, v in facts["scale"].items()}})


def fit_logistic(train: DataFrame, spec: FeatureSpec, max_iter: int = 1000) -> LinearModel:
    n = train.count()
    lr = LogisticRegression(
        featuresCol="_features", labelCol="_label", regParam=1.0 / max(n, 1), elasticNetParam=0.0,
        standardization=False, maxIter=max_iter,
    )
    scale, names = fit_scaler(train, spec.scaled) if spec.scaled else {}, spec.pipeline_order()
    data = apply_scaler(train.withColumn("_label", F.col(spec.label).cast("double")), scale)
    fitted = lr.fit(ensure_parallelism(VectorAssembler(inputCols=names, outputCol="_features").transform(data)))
    return LinearModel(names, [float(c) for c in fitted.coefficients], float(fitted.intercept), scale)


def fit_boosted_trees(
    train: DataFrame, spec: FeatureSpec, weight_col: str | None = None, max_iter: int = 200, max_depth: int = 4, step_size: float = 0.1
) -> TreeEnsemble:
    return fit_trees(train, spec.pipeline_order(), spec.label, weight_col, max_iter, max_depth, step_size)


def train_strategy(strategy: str, train: DataFrame, spec: FeatureSpec, max_iter: int = 200, smote_k: int = 5, seed: int = 0) -> TreeEnsemble:
    """'none' | 'class_weight' | 'smote' (resampling only ever touches ``train``)."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy: {strategy}")
    if strategy == "class_weight":
        return fit_boosted_trees(class_weight(train, spec.label, "_w"), spec, "_w", max_iter=max_iter)
    if strategy == "smote":
        from costlens.operators.smote import smote

        # neighbours in standardised space, scaler statistics from the original training rows only
        params = fit_scaler(train, spec.scaled) if spec.scaled else {}
        aug = smote(train, list(spec.pipeline_order()), spec.label, list(spec.id_cols), k=smote_k, seed=seed, scale=params)
        return fit_boosted_trees(aug, spec, max_iter=max_iter)
    return fit_boosted_trees(train, spec, max_iter=max_iter)


def train_together(spark: SparkSession, makes: Sequence[Callable[[], TreeEnsemble]]) -> list[TreeEnsemble]:
    """The models of ``makes``, trained at the same time: a level of a tree is a short job that leaves cores idle while the
    driver chooses splits, which the jobs of the other models fill."""
    checkpoint_dir(spark)  # set and shipped once, not by every thread
    ship_package(spark)
    with ThreadPoolExecutor(max(1, len(makes))) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(make)) for make in makes]]


def score(model: LinearModel | TreeEnsemble, df: DataFrame, out: str = "score") -> DataFrame:
    """Adds the positive-class probability as a double column."""
    return model.score(df, out)


def strategy_rows(scored: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """pr_auc, roc_auc, f1_at_0.5 of every named frame of (label, score)."""
    out = None
    for name, frame in scored:
        row = evaluate_basic(frame).select(F.lit(name).alias("strategy"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def strategy_metrics(
    train: DataFrame, test: DataFrame, spec: FeatureSpec, strategies=STRATEGIES, max_iter: int = 200, trainer=None
) -> DataFrame:
    """The strategies' models compared on the test part, which each model scores once.
    ``trainer(strategy)`` may return a model that is already trained."""
    train_one = trainer or (lambda s: train_strategy(s, train, spec, max_iter=max_iter))
    fitted = train_together(train.sparkSession, [lambda s=s: train_one(s) for s in strategies])
    scored = lambda m: materialize(score(m, test).select(F.col(spec.label).alias("label"), "score"))
    return strategy_rows([(s, scored(m)) for s, m in zip(strategies, fitted)])


def select_threshold(scored: DataFrame, cost_fn: float = DEFAULT_COST_FN, cost_fp: float = DEFAULT_COST_FP) -> float:
    return float(optimize_threshold(threshold_cost_curve(scored, cost_fn, cost_fp)).first()["optimal_threshold"])


def save_production(
    model: TreeEnsemble, select: DataFrame, spec: FeatureSpec, path: str, cost_fn: float = DEFAULT_COST_FN, cost_fp: float = DEFAULT_COST_FP
) -> dict:
    """Threshold by the cost engine on ``select``; model and metadata saved under ``path`` (overwrite, so retries are safe)."""
    t = select_threshold(score(model, select).select(F.col(spec.label).alias("label"), "score"), cost_fn, cost_fp)
    spark = select.sparkSession
    model.save(spark, f"{path}/model")
    meta = {"feature_columns": list(spec.features), "optimal_threshold": t, "cost_fn": cost_fn, "cost_fp": cost_fp}
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")
    return meta


def train_production(
    fit: DataFrame,
    select: DataFrame,
    spec: FeatureSpec,
    path: str,
    cost_fn: float = DEFAULT_COST_FN,
    cost_fp: float = DEFAULT_COST_FP,
    max_iter: int = 200,
) -> dict:
    """Weighted trees on ``fit``, saved with their threshold."""
    return save_production(train_strategy("class_weight", fit, spec, max_iter=max_iter), select, spec, path, cost_fn, cost_fp)


def load_production(spark: SparkSession, path: str) -> tuple[TreeEnsemble, dict]:
    return TreeEnsemble.load(spark, f"{path}/model"), json.loads(spark.read.text(f"{path}/metadata").first()["value"])


def flagged(model: LinearModel | TreeEnsemble, meta: dict, df: DataFrame) -> DataFrame:
    """``df`` with fraud_probability, is_fraud (probability >= threshold, inclusive), threshold."""
    t = F.lit(float(meta["optimal_threshold"]))
    return score(model, df, "fraud_probability").withColumn("is_fraud", F.col("fraud_probability") >= t).withColumn("threshold", t)


def score_batch(model: LinearModel | TreeEnsemble, meta: dict, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """``keep``, fraud_probability, is_fraud, threshold of every row."""
    rows = df.select(*keep, *[c for c in meta["feature_columns"] if c not in keep])
    return flagged(model, meta, rows).select(*keep, "fraud_probability", "is_fraud", "threshold")


def ablation_rows(configurations: Sequence[tuple[str, DataFrame, float | Callable[[DataFrame], float]]], cost_fn: float, cost_fp: float) -> DataFrame:
    """(configuration, pr_auc, expected_cost) of named frames of (label, score), each at its threshold or at the one that a
    function chooses from the frame."""
    out = None
    for name, frame, threshold in configurations:
        t = threshold(frame) if callable(threshold) else threshold
        row = attach_one_row(rank_metrics(frame).select("pr_auc"), expected_cost(frame, t, cost_fn, cost_fp).select("expected_cost"))
        row = row.select(F.lit(name).alias("configuration"), "pr_auc", "expected_cost")
        out = row if out is None else out.unionByName(row)
    return out


ABLATION = ("plain, 0.5", "weighted, 0.5", "weighted, best threshold", "weighted, isotonic, best threshold")


def ablation_table(
    train: DataFrame, test: DataFrame, spec: FeatureSpec, order_col: str, tie_cols: Sequence[str] = (), max_iter: int = 200,
    cost_fn: float = DEFAULT_COST_FN, cost_fp: float = DEFAULT_COST_FP, trainer=None,
) -> DataFrame:
    """none@0.5 -> weighted@0.5 -> weighted@optimum -> weighted + isotonic@optimum."""
    from costlens.operators.calibration import apply_isotonic, fit_isotonic
    from costlens.operators.split import chronological_split

    def scored_by(m, frame):
        return materialize(score(m, frame).select(F.col(spec.label).alias("label"), "score"))

    whole = trainer or (lambda s: train_strategy(s, train, spec, max_iter=max_iter))
    parts = chronological_split(train, order_col, tie_cols, 0.15, labels=("fit", "calib"))
    fit, calib = parts.where(F.col("part") == "fit").drop("part"), parts.where(F.col("part") == "calib").drop("part")
    on_part = lambda: train_strategy("class_weight", fit, spec, max_iter=max_iter)
    makes = [lambda: whole("none"), lambda: whole("class_weight"), on_part]
    on_whole, on_weighted, on_fit = train_together(train.sparkSession, makes)
    plain, weighted = scored_by(on_whole, test), scored_by(on_weighted, test)
    iso = fit_isotonic(scored_by(on_fit, calib))
    isotonic = apply_isotonic(scored_by(on_fit, test), iso).select("label", F.col("isotonic_score").alias("score"))
    best = lambda frame: select_threshold(frame, cost_fn, cost_fp)
    frames = ((plain, 0.5), (weighted, 0.5), (weighted, best), (isotonic, best))
    return ablation_rows([(name, *f) for name, f in zip(ABLATION, frames)], cost_fn, cost_fp)
