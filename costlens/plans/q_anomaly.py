"""Registered anomaly and attribution queries (T4, G7, T7, G11) — rows-only.

Anomaly detectors run on the embeddings matrix (64 features; label = class 0
as the rare positive), trained on the negatives of the first 80 % by vec_id
and scored on the rest.  Attribution explains the class-weighted boosted trees
of the transaction model on every row of its test part.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from costlens.operators import anomaly, explain, profile
from costlens.operators.split import chronological_split
from costlens.plans.q_models import parts, strategy_model
from costlens.plans.q_split import KEYS
from costlens.plans.registry import register
from costlens.plans.views import matrix

AE_EPOCHS = 20


def _matrix_parts(spark, sf):
    m = chronological_split(matrix(spark, sf), "vec_id", (), 0.2)
    train = m.where(F.col("part") == "train").drop("part")
    test = m.where(F.col("part") == "test").drop("part")
    neg = train.where(F.col("label") == 0)
    scale = anomaly.fit_array_scaler(neg, "features")
    return anomaly.scale_array(neg, "features", *scale), anomaly.scale_array(test, "features", *scale)


def _pca_scored(spark, sf):
    neg, test = _matrix_parts(spark, sf)
    mean, basis = anomaly.fit_pca(neg, "features", k=8)
    return anomaly.pca_error(test, "features", mean, basis)


@register("pca_anomaly")
def q_pca_anomaly(spark, sf):
    return _pca_scored(spark, sf).select("vec_id", "label", F.round("error", 6).alias("error"))


@register("relu_autoencoder")
def q_relu_autoencoder(spark, sf):
    neg, test = _matrix_parts(spark, sf)
    theta = anomaly.fit_autoencoder(neg, "features", epochs=AE_EPOCHS)
    return anomaly.autoencoder_error(test, "features", theta).select("vec_id", "label", F.round("error", 6).alias("error"))


@register("error_by_class")
def q_error_by_class(spark, sf):
    return anomaly.error_by_class(_pca_scored(spark, sf))


def _shap(spark, sf):
    train, test = parts(spark, sf)
    model = strategy_model(spark, sf, "class_weight", train)
    return explain.tree_shap(model, test, KEYS)


@register("tree_shap")
def q_tree_shap(spark, sf):
    long, _ = _shap(spark, sf)
    return long


@register("shap_importance")
def q_shap_importance(spark, sf):
    long, _ = _shap(spark, sf)
    return profile.mean_abs_by_feature(long, "contribution", top=10)


@register("anomaly_metrics")
def q_anomaly_metrics(spark, sf):
    """Reconstruction error as the score: pr_auc, roc_auc and mean error per class,
    for the linear (PCA) and the ReLU autoencoder detectors."""
    from costlens.operators.metrics import rank_metrics

    neg, test = _matrix_parts(spark, sf)
    mean, basis = anomaly.fit_pca(neg, "features", k=8)
    theta = anomaly.fit_autoencoder(neg, "features", epochs=AE_EPOCHS)
    out = None
    for name, scored in (
        ("pca", anomaly.pca_error(test, "features", mean, basis)),
        ("relu_autoencoder", anomaly.autoencoder_error(test, "features", theta)),
    ):
        s = scored.select("label", F.col("error").alias("score"))
        means = s.agg(
            F.round(F.avg(F.when(F.col("label") == 1, F.col("score"))), 6).alias("mean_error_pos"),
            F.round(F.avg(F.when(F.col("label") == 0, F.col("score"))), 6).alias("mean_error_neg"),
        )
        from costlens.operators.frames import attach_one_row

        row = attach_one_row(rank_metrics(s), means).select(F.lit(name).alias("detector"), "*")
        out = row if out is None else out.unionByName(row)
    return out
