"""Registered queries of fitted models (T1-T3, T5, T6, K8) — rows-only checks; ``q_given`` checks the same operators on given numbers.

The transaction contract on the scored lineitem view: Amount = l_extendedprice
and Time = time_us are standardised (fitted on the training part only), the
other features pass through.  Training part = first 80 % in time order.

Boosted trees run with 200 rounds.  Queries that need the same trained model of
one table share it within a Spark application; every row of every table is used.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from costlens.operators import models
from costlens.operators.features import FeatureSpec
from costlens.plans.q_split import _RN_SQL, _SPLIT2_SQL, KEYS, KEYS_SQL, ORDER, split2
from costlens.plans.registry import register
from costlens.functions import portable_hash_sql
from costlens.plans.views import SCORED_SQL, with_sql
from costlens.session import scratch_path

SPEC = FeatureSpec(
    features=("l_quantity", "l_extendedprice", "l_discount", "l_tax", "time_us"),
    scaled=("l_extendedprice", "time_us"),
    label="label",
    order_col="time_us",
    id_cols=tuple(ORDER[1:]),
)
GBT_ROUNDS = 200

_SHARED: dict[tuple, object] = {}


def _files(spark, sf: str) -> tuple:
    """Name, length and time of the files that the view is made of: a table rewritten in place is another one."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf}/lineitem.parquet")
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in system.listStatus(folder)))


def _shared(spark, sf, name, make):
    """``make()`` once per application, files of the table, and name."""
    key = (spark.sparkContext.applicationId, sf, _files(spark, sf), name)
    if key not in _SHARED:
        _SHARED[key] = make()
    return _SHARED[key]


def strategy_model(spark, sf, strategy, train):
    make = lambda: models.train_strategy(strategy, train, SPEC, max_iter=GBT_ROUNDS)
    return _shared(spark, sf, f"strategy {strategy}", make)


def parts(spark, sf):
    s = split2(spark, sf).select(*KEYS, *[c for c in SPEC.features if c not in KEYS], "part")
    return s.where(F.col("part") == "train").drop("part"), s.where(F.col("part") == "test").drop("part")


@register("logistic")
def q_logistic(spark, sf):
    train, test = parts(spark, sf)
    m = models.fit_logistic(train, SPEC)
    return models.score(m, test).select(*KEYS, F.round("score", 6).alias("probability"))


@register("boosted_trees")
def q_boosted_trees(spark, sf):
    train, test = parts(spark, sf)
    m = strategy_model(spark, sf, "none", train)
    return models.score(m, test).select(*KEYS, F.round("score", 6).alias("probability"))


@register("imbalance_strategies")
def q_imbalance_strategies(spark, sf):
    train, test = parts(spark, sf)
    trainer = lambda s: strategy_model(spark, sf, s, train)
    return models.strategy_metrics(train, test, SPEC, models.STRATEGIES, trainer=trainer)


def _production(spark, sf):
    train, test = parts(spark, sf)
    from costlens.operators.split import chronological_split

    p = chronological_split(train, "time_us", ORDER[1:], 0.15, labels=("fit", "calib"))
    fit, calib = p.where(F.col("part") == "fit").drop("part"), p.where(F.col("part") == "calib").drop("part")

    def make():
        path = scratch_path(spark, "production")
        return path, models.train_production(fit, calib, SPEC, path, max_iter=GBT_ROUNDS)

    return *_shared(spark, sf, "production", make), test


@register("production_model")
def q_production_model(spark, sf):
    path, _, _ = _production(spark, sf)
    meta = spark.read.json(f"{path}/metadata")
    return meta.select("optimal_threshold", "cost_fn", "cost_fp", F.size("feature_columns").alias("n_features"))


@register("score_batch")
def q_score_batch(spark, sf):
    path, _, test = _production(spark, sf)
    model, meta = models.load_production(spark, path)
    out = models.score_batch(model, meta, test, keep=KEYS)
    return out.select(*KEYS, F.round("fraud_probability", 6).alias("fraud_probability"), "is_fraud", "threshold")


@register("ablation_table")
def q_ablation_table(spark, sf):
    train, test = parts(spark, sf)
    trainer = lambda s: strategy_model(spark, sf, s, train)
    return models.ablation_table(train, test, SPEC, "time_us", ORDER[1:], max_iter=GBT_ROUNDS, trainer=trainer)


@register(
    "smote",
    with_sql(
        """lab AS (SELECT p_partkey AS id, p_size::DOUBLE AS x_size, floor(p_retailprice)::DOUBLE AS x_price,
                  CASE WHEN p_size <= 5 THEN 1 ELSE 0 END AS label FROM part)""",
        "mi AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS i FROM lab WHERE label = 1)",
        """nn AS (SELECT * FROM (
  SELECT a.id, b.id AS nbr_id, row_number() OVER (PARTITION BY a.id
      ORDER BY (a.x_size - b.x_size) * (a.x_size - b.x_size) + (a.x_price - b.x_price) * (a.x_price - b.x_price), b.id) AS rank
  FROM mi a JOIN mi b ON a.id <> b.id) t WHERE rank <= 5)""",
        """cnt AS (SELECT count(*) FILTER (WHERE label = 1) AS n_min, count(*) FILTER (WHERE label = 0) AS n_maj FROM lab)""",
        f"""syn AS (SELECT s, {portable_hash_sql(0, 's', "'base'")} % n_min AS bi, {portable_hash_sql(0, 's', "'nbr'")} % 5 + 1 AS nr,
                  {portable_hash_sql(0, 's', "'gap'")} / 4294967296.0::DOUBLE AS u
          FROM (SELECT unnest(range(n_maj - n_min)) AS s, n_min FROM cnt) r)""",
        body="""SELECT syn.s AS sample_id, b.x_size + u * (n.x_size - b.x_size) AS x_size,
  b.x_price + u * (n.x_price - b.x_price) AS x_price
FROM syn JOIN mi b ON b.i = syn.bi JOIN nn ON nn.id = b.id AND nn.rank = syn.nr JOIN mi n ON n.id = nn.nbr_id""",
    ),
)
def q_smote(spark, sf):
    from costlens.operators.smote import smote
    from costlens.sources import read_table

    part = read_table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"),
        F.col("p_size").cast("double").alias("x_size"),
        F.floor("p_retailprice").cast("double").alias("x_price"),
        (F.col("p_size") <= 5).cast("int").alias("label"),
    )
    out = smote(part, ["x_size", "x_price"], "label", ["id"], k=5, seed=0, id_col="id")
    return out.where(F.col("_s").isNotNull()).select(F.col("_s").alias("sample_id"), "x_size", "x_price")


@register("baseline_comparison")
def q_baseline_comparison(spark, sf):
    """Logistic regression vs boosted trees: pr_auc, roc_auc, f1_at_0.5 on the test part."""
    from costlens.operators.metrics import evaluate_basic

    train, test = parts(spark, sf)
    out = None
    for name, m in (
        ("logistic", models.fit_logistic(train, SPEC)),
        ("boosted_trees", strategy_model(spark, sf, "none", train)),
    ):
        row = evaluate_basic(models.score(m, test).select("label", "score")).select(F.lit(name).alias("model"), "*")
        out = row if out is None else out.unionByName(row)
    return out


@register(
    "knn_embeddings",
    """SELECT id, nbr_id, dist2, rank FROM (
  SELECT a.vec_id AS id, b.vec_id AS nbr_id,
    list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: power(a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE, 2))) AS d,
    round(d, 6) AS dist2,
    CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY d, b.vec_id) AS INTEGER) AS rank
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id
) t WHERE rank <= 5""",
)
def q_knn_embeddings(spark, sf):
    """C8's neighbour search in 64 dimensions: the five nearest of every embedding."""
    from costlens.operators.smote import knn_exact
    from costlens.plans.views import matrix

    return knn_exact(matrix(spark, sf), "vec_id", "features", k=5).withColumn("dist2", F.round("dist2", 6))
