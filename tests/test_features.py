import numpy as np
from pyspark.sql import functions as F

from costlens.operators import features, sampling

COLS = [f"V{i}" for i in range(1, 29)] + ["Amount", "Time"]


def _table(spark, n):
    """The schema's columns (fixed names) with uneven values; V3 is constant."""
    value = lambda c, j: 7.5 if c == 2 else ((c + 2) * (j * j % 17) - c) / 4
    rows = [tuple(value(c, j) for c in range(28)) + (3.0 + j % 9 * 1.25, 60.0 * j + j % 4) for j in range(n)]
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in COLS))


def test_pipeline_order():
    spec = features.FeatureSpec(features=tuple(COLS), scaled=("Amount", "Time"))
    order = spec.pipeline_order()
    assert order[:2] == ["Amount", "Time"] and order[2:] == [f"V{i}" for i in range(1, 29)] and len(order) == 30


def test_population_standardisation(spark):
    df = _table(spark, 43)
    out = features.standard_scale(df, ["Amount", "Time"], suffix="_z").toPandas()
    for c in ("Amount_z", "Time_z"):
        assert abs(out[c].mean()) < 1e-9
        assert abs(out[c].to_numpy().std() - 1.0) < 1e-6  # numpy std = population


def test_constant_column_divisor_one(spark):
    df = _table(spark, 12)
    p = features.fit_scaler(df, ["V3"])
    assert p["V3"] == (7.5, 1.0)


def test_validate_contract_reasons(spark):
    df = spark.createDataFrame([(1, "1.5", 2.0), (2, "x", None), (3, None, float("nan"))], "id int, a string, b double")
    out = {r["id"]: (r["is_valid"], list(r["reasons"])) for r in features.validate_contract(df, ["a", "b"], ["id"]).collect()}
    assert out == {1: (True, []), 2: (False, ["a", "b"]), 3: (False, ["a", "b"])}
    assert features.valid_rows(features.validate_contract(df, ["a", "b"], ["id"])).count() == 1


def test_class_weight(spark):
    df = spark.createDataFrame([(1,), (0,), (0,), (0,)], "label int")
    w = sorted(r["weight"] for r in sampling.class_weight(df).collect())
    assert w == [1.0, 1.0, 1.0, 3.0]


def test_samples_are_exact_and_deterministic(spark):
    df = spark.range(1000).select(F.col("id").alias("event_id"), (F.col("id") % 10 == 0).cast("int").alias("label"))
    a = sampling.undersample_majority(df, ["event_id"], ratio=2)
    assert a.where("label = 1").count() == 100 and a.where("label = 0").count() == 200
    b = sampling.undersample_majority(df.repartition(7), ["event_id"], ratio=2)
    assert sorted(r[0] for r in a.select("event_id").collect()) == sorted(r[0] for r in b.select("event_id").collect())
    c = sampling.capped_sample(df, ["event_id"], cap=150)
    assert c.count() == 150
    assert sampling.replay_sample(df, 2000, ["event_id"]).count() == 1000


def test_poisson_weights_moments(spark):
    df = spark.range(20000).withColumnRenamed("id", "rid")
    w = np.array([r[0] for r in sampling.poisson_weights(df, 1, "rid").select("weight").collect()])
    assert abs(w.mean() - 1) < 0.03 and abs(w.var() - 1) < 0.05
