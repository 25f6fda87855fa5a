import numpy as np

from costlens.operators import anomaly


def _matrix(spark, n, shift, phase):
    """Ten columns that follow three hidden waves; ``shift`` moves every other column off that surface."""
    t = np.arange(n) + 0.5 + phase
    waves = np.stack([np.sin(t * 0.7), np.cos(t * 1.9), np.sin(t * 2.3 + 1)], axis=1)
    x = waves @ np.cos(np.arange(30).reshape(3, 10)) + 0.1 * np.sin(t[:, None] * (np.arange(10) + 5))
    x = x + shift * (np.arange(10) % 2)
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "rid long, features array<double>")


def test_pca_errors(spark):
    train = _matrix(spark, 400, 0.0, 0)
    normal, shifted = _matrix(spark, 60, 0.0, 1000), _matrix(spark, 60, 5.0, 2000)
    mean, basis = anomaly.fit_pca(train, "features", k=3)
    e_n = [r["error"] for r in anomaly.pca_error(normal, "features", mean, basis).collect()]
    e_s = [r["error"] for r in anomaly.pca_error(shifted, "features", mean, basis).collect()]
    assert min(e_n + e_s) >= 0
    assert np.mean(e_s) > np.mean(e_n)


def test_autoencoder_errors(spark):
    train = _matrix(spark, 240, 0.0, 0).repartition(3)
    normal, shifted = _matrix(spark, 60, 0.0, 1000), _matrix(spark, 60, 5.0, 2000)
    theta = anomaly.fit_autoencoder(train, "features", epochs=12)
    assert theta.shape == (10 * 20 + 20 + 20 * 8 + 8 + 8 * 20 + 20 + 20 * 10 + 10,)
    e_n = [r["error"] for r in anomaly.autoencoder_error(normal, "features", theta).collect()]
    e_s = [r["error"] for r in anomaly.autoencoder_error(shifted, "features", theta).collect()]
    assert len(e_n) == 60 and min(e_n + e_s) >= 0
    assert np.mean(e_s) > np.mean(e_n)


def test_gradient_matches_finite_difference():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(7, 5))
    th = anomaly.init_params(5, 0)
    g = anomaly._grad(th, x, 20, 8)

    def loss(t):
        r = anomaly.reconstruct(t, x) - x
        return np.mean(r * r)

    for i in rng.choice(len(th), 12, replace=False):
        e = np.zeros_like(th)
        e[i] = 1e-6
        fd = (loss(th + e) - loss(th - e)) / 2e-6
        assert abs(fd - g[i]) < 1e-6


def test_error_by_class(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 3.0), (1, 10.0)], "label int, error double")
    rows = {r["label"]: r for r in anomaly.error_by_class(df).collect()}
    assert rows[0]["mean_error"] == 2.0 and rows[1]["ratio_pos_to_neg"] == 5.0


def test_autoencoder_does_not_depend_on_the_layout(spark):
    rows = [(i, [float(np.sin(i * (j + 1))) for j in range(6)]) for i in range(500)]
    df = spark.createDataFrame(rows, "rid long, features array<double>")
    one = anomaly.fit_autoencoder(df.repartition(1), "features", epochs=2, steps=3)
    for n in (3, 8):
        other = anomaly.fit_autoencoder(df.repartition(n, "rid"), "features", epochs=2, steps=3)
        assert np.abs(one - other).max() < 1e-9


def test_array_scaler(spark):
    df = _matrix(spark, 90, 2.0, 5)
    mean, spread = anomaly.fit_array_scaler(df, "features")
    x = np.array([r["features"] for r in df.collect()])
    assert np.allclose(mean, x.mean(axis=0)) and np.allclose(spread, x.std(axis=0))
    z = np.array([r["features"] for r in anomaly.scale_array(df, "features", mean, spread).collect()])
    assert np.allclose(z.mean(axis=0), 0) and np.allclose(z.std(axis=0), 1)


def test_minibatches_of_a_given_size_and_nothing_to_learn(spark):
    import pytest

    rows = [(i, [float(np.sin(i * (j + 1))) for j in range(6)]) for i in range(200)]
    df = spark.createDataFrame(rows, "rid long, features array<double>")
    assert np.array_equal(
        anomaly.fit_autoencoder(df.coalesce(1), "features", epochs=2, batch_size=64), anomaly.fit_autoencoder(df.coalesce(1), "features", epochs=2, steps=4)
    )
    turns = [anomaly._turns(np.arange(10_000), e, 5) for e in (0, 1)]
    assert all(np.bincount(t, minlength=5).min() > 1800 for t in turns) and (turns[0] != turns[1]).any()
    with pytest.raises(ValueError):
        anomaly.fit_autoencoder(df.limit(0), "features")
