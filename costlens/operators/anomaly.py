"""Reconstruction-error anomaly detectors (T4) trained on negatives only.

* Linear: MLlib ``PCA(k)`` (distributed covariance), with the mean subtracted
  explicitly (MLlib projects uncentred vectors); error = mean squared residual
  per row, computed in an Arrow-batched pandas UDF with the small (d x k)
  basis captured in the closure.
* ReLU autoencoder d -> 20 -> 8 -> 20 -> d (ReLU after the first three layers), Adam, MSE loss, trained by synchronous
  steps over all partitions; only the model (1.6 k parameters for d = 30, 2.6 k for d = 64) reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costlens.functions import round6
from costlens.operators.frames import ensure_parallelism
from costlens.session import scratch_path, ship_package


# ------------------------------------------------------------------ linear --

def fit_pca(train_neg: DataFrame, features: str, k: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(mean vector, d x k basis) from the negatives of the training part."""
    vec = train_neg.select(array_to_vector(features).alias("_v"))
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(vec)
    basis = model.pc.toArray()
    d = basis.shape[0]
    sums = train_neg.select(F.posexplode(features).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m")).collect()
    mean = np.zeros(d)
    for r in sums:
        mean[r["i"]] = r["m"]
    return mean, basis


def pca_error(df: DataFrame, features: str, mean: np.ndarray, basis: np.ndarray, out: str = "error") -> DataFrame:
    ship_package(df.sparkSession)
    m, p = mean.copy(), basis.copy()

    @F.pandas_udf("double")
    def err(col: pd.Series) -> pd.Series:
        x = np.stack(col.to_numpy()).astype(np.float64) - m
        r = x - (x @ p) @ p.T
        return pd.Series(np.mean(r * r, axis=1))

    return df.withColumn(out, err(F.col(features)))


# ------------------------------------------------------------- autoencoder --

def _layer_shapes(d: int, hidden: int = 20, bottleneck: int = 8) -> list[tuple[int, int]]:
    return [(d, hidden), (hidden, bottleneck), (bottleneck, hidden), (hidden, d)]


def init_params(d: int, seed: int = 0, hidden: int = 20, bottleneck: int = 8) -> np.ndarray:
    """Uniform(-1/sqrt(fan_in), 1/sqrt(fan_in)) weights and biases, flattened."""
    rng = np.random.default_rng(seed)
    parts = []
    for fan_in, fan_out in _layer_shapes(d, hidden, bottleneck):
        b = 1.0 / np.sqrt(fan_in)
        parts += [rng.uniform(-b, b, size=(fan_in, fan_out)).ravel(), rng.uniform(-b, b, size=fan_out)]
    return np.concatenate(parts)


def _unpack(theta: np.ndarray, d: int, hidden: int, bottleneck: int):
    out, i = [], 0
    for fan_in, fan_out in _layer_shapes(d, hidden, bottleneck):
        w = theta[i : i + fan_in * fan_out].reshape(fan_in, fan_out)
        i += fan_in * fan_out
        b = theta[i : i + fan_out]
        i += fan_out
        out.append((w, b))
    return out


def reconstruct(theta: np.ndarray, x: np.ndarray, hidden: int = 20, bottleneck: int = 8) -> np.ndarray:
    layers = _unpack(theta, x.shape[1], hidden, bottleneck)
    h = x
    for j, (w, b) in enumerate(layers):
        h = h @ w + b
        if j < len(layers) - 1:
            h = np.maximum(h, 0.0)
    return h


def _grad(theta: np.ndarray, x: np.ndarray, hidden: int, bottleneck: int) -> np.ndarray:
    layers = _unpack(theta, x.shape[1], hidden, bottleneck)
    acts, pre = [x], []
    h = x
    for j, (w, b) in enumerate(layers):
        z = h @ w + b
        pre.append(z)
        h = np.maximum(z, 0.0) if j < len(layers) - 1 else z
        acts.append(h)
    g = 2.0 * (acts[-1] - x) / x.size  # d mean((y - x)^2) / dy
    grads = []
    for j in range(len(layers) - 1, -1, -1):
        w, _ = layers[j]
        if j < len(layers) - 1:
            g = g * (pre[j] > 0)
        grads.append((acts[j].T @ g, g.sum(axis=0)))
        g = g @ w.T
    grads.reverse()
    return np.concatenate([p for gw, gb in grads for p in (gw.ravel(), gb)])


def _adam(theta, m, v, t, g, lr, b1=0.9, b2=0.999, eps=1e-8):
    m = b1 * m + (1 - b1) * g
    v = b2 * v + (1 - b2) * g * g
    return theta - lr * (m / (1 - b1**t)) / (np.sqrt(v / (1 - b2**t)) + eps), m, v


def fit_array_scaler(df: DataFrame, features: str) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population standard deviation (1 where it is 0) of every place of an array column: one aggregation,
    one row a place to the driver."""
    rows = df.select(F.posexplode(features).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).collect()
    rows.sort(key=lambda r: r["i"])
    spread = np.array([r["s"] for r in rows])
    return np.array([r["m"] for r in rows]), np.where(spread > 0, spread, 1.0)


def scale_array(df: DataFrame, features: str, mean: np.ndarray, spread: np.ndarray) -> DataFrame:
    """The array column standardised place by place."""
    by = F.array(*[F.struct(F.lit(float(m)).alias("m"), F.lit(float(s)).alias("s")) for m, s in zip(mean, spread)])
    return df.withColumn(features, F.zip_with(F.col(features), by, lambda x, p: (x - p["m"]) / p["s"]))


def _to_blocks(features: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(features).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                h = batch.column("_h").to_numpy(zero_copy_only=False).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (x, h)], names=["x", "h"])

    return run


def _turns(h: np.ndarray, epoch: int, steps: int) -> np.ndarray:
    """The step of an epoch that each row falls to: a mix of its hash and the epoch's number."""
    z = h.astype(np.uint64) + np.uint64((epoch + 1) * 0x9E3779B97F4A7C15 % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) % np.uint64(steps)).astype(np.int64)


def fit_autoencoder(
    train_neg: DataFrame,
    features: str,
    epochs: int = 20,
    lr: float = 5e-3,
    steps: int = 6,
    seed: int = 0,
    hidden: int = 20,
    bottleneck: int = 8,
    batch_size: int | None = None,
) -> np.ndarray:
    """Returns the flattened parameter vector.

    Synchronous data-parallel Adam: an epoch has ``steps`` steps (or as many as make ``batch_size`` rows each), and a step
    uses the rows whose hash falls to it in that epoch.  Rows are laid once into blocks of numpy bytes in the shared folder;
    a step is one pass of tasks over the kept blocks, which pick their rows of the step and add up their gradients, Spark
    adds the sums up, and one update follows.  A lost task reads its blocks again.  The result does not depend on how the
    rows are partitioned (to rounding); rows must have arrays of one length without nulls."""
    spark = train_neg.sparkSession
    ship_package(spark)
    path = scratch_path(spark, "autoencoder-blocks")
    rows = ensure_parallelism(train_neg.select(F.col(features).cast("array<double>").alias(features), F.xxhash64(features).alias("_h")))
    rows.mapInArrow(_to_blocks(features), "x binary, h binary").write.parquet(path)
    laid = spark.read.parquet(path).rdd.map(lambda r: (np.frombuffer(r["x"], np.float64), np.frombuffer(r["h"], np.int64)))
    shaped = laid.map(lambda b: (b[0].reshape(len(b[1]), -1), b[1])).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n, d = shaped.map(lambda b: b[0].shape).fold((0, 0), lambda a, b: (a[0] + b[0], max(a[1], b[1])))
        if not n:
            raise ValueError("the autoencoder needs rows to learn from")
        steps = max(1, -(-n // batch_size)) if batch_size else steps
        theta = init_params(d, seed, hidden, bottleneck)
        m, v = np.zeros(len(theta)), np.zeros(len(theta))
        for t in range(epochs * steps):
            epoch, step = divmod(t, steps)

            def part(blocks: Iterator, theta=theta, epoch=epoch, step=step) -> Iterator:
                many, grad = 0, np.zeros(len(theta))
                for x, h in blocks:
                    x = x[_turns(h, epoch, steps) == step]
                    if len(x):
                        grad += _grad(theta, x, hidden, bottleneck) * len(x)
                        many += len(x)
                yield many, grad

            parts, add = shaped.mapPartitions(part), lambda a, b: (a[0] + b[0], a[1] + b[1])
            many, grad = parts.treeReduce(add, 2) if parts.getNumPartitions() > 32 else parts.reduce(add)
            if many:
                theta, m, v = _adam(theta, m, v, t + 1, grad / many, lr)
        return theta
    finally:
        shaped.unpersist()


def autoencoder_error(df: DataFrame, features: str, theta: np.ndarray, out: str = "error", hidden: int = 20, bottleneck: int = 8) -> DataFrame:
    ship_package(df.sparkSession)
    th = theta.copy()

    @F.pandas_udf("double")
    def err(col: pd.Series) -> pd.Series:
        x = np.stack(col.to_numpy()).astype(np.float64)
        r = reconstruct(th, x, hidden, bottleneck) - x
        return pd.Series(np.mean(r * r, axis=1))

    return df.withColumn(out, err(F.col(features)))


def error_by_class(scored: DataFrame, error: str = "error", label: str = "label") -> DataFrame:
    """Mean error per class and the positive / negative ratio."""
    per = scored.groupBy(label).agg(round6(F.avg(error)).alias("mean_error"), F.count(F.lit(1)).alias("n"))
    ratio = scored.agg(
        F.try_divide(F.avg(F.when(F.col(label) == 1, F.col(error))), F.avg(F.when(F.col(label) == 0, F.col(error)))).alias(
            "ratio_pos_to_neg"
        )
    )
    from costlens.operators.frames import attach_one_row

    return attach_one_row(per, ratio.select(round6("ratio_pos_to_neg").alias("ratio_pos_to_neg")))
