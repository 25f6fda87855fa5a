"""Sampling and resampling.

All randomness is a portable hash of (seed, row id), so a sample does not
depend on partitioning or retries and an SQL engine can reproduce it.
"Exactly m rows without replacement" = the m smallest (hash, id) tuples, found
by exact distributed selection (:func:`mark_first`) and applied as a filter; no
row is ever collected and no group is sorted in one task.  The selection counts
the upper half of the hash first (65,536 groups), then refines inside one of them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costlens.functions import count_le, portable_hash
from costlens.operators.ordered import mark_first


def smallest_by_hash(
    df: DataFrame, m: int, id_cols: Sequence[str], seed: int = 0, hash_cols: Sequence[str] | None = None,
    n: int | None = None,
) -> DataFrame:
    """Exactly ``min(m, n)`` rows: those with the smallest portable hash of
    ``hash_cols`` (default: the id columns), ties broken by the id columns.
    ``n`` (the row count of ``df``) saves a pass when the caller knows it."""
    if m <= 0:
        return df.limit(0)
    h = df.withColumn("_h", portable_hash(seed, *(hash_cols or id_cols)))
    n = h.count() if n is None else n
    if m >= n:
        return df
    h = h.withColumn("_hi", F.shiftright("_h", 16))
    return mark_first(h, ["_hi", "_h", *id_cols], m, "_in").filter("_in").drop("_h", "_hi", "_in")


def _class_counts(df: DataFrame, label: str) -> tuple[int, int]:
    r = df.agg(F.sum(F.col(label).cast("long")).alias("p"), F.count(F.col(label)).alias("n")).first()
    p = int(r["p"] or 0)  # rows without a label belong to neither class
    return p, int(r["n"]) - p


def undersample_majority(
    df: DataFrame, id_cols: Sequence[str], label: str = "label", ratio: int = 20, seed: int = 0,
    hash_cols: Sequence[str] | None = None,
) -> DataFrame:
    """All positives + min(ratio * n_pos, n_neg) negatives without replacement; rows without a label are left out."""
    n_pos, n_neg = _class_counts(df, label)
    m = min(ratio * n_pos, n_neg)
    pos = df.filter(F.col(label) == 1)
    neg = smallest_by_hash(df.filter(F.col(label) != 1), m, id_cols, seed, hash_cols, n=n_neg)
    return pos.unionByName(neg)


def capped_sample(df: DataFrame, id_cols: Sequence[str], label: str = "label", cap: int = 2000, seed: int = 0) -> DataFrame:
    """All positives + min(cap - n_pos, n_neg) negatives (clamped at 0); rows without a label are left out."""
    n_pos, n_neg = _class_counts(df, label)
    m = max(0, min(cap - n_pos, n_neg))
    pos = df.filter(F.col(label) == 1)
    neg = smallest_by_hash(df.filter(F.col(label) != 1), m, id_cols, seed, n=n_neg)
    return pos.unionByName(neg)


def replay_sample(df: DataFrame, n: int, id_cols: Sequence[str], seed: int = 0) -> DataFrame:
    """min(n, len) rows without replacement."""
    return smallest_by_hash(df, n, id_cols, seed)


def head_n(df: DataFrame, n: int, order_cols: Sequence[str]) -> DataFrame:
    """First n rows in time order (a top-k: n rows per task, then merged)."""
    return df.orderBy(*order_cols).limit(int(n))


def class_weight(df: DataFrame, label: str = "label", weight_col: str = "weight") -> DataFrame:
    """Positives weigh n_neg / n_pos of this frame, negatives 1."""
    n_pos, n_neg = _class_counts(df, label)
    if n_pos == 0:
        raise ZeroDivisionError("class_weight needs at least one positive row")
    return df.withColumn(weight_col, F.when(F.col(label) == 1, F.lit(n_neg / n_pos)).otherwise(F.lit(1.0)))


# ---------------------------------------------------------------- bootstrap --

def bootstrap_draws(spark, n: int, replicates: int, seed: int = 0) -> DataFrame:
    """Exact index bootstrap: (replicate, idx, n_draws) for B x n uniform draws
    with replacement, idx = hash(seed, replicate, draw) mod n."""
    total = replicates * n
    d = spark.range(0, total).select(
        F.expr(f"id div {int(n)}").alias("replicate"), (F.col("id") % F.lit(n)).alias("draw")
    )
    d = d.select("replicate", (portable_hash(seed, "replicate", "draw") % F.lit(n)).alias("idx"))
    return d.groupBy("replicate", "idx").agg(F.count(F.lit(1)).alias("n_draws"))


# Poisson(1) cumulative probabilities P(X <= k), k = 0..15 (weights above 16
# have probability < 1e-14).
POISSON1_CDF = [math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1)) for k in range(16)]


def poisson_weights(df: DataFrame, replicates: int, id_col: str, seed: int = 0) -> DataFrame:
    """Scale variant: each row gets a Poisson(1) weight per replicate by inverse
    CDF of a hash draw — no join, no shuffle; ``explode`` multiplies rows by B
    inside the task and aggregations combine map-side."""
    from costlens.operators.frames import ensure_parallelism

    # the per-row work is multiplied by B: spread a few-partition input first
    r = ensure_parallelism(df).select("*", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    u = portable_hash(seed, "replicate", id_col) / F.lit(4294967296.0)
    return r.withColumn("weight", count_le(u, POISSON1_CDF).cast("long"))
