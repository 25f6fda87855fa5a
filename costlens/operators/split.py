"""Leakage-safe chronological splits.

The first ``int(n * (1 - test_size))`` rows in time order are train, the rest
test.  Ties on the time column are broken by ``tie_cols`` (the reference's
sort leaves tie order undefined; a total order makes the split reproducible).

Rows that tie there as well are ordered by their whole content, and of equal
rows any may fall on either side, so a table without a unique key splits exactly too.

No global row number: :func:`mark_first` finds the exact boundary tuple by
distributed selection, then every row is labelled by a lexicographic compare
against literals, a narrow (shuffle-free) projection.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costlens.operators.ordered import mark_first


def chronological_split(
    df: DataFrame,
    order_col: str,
    tie_cols: Sequence[str] = (),
    test_size: float = 0.2,
    *,
    part_col: str = "part",
    labels: tuple[str, str] = ("train", "test"),
    n_buckets: int | None = None,
) -> DataFrame:
    n = df.count()
    k = int(n * (1 - test_size))  # truncation of the double product, as the reference does
    cols = [order_col, *tie_cols]
    if k >= n:
        return df.withColumn(part_col, F.lit(labels[0]))
    marked = mark_first(df, cols, k, "_first", n_buckets)
    return marked.withColumn(part_col, F.when(F.col("_first"), F.lit(labels[0])).otherwise(F.lit(labels[1]))).drop("_first")


def three_way_split(
    df: DataFrame,
    order_col: str,
    tie_cols: Sequence[str] = (),
    test_size: float = 0.2,
    calib_size: float = 0.15,
    *,
    part_col: str = "part",
    n_buckets: int | None = None,
) -> DataFrame:
    """fit / calib / test: the calibration slice is the last ``calib_size`` of train."""
    cols = [order_col, *tie_cols]
    n = df.count()
    k_train = int(n * (1 - test_size))
    k_fit = int(k_train * (1 - calib_size))
    marked = mark_first(df, cols, k_train, "_train", n_buckets) if k_train < n else df.withColumn("_train", F.lit(True))
    train = mark_first(marked.filter("_train"), cols, k_fit, "_fit", n_buckets)
    train = train.withColumn(part_col, F.when(F.col("_fit"), F.lit("fit")).otherwise(F.lit("calib"))).drop("_fit")
    return train.unionByName(marked.filter("not _train").withColumn(part_col, F.lit("test"))).drop("_train")


def split_summary(df: DataFrame, part_col: str = "part", label: str = "label") -> DataFrame:
    return df.groupBy(part_col).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.col(label).cast("long")).alias("n_positive")
    )
