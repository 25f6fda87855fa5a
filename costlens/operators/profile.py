"""Profiling of a labelled table.

Every operator is one or two aggregations with map-side partial combine;
percentiles are exact via distributed prefix sums (``ordered.exact_percentiles``)
rather than a one-task percentile buffer, with ``approx=True`` for the
``percentile_approx`` sketch when exactness is not needed.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costlens.functions import round6
from costlens.operators.frames import attach_one_row, join_small
from costlens.operators.ordered import exact_percentiles


def class_balance(df: DataFrame, label: str = "label") -> DataFrame:
    """n_negative, n_positive and the imbalance ratio n0 / n1 (null without positives)."""
    agg = df.agg(
        F.count(F.when(F.col(label) == 0, 1)).alias("n_negative"),
        F.count(F.when(F.col(label) == 1, 1)).alias("n_positive"),
    )
    return agg.withColumn("imbalance_ratio", F.try_divide(F.col("n_negative").cast("double"), F.col("n_positive")))


def long_features(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Wide -> long (keep..., feature, value) with ``unpivot``."""
    return df.select(*keep, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        list(keep), list(cols), "feature", "value"
    )


def array_features(df: DataFrame, array_col: str, keep: Sequence[str] = (), prefix: str = "f") -> DataFrame:
    """Array column -> long (keep..., feature, value); feature names f0, f1, ..."""
    return df.select(*keep, F.posexplode(array_col).alias("_i", "value")).select(
        *keep, F.concat(F.lit(prefix), F.col("_i").cast("string")).alias("feature"), F.col("value").cast("double")
    )


def mean_shift_by_class(long_df: DataFrame, label: str = "label", top: int = 10) -> DataFrame:
    """Per feature: class means and |mean0 - mean1|, the ``top`` largest shifts."""
    agg = long_df.groupBy("feature").agg(
        F.avg(F.when(F.col(label) == 0, F.col("value"))).alias("mean_0"),
        F.avg(F.when(F.col(label) == 1, F.col("value"))).alias("mean_1"),
    )
    out = agg.select(
        "feature",
        round6("mean_0").alias("mean_0"),
        round6("mean_1").alias("mean_1"),
        round6(F.abs(F.col("mean_0") - F.col("mean_1"))).alias("abs_diff"),
    )
    return out.orderBy(F.col("abs_diff").desc(), "feature").limit(top)


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of every column pair in ONE aggregation (co-moments
    combine map-side), returned long as (a, b, corr) with a < b in column order.  A pair is taken over the rows where
    neither column is null; with fewer than two such rows, or a constant column, the correlation is null or NaN."""
    pairs = list(combinations(cols, 2))
    agg = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    stack = ", ".join(f"'{a}', '{b}', `{i}`" for i, (a, b) in enumerate(pairs))
    return agg.selectExpr(f"stack({len(pairs)}, {stack}) AS (a, b, corr)").select("a", "b", round6("corr").alias("corr"))


def box_stats(df: DataFrame, value: str, by: Sequence[str] = ("label",), approx: bool = False) -> DataFrame:
    """Quartiles (linear), whiskers = extreme data within 1.5 IQR, outlier count."""
    by = list(by)
    if approx:
        q = df.groupBy(*by).agg(F.percentile_approx(value, [0.25, 0.5, 0.75], 10000).alias("_q")).select(
            *by, F.col("_q")[0].cast("double").alias("q1"), F.col("_q")[1].cast("double").alias("median"),
            F.col("_q")[2].cast("double").alias("q3"),
        )
    else:
        p = exact_percentiles(df, value, [0.25, 0.5, 0.75], by=by)
        q = p.groupBy(*by).agg(
            F.max(F.when(F.col("q") == 0.25, F.col("value"))).alias("q1"),
            F.max(F.when(F.col("q") == 0.5, F.col("value"))).alias("median"),
            F.max(F.when(F.col("q") == 0.75, F.col("value"))).alias("q3"),
        )
    iqr = F.col("q3") - F.col("q1")
    lo, hi = F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr
    v = df.select(*by, F.col(value).cast("double").alias("_v"))
    j = join_small(v, q, by) if by else attach_one_row(v, q)
    out = j.groupBy(*by, "q1", "median", "q3").agg(
        F.min(F.when(F.col("_v") >= lo, F.col("_v"))).alias("whisker_low"),
        F.max(F.when(F.col("_v") <= hi, F.col("_v"))).alias("whisker_high"),
        F.count(F.when((F.col("_v") < lo) | (F.col("_v") > hi), 1)).alias("n_outliers"),
    )
    return out.select(*by, round6("q1").alias("q1"), round6("median").alias("median"), round6("q3").alias("q3"),
                      "whisker_low", "whisker_high", "n_outliers")


def density_histogram(df: DataFrame, value: str, bins: int = 48, label: str = "label") -> DataFrame:
    """Equal-width bins over the pooled range; per-class density count / (n_class * width);
    the last bin is closed; empty bins are present with density 0.  Rows whose value is null, NaN or infinite are in no
    bin, nor in their class's size; rows without a label form a class of their own."""
    v = F.col(value).cast("double")
    df = df.filter(F.abs(v) < F.lit(float("inf")))  # NaN is greater than any number
    rng = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi")).first()
    if rng["lo"] is None:  # no data: no bins
        return df.sparkSession.createDataFrame(
            [], f"{label} {df.schema[label].dataType.simpleString()}, bin int, bin_lo double, count long, density double"
        )
    lo, hi = float(rng["lo"]), float(rng["hi"])
    width = (hi - lo) / bins if hi > lo else 1.0
    b = F.least(F.floor((v - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counts = df.groupBy(F.col(label).alias(label), b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    per_class = counts.groupBy(label).agg(F.sum("count").alias("_nc"))
    grid = per_class.select(label, "_nc", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    own = counts.select(F.col(label).alias("_label"), F.col("bin").alias("_bin"), "count")
    same = grid[label].eqNullSafe(own["_label"]) & (grid["bin"] == own["_bin"])
    full = grid.join(own, same, "left").drop("_label", "_bin").fillna(0, ["count"])
    return full.select(
        label,
        "bin",
        (F.lit(lo) + F.col("bin") * F.lit(width)).alias("bin_lo"),
        "count",
        (F.col("count") / (F.col("_nc") * F.lit(width))).alias("density"),
    )


def percentile_report(df: DataFrame, value: str, pcts: Sequence[float] = (50, 95), approx: bool = False) -> DataFrame:
    """count and linear percentiles; empty input gives (0, null, ...)."""
    names = [f"p{int(p) if float(p).is_integer() else p}" for p in pcts]
    cnt = df.agg(F.count(F.col(value)).alias("count"))
    qs = [float(p) / 100.0 for p in pcts]
    if approx:
        a = df.agg(F.percentile_approx(value, qs, 10000).alias("_q"))
        vals = a.select(*[F.col("_q")[i].cast("double").alias(n) for i, n in enumerate(names)])
    else:
        p = exact_percentiles(df.where(F.col(value).isNotNull()), value, qs)
        vals = p.agg(*[F.max(F.when(F.col("q") == q, F.col("value"))).alias(n) for q, n in zip(qs, names)])
    vals = vals.select(*[round6(n).alias(n) for n in names])
    return attach_one_row(cnt, vals)


def clipped_histogram(df: DataFrame, value: str, bins: int = 50, clip_pct: float = 99.5) -> DataFrame:
    """Equal bins on [0, p{clip_pct}]; values above the cap are left out of the
    bins (they still count in any percentile)."""
    from costlens.operators.ordered import percentile_values

    cap = percentile_values(df, value, [clip_pct / 100.0])[0]
    if cap is None or cap <= 0:  # no data (or nothing above 0): no bins
        return df.sparkSession.createDataFrame([], "bin int, n long")
    v = F.col(value).cast("double")
    inside = df.where((v >= 0) & (v <= F.lit(cap)))
    b = F.least(F.floor(v * F.lit(bins / cap)), F.lit(bins - 1)).cast("int")
    return inside.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def mean_abs_by_feature(long_contrib: DataFrame, value: str = "contribution", top: int | None = 10) -> DataFrame:
    """Mean |contribution| per feature, descending (feature importance)."""
    out = long_contrib.groupBy("feature").agg(round6(F.avg(F.abs(F.col(value)))).alias("mean_abs"))
    out = out.orderBy(F.col("mean_abs").desc(), "feature")
    return out.limit(top) if top else out
