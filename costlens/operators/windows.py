"""Trailing time windows (W1): per event, count and amount sum over (t - w, t].

The reference trims members whose time is <= now - w, so an event exactly w
old is out and the event itself is in.  On epoch milliseconds that is the
RANGE frame [t - (w - 1), t]; events in the same millisecond are peers and
count together (the window is taken as of the end of the millisecond).

Two plans with the same answers:

* ``halo``: rows are range-bucketed by time (bucket = floor(ms / B), B >> w) and each row is also copied into the next
  bucket when it lies within w of that bucket's start.  The window then runs per (key, bucket) and only native rows are
  kept.  One shuffle of the rows; a window's rows meet in one task.
* ``prefix``: a window is a difference of running totals, total(t) - total(t - w), so its rows need not meet.  Rows are
  grouped by (key, ms); the distinct times and the times w before them (probes) are laid into range buckets that follow
  the rows' own quantiles, so a burst inside one window is many buckets; totals run inside a bucket, and whole buckets
  between are added from a frame of one row a key and bucket.  The answers, one a (key, ms), are joined to the rows;
  times that more than a thousandth of all rows share are broadcast.

``auto`` takes ``halo`` unless the densest window of a key holds more rows than one task should (``target_rows``), or than
``DENSE``: a moving frame is added up anew for every row, so ``halo`` costs a row as much as its window holds.

Null times are in no window and get null results; null amounts count as rows and add nothing; a window without amounts
has a null sum; NaN and infinite amounts make just the sums of their own windows NaN or infinite."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from costlens.operators.frames import and_, looked_up, materialize
from costlens.operators.ordered import bucketize, range_edges


#: Rows of a window beyond which adding it up for every row costs more than running totals.
DENSE = 1000


def densest(df: DataFrame, ms_col: str, by: Sequence[str], window_ms: int) -> int:
    """Rows of the fullest (key, window-long slot)."""
    slot = F.floor(F.col(ms_col) / F.lit(int(window_ms)))
    counts = df.groupBy(*by, slot.alias("_slot")).agg(F.count(F.lit(1)).alias("n"))
    return int(counts.agg(F.max("n")).first()[0] or 0)


def bucket_length(rows: int, window_ms: int, target_rows: int) -> int:
    """Length of time buckets that hold about ``target_rows`` at the densest place's rate, from 2 to 20 windows."""
    w = int(window_ms)
    return int(min(20 * w, max(2 * w, w * target_rows / max(rows, 1))))


_SUMS = ("_n", "_m", "_s", "_nan", "_up", "_down")


def _grouped(df: DataFrame, ms_col: str, amount_col: str, by: Sequence[str]) -> DataFrame:
    """One row a (key, ms): rows, amounts, sum of the finite ones, numbers of NaN and infinite ones."""
    x = F.col(amount_col).cast("double")
    inf, odd = F.lit(float("inf")), F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    ones = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return df.filter(F.col(ms_col).isNotNull()).groupBy(*by, F.col(ms_col).cast("long").alias("_t")).agg(
        F.count(F.lit(1)).alias("_n"), F.count(x).alias("_m"), F.sum(F.when(odd, 0.0).otherwise(F.coalesce(x, F.lit(0.0)))).alias("_s"),
        ones(F.isnan(x)).alias("_nan"), ones(x == inf).alias("_up"), ones(x == -inf).alias("_down"),
    )


def laid_out(groups: DataFrame, by: Sequence[str], window_ms: int, n_buckets: int | None = None) -> tuple[DataFrame, int]:
    """Times and probes of every group in range buckets: by..., _t, _at (position), _probe, _b, sums; also the number of
    buckets."""
    zero = [F.lit(0.0 if c == "_s" else 0).cast("double" if c == "_s" else "long").alias(c) for c in _SUMS]
    two = F.array(
        F.struct(F.col("_t").alias("_at"), F.lit(False).alias("_probe"), *_SUMS),
        F.struct((F.col("_t") - F.lit(int(window_ms))).alias("_at"), F.lit(True).alias("_probe"), *zero),
    )
    rows = groups.select(*by, "_t", F.explode(two).alias("_x")).select(*by, "_t", "_x.*")
    edges = range_edges(rows, "_at", n_buckets)  # of times and probes alike: a burst's probes are as dense as its times
    return bucketize(rows, F.col("_at").cast("double"), edges, "_b"), len(edges) + 1


def _by_prefix(df: DataFrame, ms_col: str, amount_col: str, window_ms: int, by: list[str], count_col: str, sum_col: str) -> DataFrame:
    groups = materialize(_grouped(df, ms_col, amount_col, by))
    rows, _ = laid_out(groups, by, window_ms)
    # running totals inside a bucket; probes come after the time they stand on
    inside = Window.partitionBy(*by, "_b").orderBy("_at", "_probe").rowsBetween(Window.unboundedPreceding, 0)
    # whole buckets: exact decimals, so that far apart totals differ by what lies between them
    exact = lambda c: F.col(c).cast("decimal(38,12)") if c == "_s" else F.col(c)
    upto = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    totals = rows.groupBy(*by, "_b").agg(*[F.sum(c).alias(c) for c in _SUMS])
    totals = totals.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(by)], F.col("_b").alias("_tb"), F.struct(*_SUMS).alias("_own"),
        F.struct(*[F.sum(exact(c)).over(upto).alias(c) for c in _SUMS]).alias("_all"),
    )
    running = rows.select(*by, "_t", "_probe", "_b", F.struct(*[F.sum(c).over(inside).alias(c) for c in _SUMS]).alias("_in"))
    same = [F.col("_b") == F.col("_tb"), *[F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(by)]]
    running = running.join(totals, and_(same)).drop("_tb", *[f"_k{i}" for i in range(len(by))])
    pick = lambda probe: F.max(F.when(F.col("_probe") == probe, F.struct("_b", "_in", "_own", "_all")))
    pair = running.groupBy(*by, "_t").agg(pick(False).alias("_new"), pick(True).alias("_old"))
    new, old = F.col("_new"), F.col("_old")

    def between(c: str) -> Column:
        near = new["_in"][c] - old["_in"][c]
        whole = (new["_all"][c] - old["_all"][c]).cast("double" if c == "_s" else "long") - new["_own"][c]
        return F.when(new["_b"] == old["_b"], near).otherwise(new["_in"][c] + whole + (old["_own"][c] - old["_in"][c]))

    nan, up, down = (between(c) for c in ("_nan", "_up", "_down"))
    total = F.when((nan > 0) | ((up > 0) & (down > 0)), float("nan")).when(up > 0, float("inf")).when(down > 0, float("-inf")).otherwise(between("_s"))
    answers = pair.select(*by, F.col("_t").alias("_ms"), between("_n").alias(count_col), F.when(between("_m") > 0, total).alias(sum_col))
    counted = groups.select(*by, F.col("_t").alias("_ms"), F.col("_n").alias("_rows"))
    answers = materialize(answers.join(counted, and_([answers[k].eqNullSafe(counted[k]) for k in (*by, "_ms")])).select(
        *[answers[k] for k in (*by, "_ms", count_col, sum_col)], "_rows"
    ))
    keyed = df.withColumn("_ms", F.col(ms_col).cast("long"))
    return looked_up(keyed, answers, [*by, "_ms"], "_rows").drop("_ms")


def trailing_window(
    df: DataFrame,
    ms_col: str,
    amount_col: str,
    window_ms: int = 30_000,
    *,
    by: Sequence[str] = (),
    bucket_ms: int | None = None,
    target_rows: int = 2_000_000,
    count_col: str = "window_count",
    sum_col: str = "window_sum",
    method: str = "auto",
) -> DataFrame:
    """``df`` with the count of rows and the sum of amounts of every row's window.  ``bucket_ms`` fixes ``halo`` and its bucket
    length; results do not depend on ``method`` (sums to rounding)."""
    by = list(by)
    w = int(window_ms)
    if method not in ("auto", "halo", "prefix"):
        raise ValueError(f"unknown method {method!r}")
    if bucket_ms is None and method != "prefix":
        rows = densest(df, ms_col, by, w)
        if method == "auto" and (rows > DENSE or 3 * rows > 2 * target_rows):
            method = "prefix"
        bucket_ms = bucket_length(rows, w, target_rows)
    if method == "prefix":
        return _by_prefix(df, ms_col, amount_col, w, by, count_col, sum_col)
    b = int(bucket_ms)
    if b <= w:
        raise ValueError("bucket_ms must exceed the window")
    ms = F.col(ms_col)
    bucket = F.expr(f"(`{ms_col}` - pmod(`{ms_col}`, {b})) div {b}")  # floors, also before 1970
    next_start = (bucket + 1) * F.lit(b)
    copies = F.array(
        F.struct(bucket.alias("_bk"), F.lit(True).alias("_native")),
        F.when(F.coalesce(ms + F.lit(w - 1) >= next_start, F.lit(False)), F.struct((bucket + 1).alias("_bk"), F.lit(False).alias("_native"))),
    )
    exploded = df.select("*", F.explode(F.filter(copies, lambda x: x.isNotNull())).alias("_c")).select(
        "*", F.col("_c._bk").alias("_bk"), F.col("_c._native").alias("_native")
    ).drop("_c")
    frame = Window.partitionBy(*by, "_bk").orderBy(ms).rangeBetween(-(w - 1), 0)
    timed = F.col(ms_col).isNotNull()
    out = exploded.select(
        "*",
        F.when(timed, F.count(F.lit(1)).over(frame)).alias(count_col),
        F.when(timed, F.sum(F.col(amount_col)).over(frame)).alias(sum_col),
    )
    return out.where("_native").drop("_bk", "_native")
