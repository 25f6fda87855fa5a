import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from costlens.operators import windows
from costlens.operators.windows import trailing_window


def _win(spark, rows, w=30_000, **kw):
    df = spark.createDataFrame(rows, "event_id long, ms long, amount double")
    out = trailing_window(df, "ms", "amount", w, **kw)
    return {r["event_id"]: (r["window_count"], r["window_sum"]) for r in out.collect()}


def test_same_millisecond_events(spark):
    t = 1_700_000_000_000
    assert _win(spark, [(1, t, 10.0), (2, t, 25.0)]) == {1: (2, 35.0), 2: (2, 35.0)}


def test_expired_event(spark):
    t = 1_700_000_000_000
    assert _win(spark, [(1, t - 60_000, 100.0), (2, t, 5.0)])[2] == (1, 5.0)


def test_exactly_window_old_is_out(spark):
    t = 1_700_000_000_000
    got = _win(spark, [(1, t - 30_000, 7.0), (2, t - 29_999, 3.0), (3, t, 5.0)])
    assert got[3] == (2, 8.0)


def test_halo_buckets_equal_plain_window(spark):
    rng = np.random.default_rng(0)
    ms = np.sort(rng.integers(0, 2_000_000, 3000))
    rows = [(int(i), int(m), float(rng.integers(1, 100))) for i, m in enumerate(ms)]
    df = spark.createDataFrame(rows, "event_id long, ms long, amount double")
    plain = df.select("event_id", F.count(F.lit(1)).over(Window.orderBy("ms").rangeBetween(-29_999, 0)).alias("c"),
                      F.sum("amount").over(Window.orderBy("ms").rangeBetween(-29_999, 0)).alias("s"))
    want = {r["event_id"]: (r["c"], r["s"]) for r in plain.collect()}
    got = _win(spark, rows, bucket_ms=40_000)  # many bucket edges -> many halo rows
    assert got == want


def test_by_key(spark):
    rows = [(1, 0, 1.0, 1), (2, 10, 2.0, 2), (3, 20, 4.0, 1)]
    df = spark.createDataFrame(rows, "event_id long, ms long, amount double, user long")
    out = {r["event_id"]: r["window_count"] for r in trailing_window(df, "ms", "amount", 30_000, by=["user"]).collect()}
    assert out == {1: 1, 2: 1, 3: 2}


def test_auto_bucket_is_exact_for_a_hot_key(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), int(m), float(rng.integers(1, 9)), 0 if i % 3 else 1) for i, m in enumerate(np.sort(rng.integers(0, 5_000_000, 3000)))]
    df = spark.createDataFrame(rows, "event_id long, ms long, amount double, user long")
    w = Window.partitionBy("user").orderBy("ms").rangeBetween(-29_999, 0)
    want = {r["event_id"]: (r["c"], r["s"]) for r in df.select(
        "event_id", F.count(F.lit(1)).over(w).alias("c"), F.sum("amount").over(w).alias("s")).collect()}
    from costlens.operators.windows import bucket_length, densest

    rows = densest(df, "ms", ["user"], 30_000)
    assert 10 < rows < 40
    assert 60_000 <= bucket_length(rows, 30_000, 50) < 600_000  # sized from the hot key, inside [2w, 20w)
    assert bucket_length(rows, 30_000, 1) == 60_000 and bucket_length(0, 30_000, 50) == 600_000
    out = trailing_window(df, "ms", "amount", 30_000, by=["user"], target_rows=50)
    got = {r["event_id"]: (r["window_count"], r["window_sum"]) for r in out.collect()}
    assert got == want


def test_windows_before_1970(spark):
    from costlens.operators import windows

    times = [-250_000 + i * 97 % 400_000 for i in range(3000)]
    df = spark.createDataFrame([(t, 1.0) for t in times], "ms long, amount double")
    got = windows.trailing_window(df, "ms", "amount", 30_000, bucket_ms=64_000).collect()
    want = {t: sum(1 for o in times if t - 30_000 < o <= t) for t in set(times)}
    assert len(got) == 3000 and all(r["window_count"] == want[r["ms"]] for r in got)


def test_both_plans_on_odd_rows(spark):
    """Nulls of every kind, NaN, infinities, copies, negative times, a null key: against a plain loop."""
    inf, nan = float("inf"), float("nan")
    rows = [(i, (i * 7919 % 400) * 100 - 9000, float(i % 13) / 4, None if i % 11 == 0 else i % 3) for i in range(400)]
    rows += [(500, None, 1.0, 1), (501, 100, None, 1), (502, 100, nan, 1), (503, 20_000, inf, 1), (504, 21_000, -inf, 1), (505, 26_000, -inf, 2), (506, 99_999_999, None, 7), (507, -(10**12), 5.0, 7)]
    df = spark.createDataFrame(rows, "event_id long, ms long, amount double, user int").withColumn("_t", F.lit("clash"))
    want = {}
    for i, ms, _, user in rows:
        if ms is None:
            want[i] = (None, None)
            continue
        inside = [a for _, m, a, u in rows if u == user and m is not None and ms - 5000 < m <= ms]
        amounts = [a for a in inside if a is not None]
        want[i] = (len(inside), str(round(sum(amounts), 6)) if amounts else None)
    for method in ("halo", "prefix"):
        out = trailing_window(df.repartition(5), "ms", "amount", 5000, by=["user"], method=method)
        assert "_t" in out.columns
        got = {r["event_id"]: (r["window_count"], None if r["window_sum"] is None else str(round(r["window_sum"], 6))) for r in out.collect()}
        assert got == want


def test_a_burst_in_one_window_is_spread(spark):
    """Half of all rows lie in one window of one key, a third share one millisecond."""
    from costlens.operators import windows

    rows = [(i, 50_000 + i % 9000 if i % 2 else i * 40, 1.0 + i % 3, 1 if i % 2 else i % 5) for i in range(6000)]
    rows += [(10_000 + i, 55_000, 2.0, 1) for i in range(3000)]
    df = spark.createDataFrame(rows, "event_id long, ms long, amount double, user long").repartition(6)
    w = Window.partitionBy("user").orderBy("ms").rangeBetween(-29_999, 0)
    want = {r["event_id"]: (r["c"], r["s"]) for r in df.select("event_id", F.count(F.lit(1)).over(w).alias("c"), F.sum("amount").over(w).alias("s")).collect()}
    out = trailing_window(df, "ms", "amount", 30_000, by=["user"], target_rows=500)  # auto: too many for one task
    assert {r["event_id"]: (r["window_count"], r["window_sum"]) for r in out.collect()} == want
    laid, buckets = windows.laid_out(windows._grouped(df, "ms", "amount", ["user"]), ["user"], 30_000, 32)
    sizes = [r["count"] for r in laid.groupBy("user", "_b").count().collect()]
    assert buckets > 20 and max(sizes) < 3 * sum(sizes) / buckets


def test_a_window_over_everything_by_prefix(spark):
    rows = [(i, i * 10, 1e6 + i / 4) for i in range(1000)]
    assert _win(spark, rows, 10**9, method="prefix") == {i: (i + 1, sum(a for _, _, a in rows[: i + 1])) for i in range(1000)}
    assert _win(spark, [], method="prefix") == {} and _win(spark, []) == {}


def test_auto_adds_no_dense_window_up_for_every_row(spark, monkeypatch):
    """A burst in one window: running totals, whatever a task could hold."""
    taken = []
    by_prefix = windows._by_prefix
    monkeypatch.setattr(windows, "_by_prefix", lambda *a: taken.append(1) or by_prefix(*a))
    rows = [(i, 2 * i, float(i % 7)) for i in range(1500)]
    want = {i: (i + 1, sum(a for _, _, a in rows[: i + 1])) for i in range(1500)}
    assert _win(spark, rows, 10_000) == want and taken
    del taken[:]
    assert _win(spark, rows[:900], 10_000) == {i: want[i] for i in range(900)} and not taken
