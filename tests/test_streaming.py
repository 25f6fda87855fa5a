from pyspark.sql import Window
from pyspark.sql import functions as F

from costlens.session import scratch_path
from costlens.streaming import jobs
from costlens.streaming.replay import read_stream, write_replay


def _events(spark, n=600):
    return spark.range(n).select(
        F.col("id").alias("event_id"),
        (F.lit(1_700_000_000_000) + F.col("id") * 20_000 + F.col("id") * 7_919 % 19_000).alias("ms"),
        (F.col("id") % 7).alias("user_id"),
        ((F.col("id") * 37) % 100 / 4.0).alias("value"),
    )


def test_stream_window_equals_batch(spark):
    ev = _events(spark)
    path = scratch_path(spark, "t-replay")
    assert write_replay(ev, "event_id", path, 100) == 6
    out = jobs.trailing_window_job(jobs.event_stream(spark, path), scratch_path(spark, "t-out"), scratch_path(spark, "t-ck"), "user_id", 120_000)
    w = Window.partitionBy("user_id").orderBy("ms").rangeBetween(-119_999, 0)
    batch = ev.select("event_id", F.count(F.lit(1)).over(w).alias("c"), F.sum("value").over(w).alias("s"))
    want = {r["event_id"]: (r["c"], round(r["s"], 6)) for r in batch.collect()}
    got = {r["event_id"]: (r["window_count"], round(r["window_sum"], 6)) for r in out.collect()}
    assert got == want


def test_dedup_stream(spark):
    ev = _events(spark, 300)
    path = scratch_path(spark, "t-dup")
    ev.where("event_id < 200").coalesce(1).write.json(f"{path}/b=00000")
    ev.where("event_id >= 150").coalesce(1).write.json(f"{path}/b=00001")
    out = jobs.dedup_job(jobs.event_stream(spark, path), scratch_path(spark, "t-dout"), scratch_path(spark, "t-dck"), "1 hour")
    assert out.count() == 300 and out.select("event_id").distinct().count() == 300


def test_stream_scores_equal_batch_scores(spark, tmp_path):
    import numpy as np
    from pyspark.sql import types as T

    from costlens.operators import models
    from costlens.operators.features import FeatureSpec

    rng = np.random.default_rng(0)
    n = 400
    x = rng.normal(size=(n, 3))
    y = (x[:, 0] + rng.normal(0, 0.5, n) > 1).astype(int)
    rows = [(i, 1_700_000_000_000 + i * 1000, i % 5, int(y[i]), *map(float, x[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "rid long, ms long, key long, label int, a double, b double, c double")
    spec = FeatureSpec(features=("a", "b", "c"), scaled=("a",), label="label")
    meta = models.train_production(df.where("rid < 300"), df.where("rid >= 300"), spec, str(tmp_path / "m"), max_iter=5)
    model, meta = models.load_production(spark, str(tmp_path / "m"))
    batch = {r["rid"]: r["fraud_probability"] for r in models.score_batch(model, meta, df, ["rid"]).collect()}
    replay = scratch_path(spark, "t-tx")
    write_replay(df.drop("label"), "ms", replay, n_batches=4)
    schema = T.StructType([T.StructField("rid", T.LongType()), T.StructField("ms", T.LongType()), T.StructField("key", T.LongType())]
                          + [T.StructField(c, T.DoubleType()) for c in ("a", "b", "c")])
    out = jobs.score_stream_job(
        read_stream(spark, replay, schema), model, meta, scratch_path(spark, "t-so"), scratch_path(spark, "t-sc"),
        key_col="key", time_ms_col="ms", amount_col="a", id_col="rid", keep=["rid"], window_ms=10_000, delay="1 minute",
    )
    got = {r["rid"]: r["fraud_probability"] for r in out.collect()}
    assert set(got) == set(batch)
    assert max(abs(got[k] - batch[k]) for k in got) < 1e-12
    # per-key (t - 10 s, t] window; a key's events are 5 s apart -> itself and the previous one
    w = {r["rid"]: r["window_count"] for r in out.collect()}
    assert all(w[i] == (1 if i < 5 else 2) for i in range(n))


def test_stream_scoring_reports_rejected_rows(spark, tmp_path):
    import json

    import numpy as np
    from pyspark.sql import types as T

    from costlens.operators import models
    from costlens.operators.features import FeatureSpec

    rng = np.random.default_rng(1)
    rows = [(i, 1_700_000_000_000 + i * 1000, i % 3, int(rng.random() < 0.3), float(rng.normal()), float(rng.normal()))
            for i in range(120)]
    df = spark.createDataFrame(rows, "rid long, ms long, key long, label int, a double, b double")
    spec = FeatureSpec(features=("a", "b"), label="label")
    models.train_production(df.where("rid < 80"), df.where("rid >= 80"), spec, str(tmp_path / "m"), max_iter=3)
    model, meta = models.load_production(spark, str(tmp_path / "m"))
    replay = scratch_path(spark, "t-rej")
    good = [{"rid": r[0], "ms": r[1], "key": r[2], "a": r[4], "b": r[5]} for r in rows[:50]]
    bad = [{"rid": 1000, "ms": rows[49][1] + 1, "key": 0, "a": None, "b": 1.0}, {"rid": 1001, "ms": rows[49][1], "key": None, "a": 1.0, "b": 1.0}]
    bad += [{"rid": 1002, "ms": None, "key": 1, "a": 1.0, "b": 1.0}]
    spark.createDataFrame([(json.dumps(x),) for x in good + bad], "value string").coalesce(1).write.text(f"{replay}/b=00000")
    schema = T.StructType([T.StructField("rid", T.LongType()), T.StructField("ms", T.LongType()), T.StructField("key", T.LongType()),
                           T.StructField("a", T.DoubleType()), T.StructField("b", T.DoubleType())])
    rej = scratch_path(spark, "t-rej-out")
    out = jobs.score_stream_job(
        read_stream(spark, replay, schema), model, meta, scratch_path(spark, "t-rej-o"), scratch_path(spark, "t-rej-c"),
        key_col="key", time_ms_col="ms", amount_col="b", id_col="rid", keep=["rid"], window_ms=10_000, delay="1 minute",
        rejected_out=rej,
    )
    assert out.count() == 50
    r = spark.read.parquet(rej).orderBy("rid").collect()
    assert [(x["rid"], x["reasons"]) for x in r] == [(1000, "a"), (1001, "key"), (1002, "ms")]


def test_kafka_source_is_gated(spark):
    import pytest

    from costlens.streaming.replay import kafka_available, read_kafka

    if kafka_available(spark):
        pytest.skip("connector present")
    with pytest.raises(RuntimeError):
        read_kafka(spark, "localhost:9092", "transactions")


def test_late_events_come_out_once_and_flagged(spark):
    """Shuffled arrival: every event in comes out, late exactly if behind the watermark of the batches before."""
    n, per, delay = 800, 100, 3_600_000
    ev = _events(spark, n).withColumn("arrival", F.col("event_id") * 389 % n)
    path = scratch_path(spark, "t-late")
    assert write_replay(ev, "arrival", path, per) == n // per
    out = jobs.trailing_window_job(jobs.event_stream(spark, path), scratch_path(spark, "t-lo"), scratch_path(spark, "t-lc"), "user_id", 120_000, "1 hour")
    rows = out.collect()
    assert sorted(r["event_id"] for r in rows) == list(range(n))
    events = sorted(((r["arrival"], r["ms"], r["event_id"]) for r in ev.collect()))
    want, newest = {}, None
    for b in range(0, n, per):
        batch = events[b : b + per]
        want |= {e: newest is not None and ms < newest - delay for _, ms, e in batch}
        newest = max([newest or 0, *(ms for _, ms, _ in batch)])
    assert any(want.values()) and not all(want.values())
    assert {r["event_id"]: r["late"] for r in rows} == want
    assert all((r["window_count"] == 0) == r["late"] for r in rows)


def test_rows_at_an_unchanged_watermark_are_on_time_and_none_is_lost(spark):
    """Batches of four; from the second one on the watermark stands at ``edge``."""
    edge = 1_700_000_000_000
    newest = edge + 3_600_000
    times = [newest, newest - 5, edge + 9, edge + 1, newest - 1, edge + 2, edge, edge - 1, newest, edge, edge + 1, edge - 1, 0, edge, edge, -5]
    ev = spark.createDataFrame([(i, ms, 1, 0.5) for i, ms in enumerate(times)], "event_id long, ms long, user_id long, value double")
    path = scratch_path(spark, "t-edge")
    assert write_replay(ev, "event_id", path, 4) == 4
    out = jobs.trailing_window_job(jobs.event_stream(spark, path), scratch_path(spark, "t-eo"), scratch_path(spark, "t-ec"), "user_id", 1000, "1 hour")
    got = sorted((r["event_id"], r["late"], r["window_count"]) for r in out.collect())
    assert [g[0] for g in got] == list(range(len(times)))
    assert {i for i, late, _ in got if late} == {i for i, ms in enumerate(times) if i >= 4 and ms < edge}
    assert [n for i, _, n in got if times[i] == edge] == [1, 2, 4, 4]


def test_replay_is_the_same_in_any_layout_and_keeps_batches_apart(spark):
    ev = spark.range(500).select(F.col("id").alias("event_id"), (F.col("id") % 3).alias("day"), (F.col("id") * 7).alias("ms"))
    seen = []
    for parts in (1, 9):
        path = scratch_path(spark, "t-lay")
        assert write_replay(ev.repartition(parts), "day", path, 60) == 9
        found = spark.read.json(path).select("event_id", "replay_batch").collect()
        seen.append({r["event_id"]: r["replay_batch"] for r in found})
        assert sorted(seen[-1]) == list(range(500))
    assert seen[0] == seen[1]


def test_payloads_of_a_broker(spark):
    path = scratch_path(spark, "t-pay")
    texts = ['{"event_id":1,"ms":5,"user_id":2,"value":1.5}', '{"event_id":2,"ms":6', "", '{"event_id":3,"ms":7,"user_id":2,"value":null}']
    spark.createDataFrame([(t,) for t in texts], "payload string").coalesce(1).write.json(path)
    source = spark.readStream.schema("payload string").json(path)
    good, bad = jobs.payload_stream(source, jobs.EVENT_SCHEMA)
    for name, frame in (("g", good), ("b", bad)):
        jobs.sink_to(frame, f"{path}-{name}", f"{path}-{name}-ck")
    assert sorted(r["event_id"] for r in spark.read.parquet(f"{path}-g").collect()) == [1, 3]
    assert sorted(r["payload"] for r in spark.read.parquet(f"{path}-b").collect()) == sorted(texts[1:3])


def _uneven(spark, log, sizes, ev):
    """Rows of ``ev`` in order of arrival, as segments of the given sizes; yields after each."""
    from costlens.streaming.event_log import append_segment

    at = 0
    for size in sizes:
        append_segment(ev.where(f"arrival >= {at} and arrival < {at + size}").drop("arrival").repartition(3), log)
        at += size
        yield at


def test_log_source_killed_and_resumed_with_uneven_batches(spark):
    """Segments of unlike sizes, the job stopped between them and once within a batch: every event comes out once, dealt by
    the marks of the batches as they ran; a segment without its end is not read."""
    import os

    import pytest

    from costlens.streaming import event_log

    n, sizes = 600, [7, 200, 1, 92, 300]
    ev = _events(spark, n).withColumn("arrival", F.col("event_id") * 389 % n).persist()
    log, out, check = scratch_path(spark, "t-log"), scratch_path(spark, "t-logo"), scratch_path(spark, "t-logc")

    def run():
        good, _ = jobs.payload_stream(event_log.read_log(spark, log), jobs.EVENT_SCHEMA)
        return jobs.trailing_window_job(good, out, check, "user_id", 120_000, "1 hour")

    real, cut = jobs._folder, []

    def breaks_once(root, batch):
        if root == out and batch == 2 and not cut:
            cut.append(batch)
            raise RuntimeError("lost before the sink")
        return real(root, batch)

    jobs._folder = breaks_once
    try:
        for k, _ in enumerate(_uneven(spark, log, sizes, ev)):
            if k == 2:
                with pytest.raises(Exception, match="lost before the sink"):
                    run()
            result = run()
    finally:
        jobs._folder = real
    os.makedirs(event_log.segment_path(log, 5))
    spark.createDataFrame([("{}",)], "value string").write.mode("overwrite").text(event_log.segment_path(log, 5))
    os.remove(f"{event_log.segment_path(log, 5)}/_SUCCESS")
    assert event_log.whole_segments(log) == 5
    rows = run().collect()
    assert cut and sorted(r["event_id"] for r in rows) == list(range(n)) and result is not None
    events = sorted((r["arrival"], r["ms"], r["event_id"], r["user_id"], r["value"]) for r in ev.collect())
    newest, at, seen, want = None, 0, [], {}
    for size in sizes:
        batch = events[at : at + size]
        on_time = [e for e in batch if newest is None or e[1] >= newest - 3_600_000]
        seen += on_time
        want |= {e[2]: (True, 0, None) for e in batch if e not in on_time}
        for e in on_time:
            inside = [x[4] for x in seen if x[3] == e[3] and e[1] - 120_000 < x[1] <= e[1]]
            want[e[2]] = (False, len(inside), round(sum(inside), 6))
        newest, at = max([newest or 0, *(e[1] for e in batch)]), at + size
    assert any(w[0] for w in want.values())
    assert {r["event_id"]: (r["late"], r["window_count"], None if r["window_sum"] is None else round(r["window_sum"], 6)) for r in rows} == want
    ev.unpersist()


def test_window_without_a_key_equals_batch_and_old_state_goes(spark):
    import os

    ev = _events(spark)
    path, out, check = scratch_path(spark, "t-nk"), scratch_path(spark, "t-nko"), scratch_path(spark, "t-nkc")
    write_replay(ev, "event_id", path, 60)
    rows = jobs.trailing_window_job(jobs.event_stream(spark, path), out, check, None, 120_000)
    w = Window.orderBy("ms").rangeBetween(-119_999, 0)
    want = {r["event_id"]: (r["c"], round(r["s"], 6)) for r in ev.select("event_id", F.count(F.lit(1)).over(w).alias("c"), F.sum("value").over(w).alias("s")).collect()}
    assert {r["event_id"]: (r["window_count"], round(r["window_sum"], 6)) for r in rows.collect()} == want
    assert len(os.listdir(f"{check}-state/seen")) < 5


def test_null_keys_times_and_amounts_and_text_keys(spark):
    t = 1_700_000_000_000
    rows = [(1, t, None, 1.0), (2, t + 1, None, 2.0), (3, t + 2, "a", None), (4, None, "a", 1.0), (5, t + 3, "a", 4.0), (6, t + 4, "b", None)]
    path = scratch_path(spark, "t-null")
    spark.createDataFrame(rows, "event_id long, ms long, user_id string, value double").coalesce(1).write.json(f"{path}/x")
    stream = read_stream(spark, path, "event_id long, ms long, user_id string, value double")
    out = jobs.trailing_window_job(stream, scratch_path(spark, "t-nullo"), scratch_path(spark, "t-nullc"), "user_id", 1000)
    got = {r["event_id"]: (r["key"], r["window_count"], r["window_sum"], r["late"]) for r in out.collect()}
    assert got == {
        1: (None, 1, 1.0, False), 2: (None, 2, 3.0, False), 3: ("a", 1, None, False), 4: ("a", 0, None, True),
        5: ("a", 2, 4.0, False), 6: ("b", 1, None, False),
    }


def test_stateful_operator_takes_nulls_and_any_key(spark):
    from costlens.streaming.stateful import stream_trailing_window

    t = 1_700_000_000_000
    rows = [(1, t, None, 1.0), (2, t + 1, None, 2.0), (3, t + 2, "a", None), (4, None, "a", 1.0), (5, t + 3, "a", 4.0)]
    path = scratch_path(spark, "t-sf")
    spark.createDataFrame(rows, "event_id long, ms long, user_id string, amount double").coalesce(1).write.json(f"{path}/x")
    stream = jobs.watermarked(read_stream(spark, path, "event_id long, ms long, user_id string, amount double"), "1 minute")
    out = f"{path}-out"
    jobs.sink_to(stream_trailing_window(stream, "user_id", 1000), out, f"{path}-ck")
    got = {r["event_id"]: (r["key"], r["ms"], r["window_count"], r["late"]) for r in spark.read.parquet(out).collect()}
    assert {k: v for k, v in got.items() if k != 4} == {1: (None, t, 1, False), 2: (None, t + 1, 2, False), 3: ("a", t + 2, 1, False), 5: ("a", t + 3, 2, False)}
    assert got.get(4, ("a", None, 0, True)) == ("a", None, 0, True)


def test_hopping_windows_keep_late_parts(spark):
    t = 1_700_000_000_000
    ev = spark.createDataFrame([(i, t + (300_000 if i in (3, 7) else 0), 1, 1.0 if i < 4 else 5.0) for i in range(8)], "event_id long, ms long, user_id long, value double")
    path, out = scratch_path(spark, "t-hop"), scratch_path(spark, "t-hopo")
    write_replay(ev, "event_id", path, 4)  # the second batch comes five minutes after the first windows
    rows = {r["window_start_ms"]: (r["n"], r["amount"]) for r in jobs.hopping_window_job(jobs.event_stream(spark, path), out, scratch_path(spark, "t-hopc"), "10 seconds", "10 seconds").collect()}
    assert rows == {t: (3, 3.0), t + 300_000: (2, 6.0)}
    assert [(r["event_id"], r["value"]) for r in spark.read.parquet(f"{out}-late").orderBy("event_id").collect()] == [(4, 5.0), (5, 5.0), (6, 5.0)]
