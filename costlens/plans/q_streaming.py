"""Registered streaming queries.

Every query replays its whole table as ordered micro-batch files, runs the
streaming job to completion (availableNow), and returns the sink's contents.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from costlens.functions import portable_hash, portable_hash_sql
from costlens.plans.registry import register
from costlens.plans.views import EVENTS_SQL, events_scored, with_sql
from costlens.session import scratch_path
from costlens.streaming import jobs
from costlens.streaming.replay import batch_numbers, read_stream, write_batches, write_replay

N_BATCHES = 10  # micro-batches per replayed table


def _replay_events(spark, sf, order_col: str = "event_id"):
    ev = events_scored(spark, sf).select("event_id", "ms", "user_id", "value")
    path = scratch_path(spark, "replay")
    if order_col == "event_id":
        write_replay(ev, "event_id", path, n_batches=N_BATCHES)
    else:  # shuffled arrival order (late data): a hash of the id, ties broken by the id
        arrival = portable_hash(7, "event_id") * F.lit(16777216) + F.col("event_id") % F.lit(16777216)
        write_replay(ev.withColumn("_arrival", arrival), "_arrival", path, n_batches=N_BATCHES)
    return path


def _dirs(spark, name):
    return scratch_path(spark, f"{name}-out"), scratch_path(spark, f"{name}-ckpt")


@register(
    "stream_trailing_window",
    with_sql(
        EVENTS_SQL,
        body="""SELECT event_id, ms, count(*) OVER w AS window_count, round(sum(value) OVER w, 6) AS window_sum
FROM events_scored
WINDOW w AS (PARTITION BY user_id ORDER BY ms RANGE BETWEEN 3599999 PRECEDING AND CURRENT ROW)""",
    ),
)
def q_stream_trailing_window(spark, sf):
    out, ck = _dirs(spark, "s1")
    res = jobs.trailing_window_job(jobs.event_stream(spark, _replay_events(spark, sf)), out, ck, "user_id", 3_600_000, "1 minute")
    return res.select("event_id", "ms", "window_count", F.round("window_sum", 6).alias("window_sum"))


@register(
    "stream_hopping_window",
    with_sql(
        EVENTS_SQL,
        body="""SELECT s AS window_start_ms, s + 30000 AS window_end_ms, count(*) AS n, round(sum(value), 6) AS amount
FROM (SELECT value, unnest(range((ms // 10000) * 10000 - 20000, (ms // 10000) * 10000 + 1, 10000)) AS s FROM events_scored) t
GROUP BY s""",
    ),
)
def q_stream_hopping_window(spark, sf):
    out, ck = _dirs(spark, "s2")
    res = jobs.hopping_window_job(jobs.event_stream(spark, _replay_events(spark, sf)), out, ck, "30 seconds", "10 seconds", "1 minute")
    return res.select("window_start_ms", "window_end_ms", "n", F.round("amount", 6).alias("amount"))


_LATE_SQL = with_sql(
    EVENTS_SQL,
    f"""arr AS (SELECT event_id, ms, user_id, value,
          row_number() OVER (ORDER BY {portable_hash_sql(7, 'event_id')} * 16777216 + event_id % 16777216) - 1 AS pos,
          count(*) OVER () AS n FROM events_scored)""",
    f"b AS (SELECT *, pos // ((n + {N_BATCHES} - 1) // {N_BATCHES}) AS batch FROM arr)",
    "bm AS (SELECT batch, max(ms) AS mx FROM b GROUP BY batch)",
    """wm AS (SELECT b1.batch, max(b2.mx) - 3600000 AS wm FROM bm b1 LEFT JOIN bm b2 ON b2.batch < b1.batch GROUP BY b1.batch)""",
    """t AS (SELECT b.*, wm.wm IS NOT NULL AND b.ms < wm.wm AS late FROM b JOIN wm ON b.batch = wm.batch)""",
    body="""SELECT x.event_id, x.ms, x.late,
  CASE WHEN x.late THEN 0 ELSE count(y.event_id) END AS window_count,
  CASE WHEN x.late THEN NULL ELSE round(sum(y.value), 6) END AS window_sum
FROM t x LEFT JOIN t y ON NOT x.late AND NOT y.late AND y.user_id = x.user_id AND y.batch <= x.batch
  AND y.ms > x.ms - 3600000 AND y.ms <= x.ms
GROUP BY x.event_id, x.ms, x.late""",
)


@register("stream_late_data", _LATE_SQL)
def q_stream_late_data(spark, sf):
    """Arrival order shuffled by a hash of the id (fixed micro-batches).  A row
    behind the watermark (max event time of earlier batches minus the 1 h
    delay) comes out of the job flagged late, with window_count 0 and a null
    window_sum; every event comes out once.  On-time rows
    count the on-time rows of their user that arrived no later and fall in
    (t - 1 h, t]."""
    out, ck = _dirs(spark, "s3")
    replay = _replay_events(spark, sf, "hash")
    res = jobs.trailing_window_job(jobs.event_stream(spark, replay), out, ck, "user_id", 3_600_000, "1 hour")
    return res.select("event_id", "ms", "late", "window_count", F.round("window_sum", 6).alias("window_sum"))


@register("stream_dedup", with_sql(EVENTS_SQL, body="SELECT event_id, ms, value FROM events_scored"))
def q_stream_dedup(spark, sf):
    """Every batch re-delivers the first tenth of the next one (at-least-once);
    the stream must emit each event exactly once."""
    ev = events_scored(spark, sf).select("event_id", "ms", "user_id", "value")
    per = max(1, -(-ev.count() // N_BATCHES))
    staged = batch_numbers(ev, "event_id", per)
    # the first tenth of a batch is also sent, once more, with the batch before
    again = staged.where((F.col("_place") < per // 10) & (F.col("_batch") > 0)).withColumn("_batch", F.col("_batch") - 1)
    path = scratch_path(spark, "replay-dup")
    write_batches(staged.unionByName(again), path)
    out, ck = _dirs(spark, "s5")
    return jobs.dedup_job(jobs.event_stream(spark, path), out, ck).select("event_id", "ms", "value")


@register("stream_score")
def q_stream_score(spark, sf):
    """Transactions of the test period streamed as JSON, windowed per supplier
    (30 days), scored by the saved production model and flagged."""
    from costlens.operators import models
    from costlens.plans.q_models import SPEC, _production

    path, _, test = _production(spark, sf)
    model, meta = models.load_production(spark, path)
    rows = test.withColumn("rid", F.xxhash64(*[c for c in test.columns if c != "label"]))
    rows = rows.withColumn("ms", F.expr("time_us div 1000"))
    cols = ["rid", "ms", "l_suppkey", *SPEC.features]
    replay = scratch_path(spark, "replay-tx")
    write_replay(rows.select(*dict.fromkeys(cols)), "ms", replay, n_batches=N_BATCHES)
    schema = T.StructType(
        [T.StructField("rid", T.LongType()), T.StructField("ms", T.LongType()), T.StructField("l_suppkey", T.LongType())]
        + [T.StructField(c, T.LongType() if c == "time_us" else T.DoubleType()) for c in SPEC.features]
    )
    out, ck = _dirs(spark, "s4")
    res = jobs.score_stream_job(
        read_stream(spark, replay, schema), model, meta, out, ck, key_col="l_suppkey", time_ms_col="ms", amount_col="l_extendedprice",
        id_col="rid", keep=["rid", "l_suppkey", "ms"], window_ms=30 * 86_400_000, delay="1 day",
    )
    return res.select("rid", "l_suppkey", "window_count", F.round("window_sum", 6).alias("window_sum"),
                      F.round("fraud_probability", 6).alias("fraud_probability"), "is_fraud", "threshold")
