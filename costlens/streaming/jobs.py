"""Structured Streaming jobs (A10, S1-S5), each run to completion with
``availableNow`` over a streaming frame and an idempotent sink.

Sinks use ``foreachBatch``: every micro-batch is written to its own
``batch=<id>`` folder with overwrite, so a batch replayed after a failure
replaces its own output instead of duplicating it (exactly-once with the
checkpointed source offsets).

Event time (S1-S4): one query over the source sees every row, and each row comes out of it once.  A batch's *mark* is the
newest event time of the batches before it minus the delay (none for the first); a row behind it is late.  The mark is
written with the batch, so rows are dealt by the same mark when a batch runs again or the job is resumed, however the
triggers cut the stream.

State is a log: a batch's on-time rows are written once, as (key, ms, amount), and a later batch reads the folders that
may still hold rows within its windows; nothing is rewritten, and folders that no window can reach are removed.  The
windows of a batch are computed by the batch operator W1 over that and the batch, so a hot key, or no key at all, is
spread over time buckets like any table."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from costlens.operators.windows import trailing_window
from costlens.sources.files import delete, read_text, replace_text
from costlens.streaming.replay import read_stream, run_available


def _folder(root: str, batch: int) -> str:
    return f"{root}/batch={batch:09d}"


def batch_sink(path: str):
    """foreachBatch writer: idempotent per batch id."""

    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(_folder(path, batch_id))

    return write


def sink_to(stream: DataFrame, out: str, checkpoint: str, mode: str = "append", timeout_s: float | None = None) -> None:
    builder = stream.writeStream.outputMode(mode).foreachBatch(batch_sink(out))
    run_available(builder, checkpoint, timeout_s, spark=stream.sparkSession)


def each_batch(stream: DataFrame, checkpoint: str, work: Callable[[DataFrame, int], None]) -> None:
    """``work(rows, batch id)`` for every micro-batch, its rows computed once."""

    def run(df: DataFrame, batch_id: int) -> None:
        df.persist()
        try:
            work(df, batch_id)
        finally:
            df.unpersist()

    run_available(stream.writeStream.foreachBatch(run), checkpoint, spark=stream.sparkSession)


def milliseconds(spark: SparkSession, delay: str) -> int:
    return int(spark.sql(f"SELECT unix_millis(timestamp_seconds(0) + INTERVAL '{delay}')").first()[0])


class Marks:
    """Of every batch, a line of JSON: the newest event time up to it, and which batches' rows later windows may reach."""

    def __init__(self, spark: SparkSession, root: str, delay_ms: int, window_ms: int = 0):
        self.spark, self.root, self.delay, self.window = spark, root, delay_ms, window_ms

    def before(self, batch: int) -> tuple[int | None, list[tuple[int, int]]]:
        """(mark, live batches) for the rows of ``batch``."""
        if batch == 0:
            return None, []
        row = json.loads(read_text(self.spark, self._path(batch - 1)))
        return (None if row["newest"] is None else row["newest"] - self.delay), [tuple(x) for x in row["live"]]

    def _path(self, batch: int) -> str:
        return f"{self.root}/marks/{batch:09d}.json"

    def leave(self, batch: int, newest: int | None) -> None:
        """Write the batch's own; what it no longer lists cannot be reached from the next batch on."""
        mark, live = self.before(batch)
        known = [x for x in (newest, None if mark is None else mark + self.delay) if x is not None]
        upto = max(known, default=None)
        own = [(batch, newest)] if newest is not None else []
        kept = [(b, n) for b, n in live + own if n > upto - self.delay - self.window] if upto is not None else []
        replace_text(self.spark, self._path(batch), json.dumps({"newest": upto, "live": kept}))

    def clear(self, batch: int) -> None:
        """Remove rows that ``batch`` could not reach: no batch that may run again needs them."""
        if batch < 2:
            return
        gone = {b for b, _ in self.before(batch - 1)[1]} - {b for b, _ in self.before(batch)[1]}
        for b in gone:
            delete(self.spark, _folder(f"{self.root}/seen", b))


STATE = ("_key", "_ms", "_amount")


def windowed(rows: DataFrame, batch: int, marks: Marks, key: str | None, ms: str, amount: str) -> DataFrame:
    """``rows`` of a batch with window_count, window_sum and late: on-time rows over the on-time rows that arrived no
    later; rows that are late or have no time with count 0 and a null sum."""
    spark, columns = rows.sparkSession, rows.columns
    mark, live = marks.before(batch)
    key_col = F.col(f"`{key}`") if key else F.lit(0)
    time, timed = F.col(f"`{ms}`").cast("long"), F.col(f"`{ms}`").isNotNull()
    on_time = timed if mark is None else F.coalesce(time >= F.lit(mark), F.lit(False))
    state = rows.filter(on_time).select(key_col.alias("_key"), time.alias("_ms"), F.col(f"`{amount}`").cast("double").alias("_amount"))
    state.write.mode("overwrite").parquet(_folder(f"{marks.root}/seen", batch))
    marks.leave(batch, rows.filter(on_time).agg(F.max(time)).first()[0])
    old = [_folder(f"{marks.root}/seen", b) for b, _ in live]
    new = rows.filter(on_time).withColumns({"_key": key_col, "_ms": time, "_amount": F.col(f"`{amount}`").cast("double"), "_new": F.lit(True)})
    every = new
    if old:
        reach = spark.read.schema(state.schema).parquet(*old).filter(F.col("_ms") > F.lit(mark - marks.window))
        every = new.unionByName(reach, allowMissingColumns=True)
    out = trailing_window(every, "_ms", "_amount", marks.window, by=["_key"] if key else []).filter("_new")
    late = rows.filter(~on_time).withColumns({"window_count": F.lit(0).cast("long"), "window_sum": F.lit(None).cast("double"), "late": F.lit(True)})
    wanted = [F.col(f"`{c}`") for c in (*columns, "window_count", "window_sum", "late")]
    return out.withColumn("late", F.lit(False)).select(*wanted).unionByName(late.select(*wanted))


def read_sink(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(out)


def latest_per_key(df: DataFrame, keys: Sequence[str], version: str = "batch") -> DataFrame:
    """Final table of an update-mode sink: the row of the last batch per key."""
    rest = [c for c in df.columns if c not in (*keys, version)]
    last = F.max_by(F.struct(*rest), F.col(version)).alias("_last")
    return df.groupBy(*keys).agg(last).select(*keys, "_last.*")


EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ms", T.LongType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("value", T.DoubleType()),
    ]
)


def event_stream(spark: SparkSession, replay_path: str) -> DataFrame:
    """Replayed events as a streaming frame; any other with these columns serves the jobs as well."""
    return read_stream(spark, replay_path, EVENT_SCHEMA, "json")


def watermarked(events: DataFrame, delay: str) -> DataFrame:
    return events.withColumn("ts", F.timestamp_millis("ms")).withWatermark("ts", delay)


def payload_stream(source: DataFrame, schema: T.StructType, payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """(events, corrupt payloads) of a streaming frame of JSON texts, such as a broker's."""
    from costlens.sources.io import decode_events

    decoded = decode_events(source, schema, payload, keep=[payload])
    return decoded.where("not _corrupt").drop("_corrupt", payload), decoded.where("_corrupt").select(payload)


def trailing_window_job(
    events: DataFrame, out: str, checkpoint: str, key_col: str | None = "user_id", window_ms: int = 30_000, delay: str = "1 minute",
) -> DataFrame:
    """Per-event trailing count and sum of a streaming frame (event_id, ms, value, key), by entity or, with no
    ``key_col``, over all events.

    Every event comes out once: with its window, or, if it is behind the mark or has no time, flagged ``late`` with
    count 0 and a null sum.  The key may have any type; events with a null key are one entity."""
    spark = events.sparkSession
    marks = Marks(spark, f"{checkpoint}-state", milliseconds(spark, delay), window_ms)

    def work(df: DataFrame, batch: int) -> None:
        rows = windowed(df, batch, marks, key_col, "ms", "value")
        key = F.col(f"`{key_col}`") if key_col else F.lit(None).cast("long")
        shown = rows.select(key.alias("key"), "event_id", "ms", "window_count", "window_sum", "late")
        shown.write.mode("overwrite").parquet(_folder(out, batch))
        marks.clear(batch)

    each_batch(events, checkpoint, work)
    return read_sink(spark, out).drop("batch")


def hopping_window_job(
    events: DataFrame, out: str, checkpoint: str, size: str = "30 seconds", slide: str = "10 seconds",
    delay: str = "1 minute",
) -> DataFrame:
    """Global windowed count and sum.  Every batch writes its part of every window; parts add up, so there is no state.

    A window closes when the mark passes its end: parts that come later are not counted but kept, as (window, event), in
    ``out``-late."""
    spark = events.sparkSession
    marks = Marks(spark, f"{checkpoint}-state", milliseconds(spark, delay))

    def work(df: DataFrame, batch: int) -> None:
        mark, _ = marks.before(batch)
        marks.leave(batch, df.agg(F.max("ms")).first()[0])
        rows = df.withColumn("w", F.window(F.timestamp_millis("ms"), size, slide)).filter("w is not null")
        rows = rows.select(F.unix_millis("w.start").alias("window_start_ms"), F.unix_millis("w.end").alias("window_end_ms"), "event_id", "ms", "value")
        closed = F.lit(False) if mark is None else F.col("window_end_ms") <= F.lit(mark)
        parts = rows.filter(~closed).groupBy("window_start_ms", "window_end_ms").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("amount"))
        parts.write.mode("overwrite").parquet(_folder(out, batch))
        rows.filter(closed).write.mode("overwrite").parquet(_folder(f"{out}-late", batch))

    each_batch(events, checkpoint, work)
    return read_sink(spark, out).groupBy("window_start_ms", "window_end_ms").agg(F.sum("n").alias("n"), F.sum("amount").alias("amount"))


def dedup_job(events: DataFrame, out: str, checkpoint: str, delay: str = "10 minutes") -> DataFrame:
    """At-least-once delivery made exactly-once by event id within the watermark."""
    sink_to(watermarked(events, delay).dropDuplicatesWithinWatermark(["event_id"]).drop("ts"), out, checkpoint)
    return read_sink(events.sparkSession, out)


def score_stream_job(
    raw: DataFrame,
    model,
    meta: dict,
    out: str,
    checkpoint: str,
    key_col: str,
    time_ms_col: str,
    amount_col: str,
    id_col: str,
    keep: Sequence[str],
    window_ms: int,
    delay: str,
    rejected_out: str | None = None,
) -> DataFrame:
    """Validate -> trailing-window features per entity -> score with
    the saved production model -> flag -> idempotent sink, in one query over the streaming frame ``raw``.

    No event is lost: rows that break the feature contract, or have no key, time or amount, go with their ``reasons`` to
    ``rejected_out`` (``out``-rejected unless given); rows behind the mark come out flagged ``late``, scored on their
    features, without a window."""
    from costlens.operators import models
    from costlens.operators.features import validate_contract

    spark, rejected_out = raw.sparkSession, rejected_out or f"{out}-rejected"
    feats = list(meta["feature_columns"])
    marks = Marks(spark, f"{checkpoint}-state", milliseconds(spark, delay), window_ms)
    needed = list(dict.fromkeys([key_col, time_ms_col, amount_col]))

    def work(df: DataFrame, batch: int) -> None:
        checked = validate_contract(df, feats, [c for c in df.columns if c not in feats])
        absent = F.array_compact(F.array(*[F.when(F.col(f"`{c}`").isNull(), F.lit(c)) for c in needed]))
        checked = checked.withColumn("reasons", F.array_distinct(F.concat("reasons", absent)))
        valid = F.size("reasons") == 0
        bad = checked.where(~valid).drop("is_valid").withColumn("reasons", F.array_join("reasons", ","))
        bad.write.mode("overwrite").parquet(_folder(rejected_out, batch))
        rows = windowed(checked.where(valid).drop("reasons", "is_valid"), batch, marks, key_col, time_ms_col, amount_col)
        scored = models.flagged(model, meta, rows)
        scored = scored.select(*keep, "window_count", "window_sum", "late", "fraud_probability", "is_fraud", "threshold")
        scored.write.mode("overwrite").parquet(_folder(out, batch))
        marks.clear(batch)

    each_batch(raw, checkpoint, work)
    return read_sink(spark, out).drop("batch")
