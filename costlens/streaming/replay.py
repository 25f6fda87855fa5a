"""Replay a table as a stream (A7) and run streaming queries to completion.

A table is cut into consecutive micro-batches in time order: a dense row
position (distributed prefix count, no global sort in one task) gives each row
its batch and its file within the batch.  One job writes all files, several per
batch; their modification times are then set in batch order, so that a file
source with ``maxFilesPerTrigger`` = files per batch delivers batch by batch
(the pacing of the reference producer becomes the trigger).  ``readStream`` over
that folder with an explicit schema is the tested source; a Kafka source is
used instead when its connector is on the classpath (A6).  Jobs take the
streaming DataFrame, whatever its source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from costlens.operators.ordered import prefix_sums


def positions(df: DataFrame, order_col: str, out: str = "_pos") -> DataFrame:
    """0-based position of each row in the order of ``order_col`` (a long); ties follow a hash of the whole row, so the
    same table gives the same positions in any layout (rows equal in every column are alike)."""
    digest = F.shiftrightunsigned(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), 2)
    wide = F.col(order_col).cast("decimal(18,0)") * F.lit(str(2**62)).cast("decimal(19,0)") + digest.cast("decimal(19,0)")
    g = df.withColumn("_key", wide).withColumn("_one", F.lit(1).cast("long"))
    return prefix_sums(g, "_key", ["_one"]).withColumn(out, F.col("cum__one") - 1).drop("_one", "cum__one", "_key")


def batch_numbers(df: DataFrame, order_col: str, rows_per_batch: int, n: int | None = None) -> DataFrame:
    """Adds ``_batch`` = position // rows_per_batch and ``_place``, the position within the batch, in ``order_col`` order
    (first ``n`` rows only when ``n`` is given)."""
    pos = positions(df, order_col)
    if n is not None:
        pos = pos.where(F.col("_pos") < n)
    per = int(rows_per_batch)
    return pos.select("*", F.expr(f"_pos div {per}").alias("_batch"), (F.col("_pos") % per).alias("_place")).drop("_pos")


#: Files of a micro-batch; a trigger takes that many.
FILES_PER_BATCH = 4
_BATCH, _FILE = "replay_batch", "replay_file"  # folders of the replayed files


def write_batches(staged: DataFrame, path: str, files: int = FILES_PER_BATCH, fmt: str = "json") -> int:
    """Write rows with ``_batch`` and ``_place`` as ``files`` files a batch in one job; returns the number of batches.

    A batch of fewer rows than files has fewer files; only the last one may.  Files become visible to the source in
    batch order by their modification times."""
    spark = staged.sparkSession
    split = staged.withColumn(_FILE, F.col("_place") % files).withColumnRenamed("_batch", _BATCH).drop("_place")
    split.repartition(_BATCH, _FILE).write.mode("overwrite").partitionBy(_BATCH, _FILE).format(fmt).save(path)
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.listFiles(root, True)
    start, batches = 1_000_000_000_000, set()
    while found.hasNext():  # a few files a batch
        one = found.next().getPath()
        inside = [p for p in one.toString().split("/") if p.startswith(f"{_BATCH}=")]
        if inside and not one.getName().startswith(("_", ".")):
            batch = int(inside[-1].partition("=")[2])
            batches.add(batch)
            fs.setTimes(one, start + batch * 10_000, -1)
    return len(batches)


def write_replay(
    df: DataFrame,
    order_col: str,
    path: str,
    rows_per_batch: int | None = 500,
    n: int | None = None,
    fmt: str = "json",
    n_batches: int | None = None,
    files: int = FILES_PER_BATCH,
) -> int:
    """Write the rows of ``df`` in ``order_col`` order as micro-batches under ``path``; returns their number.

    ``n_batches`` fixes the number of micro-batches instead of their size (the
    per-trigger overhead then does not grow with the table)."""
    if n_batches:
        total = df.count() if n is None else min(n, df.count())
        rows_per_batch = max(1, -(-total // int(n_batches)))
    return write_batches(batch_numbers(df, order_col, int(rows_per_batch), n), path, files, fmt)


def read_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "json", files_per_trigger: int = FILES_PER_BATCH) -> DataFrame:
    return (
        spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_trigger)
        .option("recursiveFileLookup", "true").load(path)
    )


def kafka_available(spark: SparkSession) -> bool:
    try:
        spark.sparkContext._jvm.java.lang.Class.forName("org.apache.spark.sql.kafka010.KafkaSourceProvider")
        return True
    except Exception:
        return False


def read_kafka(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """Broker source from the earliest offset (needs the Kafka connector jar)."""
    if not kafka_available(spark):
        raise RuntimeError(
            "the Kafka connector (spark-sql-kafka) is not on the classpath; add it with --packages/--jars, "
            "or replay files with write_replay + read_stream"
        )
    return (
        spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
        .option("startingOffsets", "earliest").load().select(F.col("value").cast("string").alias("payload"))
    )


def run_available(
    query_builder, checkpoint: str, timeout_s: float | None = None, state_partitions: int | None = None, spark=None
):
    """Start a writeStream builder with ``availableNow`` and wait for it to finish, however long that takes
    (``timeout_s``: give up, stop it and raise after so many seconds; it can be resumed from its checkpoint).

    Stateful operators keep one state store per shuffle partition for the whole
    life of the checkpoint, and every micro-batch touches each of them; the
    count is fixed at the first start from ``spark.sql.shuffle.partitions``.
    It is set here to ``state_partitions`` (default: the cluster's core count)
    just for the start, then the session value is restored."""
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.getActiveSession()
    n = int(state_partitions or spark.sparkContext.defaultParallelism)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    try:
        q = query_builder.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    if timeout_s is None:
        q.awaitTermination()
    else:
        q.awaitTermination(timeout_s)
    if q.isActive:
        q.stop()
        raise TimeoutError("streaming query did not finish")
    if q.exception() is not None:
        raise q.exception()
    return q
