"""Helpers shared by the corpus operators.

Defined results for odd input, used by every operator here: a null text counts
as the empty text, extra columns of the input are ignored (so their names cannot
clash), an empty table gives an empty result with the documented schema, and a
null ``doc_id`` is an ordinary value of that column unless an operator says
otherwise."""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from costlens.session import scratch_path, ship_package

#: Rows in an Arrow batch that tasks work on, and bytes of text in one numpy block.
BATCH_ROWS = 512
BLOCK_BYTES = 1 << 20


#: What this Python worker remembers between tasks: one operator's memo at a time.
_memos: dict = {}


def remembered(key: tuple, make):
    """``make()`` once per worker for ``key``; another key's memo is dropped first, so a worker that serves several
    operators holds one of them."""
    if key not in _memos:
        _memos.clear()
        _memos[key] = make()
    return _memos[key]


def forget() -> None:
    """For tasks that need the worker's memory for themselves."""
    if _memos:
        _memos.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def id_text(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone, a null text as the empty one."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Texts are long: an Arrow batch of the default 10,000 rows would not fit a small worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def on_workers(spark: SparkSession) -> None:
    """Make this package importable in executors' Python workers."""
    ship_package(spark)


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, computed once,
    and still there after an executor is lost."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def blocks(batches: Iterator[pa.RecordBatch], limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of one block stay near ``limit`` bytes (a single longer text is its own block)."""
    for batch in batches:
        sizes = pc.binary_length(batch.column("text")).to_pylist()
        begin = total = 0
        for i, size in enumerate(sizes):
            if i > begin and total + (size or 0) > limit:
                yield batch.slice(begin, i - begin)
                begin, total = i, 0
            total += size or 0
        if begin < len(sizes):
            yield batch.slice(begin)


#: Bounds on the bits of a bitmap that is sent to all tasks (8 MB at most), and of the pieces it is built from.
MAP_LEAST, MAP_MOST, MAP_PIECE = 1 << 19, 1 << 26, 1 << 19


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Set bits of the bitmap's pieces that this partition holds."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        piece, place = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("piece", "place"))
        for k in np.unique(piece).tolist():
            own = held.setdefault(k, np.zeros(MAP_PIECE, bool))
            own[place[piece == k]] = True
    if held:
        packed = [np.packbits(x, bitorder="little").tobytes() for x in held.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(packed, pa.binary())], names=["piece", "bits"])


class Bitmap:
    """Set of 64-bit codes that errs on one side: it may say yes to others, never no to a member.

    32 bits a code keep wrong answers at 3 %; beyond ``MAP_MOST`` bits they grow in number, so an exact join has to
    follow.  Tasks build it piece by piece; the driver sees at most ``MAP_MOST`` bits."""

    def __init__(self, codes: DataFrame):
        """``codes``: one long column named code."""
        on_workers(codes.sparkSession)
        many = codes.count()
        self.bits = min(MAP_MOST, max(MAP_LEAST, 1 << max(0, 32 * many - 1).bit_length()))
        slot = F.col("code").bitwiseAND(F.lit(self.bits - 1))
        dealt = codes.select(F.shiftright(slot, 19).alias("piece"), slot.bitwiseAND(F.lit(MAP_PIECE - 1)).alias("place"))
        table = np.zeros(self.bits // 64, np.uint64)
        for row in dealt.repartition("piece").mapInArrow(_pieces, "piece long, bits binary").collect():
            words = np.frombuffer(row["bits"], "<u8")
            table[row["piece"] * len(words) : (row["piece"] + 1) * len(words)] = words
        self.table = codes.sparkSession.sparkContext.broadcast(table)

    def has(self, codes: np.ndarray) -> np.ndarray:
        """Whether each of ``codes`` (64-bit) may be a member."""
        slot = codes.astype(np.uint64) & np.uint64(self.bits - 1)
        return ((self.table.value[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1)).astype(bool)


def prefilter(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` (doc_id, text) whose ``doc_id`` may be among ``ids``, so that the exact semi join after it
    shuffles few texts."""
    on_workers(docs.sparkSession)
    code = F.xxhash64("doc_id").alias("code")
    bitmap = Bitmap(ids.select(code))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = batch.filter(pa.array(bitmap.has(batch.column("code").to_numpy(zero_copy_only=False))))
            if out.num_rows:
                yield out.select(["doc_id", "text"])

    return docs.select("doc_id", "text", code).mapInArrow(run, "doc_id long, text string")


def keep_ids(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of ``docs`` (all their columns) whose ``doc_id`` is among ``kept``; rows with a null id stay."""
    ids = kept.select(F.col("doc_id").alias("_kept_id")).hint("shuffle_hash")  # as many as documents: never broadcast
    return docs.join(ids, docs["doc_id"].cast("long").eqNullSafe(ids["_kept_id"]), "left_semi")


def drop_ids(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """Rows of ``docs`` (all their columns) whose ``doc_id`` is not among ``dropped``."""
    ids = dropped.select(F.col("doc_id").alias("_dropped_id"))
    return docs.join(ids, docs["doc_id"].cast("long") == ids["_dropped_id"], "left_anti")


#: A key of more than this share of all rows is looked up by broadcast; so there are this many such keys at most.
HOT_SHARE = 1000


def looked_up(rows: DataFrame, table: DataFrame, key: str, many: str, spread: Column) -> DataFrame:
    """``rows`` with the columns of ``table``'s row that has the same ``key`` (nulls without one).

    ``table`` has one row a key, with ``many``, the number of ``rows`` that hold it (read twice: pass a written table).  Keys
    of more than one in ``HOT_SHARE`` of those are broadcast; their rows are spread by ``spread`` in the shuffle that brings
    the others to their key, so no task gets a hot key."""
    own = [c for c in table.columns if c != key]
    total = table.agg(F.coalesce(F.sum(many), F.lit(0))).first()[0]
    is_hot = F.col(many) * HOT_SHARE > F.lit(total)
    hot = table.filter(is_hot).select(F.col(key).alias("_hot_key"), F.struct(*own).alias("_hot"))
    cold = table.filter(~is_hot).select(F.col(key).alias("_cold_key"), F.struct(*own).alias("_cold"), F.lit(0).alias("_cold_salt"))
    rows = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
    rows = rows.withColumn("_salt", F.when(F.col("_hot_key").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(spread), F.lit(1 << 20))).cast("int"))
    rows = rows.join(cold.hint("shuffle_hash"), (F.col(key) == F.col("_cold_key")) & (F.col("_salt") == F.col("_cold_salt")), "left")
    found = F.coalesce("_hot", "_cold")
    for c in own:
        rows = rows.withColumn(c, found[c])
    return rows.drop("_hot_key", "_hot", "_salt", "_cold_key", "_cold", "_cold_salt")


#: Labelled rows that a classifier is fitted on at most.
TRAIN_ROWS = 20_000


def held_out(modulus: int, held: int) -> Column:
    """Whether a row is kept from learning: crc32 of the id as text, modulo ``modulus``, is ``held``; a null id is not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == held, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, modulus: int, held: int, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, text, label (0 or 1) of at most ``rows`` labelled documents that are not held out, chosen by a hash of the
    id.  The chosen labels, bounded by ``rows``, are broadcast, so no text is shuffled."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label"))
    known = known.filter("doc_id is not null and label in (0, 1)").filter(~held_out(modulus, held))
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))  # a repeated label row counts once
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return id_text(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")
