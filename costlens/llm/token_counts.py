"""Token counts through a digest cache.

Every text is digested (SHA-256 of its UTF-8 bytes; the normaliser inside the tokenizer is part of the tokenizer
version, so equal bytes are the only texts taken as equal) together with a digest of the tokenizer's file.  The distinct
digests are joined to the stored counts, only distinct misses are encoded, and their counts are appended to the cache,
so a second call over the same or an overlapping corpus encodes nothing twice.

Defined results: a null text counts as the empty text and has 0 tokens; rows that repeat a ``doc_id`` each get their
row; a null ``doc_id`` is kept."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costlens.llm.common import blocks, id_text, looked_up, on_workers, saved, small_batches
from costlens.session import scratch_path

CACHE = "tokenizer string, digest binary, n_tokens long"
OVER = 4096
#: A text is cut for nothing here; this many texts go to the library in one call.
CALL_ROWS = 64


def load(path: str):
    """A function from a list of texts to their token counts, by the library for the file's kind."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    return lambda texts: [len(x.ids) for x in model.encode_batch(texts, add_special_tokens=False)]


def version(path: str) -> str:
    """Digest of the tokenizer's file; a changed file shares no counts with the old one."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _encode(path: str, tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = load(path)
        for block in blocks(batches):
            texts, counts = block.column("text").to_pylist(), []
            for i in range(0, len(texts), CALL_ROWS):
                counts += count(texts[i : i + CALL_ROWS])
            yield pa.RecordBatch.from_arrays(
                [pa.array([tokenizer] * len(texts), pa.string()), block.column("digest").cast(pa.binary()), pa.array(counts, pa.int64())],
                ["tokenizer", "digest", "n_tokens"],
            )

    return run


def digested(docs: DataFrame) -> DataFrame:
    return id_text(docs).withColumn("digest", F.unhex(F.sha2("text", 256)))


def stored(docs: DataFrame, cache: str, tokenizer: str) -> DataFrame:
    """The cache's counts for one tokenizer version (an absent cache is empty)."""
    spark = docs.sparkSession
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], CACHE)
    return spark.read.schema(CACHE).parquet(cache).filter(F.col("tokenizer") == tokenizer)


def fill(docs: DataFrame, path: str, cache: str) -> str:
    """Encode what the cache lacks and append it; returns the tokenizer version.

    A digest's text is fetched from the one row with its smallest id: the semi join is keyed by (id, digest), so a
    text held by a third of all rows is shuffled evenly and encoded once.  Should two writers append the same digest,
    readers fold the equal rows."""
    spark = docs.sparkSession
    small_batches(spark)
    on_workers(spark)
    tokenizer = version(path)
    texts = digested(docs)
    need = texts.groupBy("digest").agg(F.min("doc_id").alias("_first"))
    have = stored(docs, cache, tokenizer).select("digest").distinct()
    need = need.join(have, "digest", "left_anti").withColumnRenamed("digest", "_digest")
    same = (texts["digest"] == need["_digest"]) & texts["doc_id"].eqNullSafe(need["_first"])
    misses = texts.join(need.hint("shuffle_hash"), same, "left_semi").select("digest", "text")
    misses.mapInArrow(_encode(path, tokenizer), CACHE).write.mode("append").parquet(cache)
    return tokenizer


def token_counts(docs: DataFrame, path: str, cache: str | None = None, over: int = OVER) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs``.

    ``path``: the tokenizer's file (.model or .json), at one place on every executor; ``cache``: a shared folder that
    outlives the call (unset: a fresh one under the checkpoint folder)."""
    cache = cache or scratch_path(docs.sparkSession, "token-counts")
    tokenizer = fill(docs, path, cache)
    rows = digested(docs).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest")
    counts = stored(docs, cache, tokenizer).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    copies = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("_copies"))
    counts = saved(counts.join(copies.hint("shuffle_hash"), "digest"), "token-counts-held")
    found = looked_up(rows, counts, "digest", "_copies", F.xxhash64("doc_id", F.monotonically_increasing_id()))
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > over).alias("over_limit"))
