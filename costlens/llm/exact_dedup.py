"""Exact dedup over an extendible-hash index kept in shared files (DataFrame operations only).

1. One scan turns every row into an index entry: 64-bit hash of the normalised text, its SHA-256, code points.
2. The directory doubles until its buckets hold at most ``capacity`` entries: a bucket is the longest hash prefix
   needed for that.  One key that alone overfills its bucket stays there, as doubling cannot split it.
3. Entries are written by range of (bucket, hash, doc_id), so an owner task holds one key range; ``doc_id`` in the
   range key splits the copies of one hot text over several owners, which count before they exchange anything.
4. Hashes held by several entries form chains.  Only their texts are fetched and compared, byte by byte, by grouping
   on the text itself, with copies folded before the shuffle.  A bitmap of the chained ids (8 MB at most) keeps other
   texts from being shuffled; where it lets some through, the exact join after it decides.

Defined results: a null text is empty, and empty texts equal one another; of equal texts the one with the most code
points in its original form, then the smallest ``doc_id`` stays; rows repeating a ``doc_id`` with equal text count in
``group_size`` and share the decision; a null ``doc_id`` is taken as larger than any other."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costlens.llm.common import id_text, saved

#: Entries that a bucket holds before its directory doubles, and the bits a directory can use at most.
CAPACITY = 4096
MAX_DEPTH = 24
#: Bits in one piece of the bitmap of chained ids (as Spark's bitmap functions make them), and pieces at most.
PIECE_BITS, MAX_PIECES = 32768, 2048
WHITE = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    """The text without space and 0x09-0x0D."""
    for c in WHITE:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def entries(docs: DataFrame) -> DataFrame:
    norm = normalised(F.col("text"))
    return id_text(docs).select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_points"),
        F.xxhash64(norm).alias("h"),
        F.sha2(norm, 256).alias("sha"),
    )


def directory(index: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> DataFrame:
    """One row per cell of the deepest directory: ``cell``, the depth of the bucket that it belongs to, and that bucket
    (first cell of its range).  It has at most ``4 * rows / capacity + 4`` rows."""
    depth = min(max_depth, max(2, math.ceil(math.log2(max(1, index.count()) / capacity + 1)) + 2))
    cells = index.groupBy(F.shiftrightunsigned("h", 64 - depth).alias("cell")).agg(F.count("*").alias("n"))
    levels = cells.select("cell", "n", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("depth"))
    prefix = F.call_function("shiftright", F.col("cell"), depth - F.col("depth")).alias("prefix")
    full = levels.groupBy("depth", prefix).agg(F.sum("n").alias("held")).filter(F.col("held") <= capacity)
    spread = levels.select("cell", "depth", prefix)
    fits = spread.join(full, ["depth", "prefix"], "left").groupBy("cell").agg(
        F.coalesce(F.min(F.when(F.col("held").isNotNull(), F.col("depth"))), F.lit(depth)).alias("depth")
    )
    bits = depth - F.col("depth")
    begin = F.call_function("shiftleft", F.call_function("shiftright", F.col("cell"), bits), bits)
    return fits.select("cell", "depth", begin.alias("bucket"), F.lit(64 - depth).alias("shift"))


def build_index(docs: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> DataFrame:
    """The index, read from shared files whose tasks own ranges of (bucket, hash)."""
    raw = saved(entries(docs), "dedup-entries")
    table = saved(directory(raw, capacity, max_depth), "dedup-directory")
    shift = table.agg(F.max("shift")).first()[0] or 62
    placed = raw.withColumn("cell", F.shiftrightunsigned("h", shift)).join(table.drop("shift"), "cell")
    owned = placed.select("bucket", "depth", "h", "sha", "n_points", "doc_id")
    return saved(owned.repartitionByRange("bucket", "h", "doc_id").sortWithinPartitions("bucket", "h", "doc_id"), "dedup-index")


def maybe_among(rows: DataFrame, members: DataFrame, max_pieces: int = MAX_PIECES) -> DataFrame:
    """Rows whose ``doc_id`` may be among ``members`` (_member; read twice: pass a written table): none of those is lost,
    and 32 bits a member keep most others away, up to two million members."""
    pieces = min(max_pieces, 1 << (32 * members.count() // PIECE_BITS).bit_length())

    def slot(c: str) -> tuple[Column, Column]:
        h = F.hash(c).cast("long")
        return F.pmod(F.shiftright(h, 15), F.lit(pieces)), F.pmod(h, F.lit(PIECE_BITS))

    piece, bit = slot("_member")
    dealt = members.select(piece.alias("_piece"), bit.alias("_bit")).repartition("_piece")
    held = dealt.groupBy("_piece").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    piece, bit = slot("doc_id")
    byte = F.col("_bits").substr((F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))
    is_set = F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), bit.bitwiseAND(F.lit(7)).cast("int")) == 1
    # a semi join: Spark moves the exact one after it below an inner join, and all texts would be shuffled first
    return rows.join(F.broadcast(held), (piece == F.col("_piece")) & is_set, "left_semi")


def chained_texts(docs: DataFrame, members: DataFrame) -> DataFrame:
    """doc_id and text of the rows whose ``doc_id`` is among ``members`` (_member; a written table)."""
    texts = maybe_among(id_text(docs), members)
    return texts.join(members.hint("shuffle_hash"), texts["doc_id"].eqNullSafe(members["_member"]), "left_semi")


def compared(docs: DataFrame, index: DataFrame) -> DataFrame:
    """Chains of entries under one hash, split by the bytes of their texts: h, sha, keep_id, group_size of every
    class with two entries or more."""
    chains = index.groupBy("bucket", "h").agg(F.count("*").alias("n")).filter("n > 1").select("h")
    members = saved(index.join(chains, "h", "left_semi").select(F.col("doc_id").alias("_member")), "dedup-members")
    norm = chained_texts(docs, members).select(normalised(F.col("text")).alias("norm"))
    classes = norm.groupBy("norm").agg(F.count("*").alias("n")).filter("n > 1")
    classes = classes.select(F.xxhash64("norm").alias("h"), F.sha2("norm", 256).alias("sha"))
    # texts that differ under one hash and one digest would come out as two classes of one key
    bytes_equal = classes.groupBy("h", "sha").agg(F.count("*").alias("k")).withColumn(
        "k", F.when(F.col("k") > 1, F.raise_error(F.lit("different texts share a SHA-256 digest"))).otherwise(F.col("k"))
    )
    best = index.groupBy("h", "sha").agg(
        F.min(F.struct((-F.col("n_points")).alias("a"), F.col("doc_id").isNull().alias("b"), "doc_id")).alias("best"),
        F.count("*").alias("group_size"),
    )
    kept = best.filter("group_size > 1").join(bytes_equal.filter("k >= 1"), ["h", "sha"])
    return kept.select("h", "sha", F.col("best.doc_id").alias("keep_id"), "group_size")


def exact_dedup(docs: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, bucket, depth."""
    index = build_index(docs, capacity, max_depth)
    classes = saved(compared(docs, index), "dedup-classes").withColumn("_copies", F.lit(True))
    own = F.col("_copies").isNull()
    keep = F.when(own, F.col("doc_id")).otherwise(F.col("keep_id"))
    return index.join(classes, ["h", "sha"], "left").select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        F.col("sha").alias("text_sha256"),
        "bucket",
        F.col("depth").cast("int").alias("depth"),
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """Stage form: rows of ``docs`` that stay, all their columns.  A document is its ``doc_id`` (null or not) and its text:
    an id with several texts keeps each one that is no copy.  Rows equal in both are one document: the one with the most
    code points in its original form, then the largest text, stays."""
    found = exact_dedup(docs).filter("kept").groupBy(F.col("doc_id").alias("_kept_id"), F.col("text_sha256").alias("_kept_sha"))
    kept = saved(found.agg(F.count("*").alias("_kept_rows")), "dedup-kept")
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    own, sha = docs["doc_id"].cast("long"), F.sha2(normalised(text), 256)

    def among(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
        ids = ids.drop("_kept_rows").hint("shuffle_hash")  # as many as documents: never broadcast
        return rows.join(ids, own.eqNullSafe(ids["_kept_id"]) & (sha == ids["_kept_sha"]), how)

    stay, twice = among(docs, kept, "left_semi"), kept.filter("_kept_rows > 1")
    if twice.isEmpty():
        return stay
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns])
    folded = among(stay, twice, "left_semi").groupBy(own.alias("_own_id"), sha.alias("_own_sha"))
    folded = folded.agg(F.max_by(row, F.struct(F.char_length(text), text)).alias("_row")).select("_row.*")
    return among(stay, twice, "left_anti").unionByName(folded)


ORACLE = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), g AS (
  SELECT doc_id, norm,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY n_points DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""
