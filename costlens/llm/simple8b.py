"""Token ids in Simple-8b blocks: writing, reading back.

Ids are packed into 64-bit words.  The top four bits of a word are its selector, the other 60 hold as many ids as fit at
the selector's width.  Selector 15 marks an escape: its word holds no id, the next word holds one id of any size.  The
last word of a block may have unused places; the block's counts tell.

A block holds the ids of whole documents (about ``BLOCK_IDS`` together) or one part of a longer document, and the
offsets for taking it apart: per document its id, its ids in this block, where they begin within the document.  Blocks
are rows of a table in shared files written by Spark's own committer (a lost executor's task runs again, its
half-written file never shows).  A reader decodes every block alone, by selector, with vector shifts.

Order: files hold ascending ranges of documents, blocks ascend within a file, so the files in order are the stream.

Defined results: null text counts as empty (only the end id); a null ``doc_id`` sorts first; rows that repeat a
``doc_id`` each are a document, in the order of a hash of their text."""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from costlens.llm.common import blocks, id_text, on_workers, remembered, small_batches
from costlens.session import scratch_path

#: (bits an id, ids a word) of selectors 0 to 14 - fixed by the format; selector 15 is the escape.
WIDTHS = [(60 // n, n) for n in (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)]
ESCAPE = 15
BLOCK_IDS = 1 << 16
#: Words, and pieces of words, whose ids a worker remembers (bounds on its memory; beyond them it starts anew).
MEMO_WORDS = 800_000
MEMO_PIECES = 700_000
_U = np.uint64


def pack(ids: np.ndarray) -> np.ndarray:
    """Ids (below 2**64) as 64-bit words, greedily the selector with most ids first.

    The greedy choice at every position is computed at once, from sliding maxima of the ids' bit lengths; the chain of
    positions actually used is then followed."""
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64)
    pad = WIDTHS[0][1]
    ids = np.concatenate([ids.astype(np.uint64), np.zeros(pad, np.uint64)])
    bits = np.maximum(np.frexp(ids.astype(np.float64))[1], 1).astype(np.uint8)  # rounding may only add a bit
    longest, most = {1: bits[: n + pad]}, bits
    choice = np.where(bits[:n] <= WIDTHS[-1][0], np.uint8(len(WIDTHS) - 1), np.uint8(ESCAPE))
    for s in range(len(WIDTHS) - 2, -1, -1):
        width, many = WIDTHS[s]
        had = max(k for k in longest if k <= many)
        most = longest[had]
        while had < many:  # a window of `had` joined with one that ends at the wider window's end
            step = min(had, many - had)
            most = np.maximum(most[: len(most) - step], most[step:])
            had += step
        longest[many] = most
        if len(most) >= n:
            choice = np.where(most[:n] <= width, np.uint8(s), choice)
    jump = np.array([m for _, m in WIDTHS] + [0, 1])[choice].tolist()
    at, used = 0, []
    while at < n:
        used.append(at)
        at += jump[at]
    used = np.asarray(used)
    chosen = choice[used]
    takes = np.where(chosen == ESCAPE, 2, 1)
    slot = np.cumsum(takes) - takes
    out = np.zeros(int(takes.sum()), np.uint64)
    for s in np.unique(chosen).tolist():
        mine = np.flatnonzero(chosen == s)
        first, word = used[mine], np.full(len(mine), _U(s << 60))
        if s == ESCAPE:
            out[slot[mine]], out[slot[mine] + 1] = word, ids[first]
            continue
        width, many = WIDTHS[s]
        for j in range(many):
            word |= ids[first + j] << _U(j * width)
        out[slot[mine]] = word
    return out


def unpack(words: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` ids of a block."""
    if not len(words):
        return np.zeros(0, np.uint64)
    selector = (words >> _U(60)).astype(np.int64)
    escaped = np.zeros(len(words), bool)
    if (marks := np.flatnonzero(selector == ESCAPE)).size:  # a word after an escape is raw, whatever its top bits
        marks = marks.tolist()
        last = -2
        for m in marks:
            if last != m - 1:
                escaped[m + 1] = True
                last = m
    selector[escaped] = -1
    held = np.array([n for _, n in WIDTHS] + [0, 0, 1])  # selectors 0.., 14 (unused), 15, -1
    sizes = held[selector]
    begin = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint64)
    out[begin[escaped]] = words[escaped]
    for s in np.unique(selector[selector >= 0]):
        if s == ESCAPE:
            continue
        width, many = WIDTHS[s]
        mine = np.flatnonzero(selector == s)
        shifts = (np.arange(many) * width).astype(np.uint64)
        out[begin[mine][:, None] + np.arange(many)] = (words[mine][:, None] >> shifts) & _U((1 << width) - 1)
    return out[:count]


#: Fixed by the tokenizer file: its splitting pattern, spelled out for Latin letters and ASCII in lower case.
_LETTERS = "a-z\u00df-\u00f6\u00f8-\u00ff\u0100-\u012f\u0131-\u017f"
_SYMBOLS = re.escape("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[{_SYMBOLS}]+")


#: The rules of a tokenizer file under which a text may be cut into words first - fixed values of the format.
_CUTTABLE = {
    "normalizer": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
    "pre_tokenizer": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def cuttable(path: str) -> bool:
    """Whether the file's rules are those that words may be cut by; special tokens must begin with the mark looked for."""
    with open(path, encoding="utf-8") as f:
        facts = json.load(f)
    steps = {"normalizer": (facts["normalizer"] or {}).get("normalizers"), "pre_tokenizer": (facts["pre_tokenizer"] or {}).get("pretokenizers")}
    marked = all(t["content"].startswith("<|") and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in facts["added_tokens"])
    return steps == _CUTTABLE and marked and facts["post_processor"] is None and facts["model"]["type"] == "BPE" and not facts["model"]["dropout"]


class WordIds:
    """Ids of whole texts through the ids of their words.

    That holds for a tokenizer file with the rules of ``_CUTTABLE``; with any other, whole texts go to the library.
    The former lower-cases, folds white space to a blank, splits into pieces and drops blanks; no rule of it looks
    across white space, so a text's ids are its words' ids in order.  A word of plain characters (Latin letters, ASCII)
    is cut by the tokenizer's own pattern and its new pieces go to the library's model; any other word, and one with a
    special token's mark, goes to the whole tokenizer.  Words and pieces are remembered as id bytes, up to a bound."""

    def __init__(self, path: str, words: int = MEMO_WORDS, pieces: int = MEMO_PIECES):
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.cuttable = cuttable(path)
        pack_ids = lambda *ids: struct.pack(f"<{len(ids)}I", *ids)
        model, to_bytes = self.library.model, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)

        def piece(p: str) -> bytes:
            spelled = p if p.isascii() else to_bytes.pre_tokenize_str(p)[0][0]
            return pack_ids(*[t.id for t in model.tokenize(spelled)])

        known = _Memo(piece, pieces)

        def word(w: bytes) -> bytes:
            text = w.decode()
            low = text.lower()
            cut = _PIECES.findall(low)
            if sum(map(len, cut)) == len(low) and "<|" not in text:  # all plain: nothing was passed over
                return b"".join(map(known.__getitem__, cut))
            return pack_ids(*self.library.encode(text, add_special_tokens=False).ids)

        self.words = _Memo(word, words)

    def __call__(self, data: bytes) -> np.ndarray:
        """Ids of a text in UTF-8."""
        if not self.cuttable:
            return np.array(self.library.encode(data.decode(), add_special_tokens=False).ids, "<u4")
        if b"<|" not in data:  # case does not matter then
            data = data.lower()
        return np.frombuffer(b"".join(map(self.words.__getitem__, data.split())), "<u4")


class _Memo(dict):
    """Remembers what ``make`` gave for a key; emptied when it holds ``limit`` keys."""

    def __init__(self, make, limit: int):
        self.make, self.limit = make, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        self[key] = out = self.make(key)
        return out


def word_ids(path: str) -> WordIds:
    """One per Python worker, which serves many tasks."""
    return remembered(("word ids", path), lambda: WordIds(path))


FILE = "file int, block long, split boolean, doc_ids array<long>, counts array<int>, first long, total long, words binary"
_NAMES = ["file", "block", "split", "doc_ids", "counts", "first", "total", "words"]
_TYPES = [pa.int32(), pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.binary()]


def _batch(rows: list, types: list, names: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def _write(path: str, end: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, file, block = word_ids(path), TaskContext.get().partitionId(), 0
        docs: list[int] = []
        held: list[np.ndarray] = []
        size = 0

        def whole() -> tuple:
            ids = np.concatenate(held)
            return (file, block, False, list(docs), [len(h) for h in held], 0, len(ids), pack(ids).astype("<u8").tobytes())

        for texts in blocks(batches):
            rows = []
            for doc, text in zip(texts.column("doc_id").to_pylist(), texts.column("text").cast(pa.binary()).to_pylist(), strict=True):
                own = np.append(encode(text), np.uint32(end))
                if held and size + len(own) > limit:
                    rows.append(whole())
                    docs, held, size, block = [], [], 0, block + 1
                if len(own) <= limit:
                    docs.append(doc)
                    held.append(own)
                    size += len(own)
                    continue
                for i in range(0, len(own), limit):
                    part = own[i : i + limit]
                    rows.append((file, block, True, [doc], [len(part)], i, len(own), pack(part).astype("<u8").tobytes()))
                    block += 1
            if rows:
                yield _batch(rows, _TYPES, _NAMES)
        if held:
            yield _batch([whole()], _TYPES, _NAMES)

    return run


def write_ids(docs: DataFrame, tokenizer: str, path: str, end: int = 1, block_ids: int = BLOCK_IDS) -> None:
    """Encode every text, append ``end``, write the blocks under ``path`` in ascending ``doc_id`` order."""
    spark = docs.sparkSession
    small_batches(spark)
    on_workers(spark)
    ranged = id_text(docs).withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie")
    ranged = ranged.sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    ranged.mapInArrow(_write(tokenizer, end, block_ids), FILE).write.parquet(path)


def _parts(batch: pa.RecordBatch) -> Iterator[tuple]:
    """(file, block, doc_id, offset in the block, first, total of the document, ids) of a block's documents."""
    cols = [batch.column(c).to_pylist() for c in _NAMES]
    for file, block, split, docs, counts, first, total, words in zip(*cols, strict=True):
        ids, at = unpack(np.frombuffer(words, "<u8"), sum(counts)).astype("<u4"), 0
        for doc, n in zip(docs, counts, strict=True):
            yield file, block, doc, at, first, total if split else n, ids[at : at + n]
            at += n


IDS = "file int, block long, doc_id long, offset long, first long, total long, ids binary"
_ID_NAMES = ["file", "block", "doc_id", "offset", "first", "total", "ids"]
_ID_TYPES = [pa.int32(), *[pa.int64()] * 5, pa.binary()]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            if rows := [(*p[:-1], p[-1].tobytes()) for p in _parts(batch.slice(i, 1))]:
                yield _batch(rows, _ID_TYPES, _ID_NAMES)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """The documents, or parts of long ones, of the files under ``path``: their place, and ids as little-endian uint32."""
    small_batches(spark)
    on_workers(spark)
    return spark.read.schema(FILE).parquet(path).mapInArrow(_read, IDS)


CRC = "file int, block long, doc_id long, offset long, n_tokens long, ids_crc32 long"
_CRC_NAMES = ["file", "block", "doc_id", "offset", "n_tokens", "ids_crc32"]
_CRC_TYPES = [pa.int32(), *[pa.int64()] * 5]


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """CRC of each document's ids; the parts of a long document arrive in order, also across batches."""
    open_: list | None = None
    for batch in batches:
        done = []
        for file, block, doc, offset, first, total, ids in _parts(batch):
            if first == 0:
                open_, seen = [file, block, doc, offset, total, 0], 0
            open_[-1], seen = zlib.crc32(ids.tobytes(), open_[-1]), seen + len(ids)
            if seen == total:
                done.append(open_)
        if done:
            yield _batch(done, _CRC_TYPES, _CRC_NAMES)


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32 of every document, from the files.

    Starts: the blocks' totals are summed up within each file, the files' totals (one row per task of the writer) in
    order of the files."""
    small_batches(spark, 64)
    on_workers(spark)
    table = spark.read.schema(FILE).parquet(path)
    parts = table.filter("split").repartition("file").sortWithinPartitions("file", "block")
    crc = table.filter("not split").mapInArrow(_crc, CRC).unionByName(parts.mapInArrow(_crc, CRC))
    held = table.select("file", "block", F.aggregate("counts", F.lit(0).cast("long"), lambda a, n: a + n).alias("n"))
    files = held.groupBy("file").agg(F.sum("n").alias("n"))
    before = files.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("before"))
    upto = F.sum("n").over(Window.partitionBy("file").orderBy("block")) - F.col("n")
    begin = held.select("file", "block", upto.alias("within")).join(F.broadcast(before), "file")
    begin = begin.select("file", "block", (F.col("before") + F.col("within")).alias("begin"))
    return crc.join(begin, ["file", "block"]).select(
        "doc_id", (F.col("begin") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32"
    )


def encoded_corpus(docs: DataFrame, tokenizer: str, path: str | None = None, end: int = 1) -> DataFrame:
    """Write all ids of ``docs`` under ``path`` (a fresh folder unless given), read them back: doc_id, start, n_tokens,
    ids_crc32."""
    path = path or scratch_path(docs.sparkSession, "token-ids")
    write_ids(docs, tokenizer, path, end)
    return checksums(docs.sparkSession, path)
