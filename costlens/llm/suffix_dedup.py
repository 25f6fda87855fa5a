"""Removal of long repeated byte strings with a sparse, range-partitioned suffix array.

A byte goes if it is covered by a ``length``-byte window that also starts anywhere else (same document included).  Nine
hundred million suffixes of ``length`` bytes are not shuffled; the array is sparse instead, without losing a match:

1. *Anchors.*  Every window selects a position from its own bytes alone: the least hash of ``gram`` bytes among its first
   ``reach`` positions.  Equal windows select the same place, so a window repeats exactly if some other anchor has the
   same window around it.  Neighbouring windows share anchors: one suffix stands for about ``reach`` / 2 windows.
2. *Unique leads go.*  The ``lead`` bytes from an anchor on lie in each of its windows.  Leads that occur once in the
   corpus (counted by their hash, with map-side sums) need no further look; a fixed-size bitmap of the others selects
   the anchors whose context (bytes of all their windows) is written.  Equal contexts are counted by grouping on bytes.
3. *Sampled splitters* cut the contexts into ranges of the suffix's leading bytes (Spark's range partitioning, whose
   sample has a fixed bound); a task takes its range in order and closes a bucket at the first new lead after
   ``bucket_rows`` rows, so its memory depends on neither the ranges nor their number.  A bucket sorts its suffixes by
   multikey quicksort, eight bytes a key, and so the reversed text left of the anchors; common prefix lengths of
   neighbours then give, for every distance of the window's start from the anchor, which windows are equal.
4. *Across boundaries.*  Rows of one lead are ranged by the context's name, so a lead of any size is dealt over many
   ranges.  A range's first and last lead may go on in its neighbours: those are dealt once more, each lead whole, to
   buckets.  The windows of a lead that holds more rows than a bucket are compared across ranges by 128-bit digests,
   summed up before the shuffle.
5. Repeated windows are gathered per document, and the bytes they cover are cut out.

Defined results: a null text counts as empty; texts shorter than ``length`` lose nothing; rows that repeat a ``doc_id``
are documents of their own (equal ones repeat one another wholly); a null ``doc_id`` is kept."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costlens.llm.common import BATCH_ROWS, Bitmap, blocks, forget, id_text, on_workers, saved, small_batches
from costlens.llm.words import mix

LENGTH = 200
#: Contexts that a bucket holds, about, and the ranges that they are dealt to at most (a range holds any number of buckets).
BUCKET_ROWS, MOST_RANGES = 30_000, 20_000
#: Texts are taken in pieces of at most this many bytes (overlapping by a window), so that positions fit their bits.
PIECE = 1 << 24
_POSITION = 26
_U = np.uint64
_B = _U(0x9E3779B97F4A7C15)


class Shape:
    """Sizes derived from the window length."""

    def __init__(self, length: int):
        self.length = length
        self.gram = max(1, length // 12)
        self.lead = max(self.gram, length * 61 // 200)
        self.reach = length - self.lead + 1


def window_hash(data: np.ndarray, size: int) -> np.ndarray:
    """Polynomial hash of the ``size`` bytes from every position on, by doubling."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, span, part = _B, 1, _BYTES[data]
    out, done = None, 0
    rest = size
    while rest:
        if rest & 1:
            here = part[done : done + n]
            out = here.copy() if out is None else out * power + here
            done += span
        rest >>= 1
        if rest:
            part = part[: len(part) - span] * power + part[span:]
            power, span = power * power, span * 2
    return mix(out)


_BYTES = np.random.default_rng(77).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)


def sliding_min(value: np.ndarray, size: int) -> np.ndarray:
    """Minimum of ``size`` values from every position on."""
    had = 1
    while had < size:
        step = min(had, size - had)
        value = np.minimum(value[: len(value) - step], value[step:])
        had += step
    return value


def anchors(data: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, last window) in one text: the windows of an anchor are neighbours."""
    many = len(data) - shape.length + 1
    if many <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    h = window_hash(data, shape.gram)
    packed = (h >> _U(_POSITION) << _U(_POSITION)) | np.arange(len(h), dtype=np.uint64)
    chosen = (sliding_min(packed, shape.reach)[:many] & _U((1 << _POSITION) - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
    return chosen[first], first, np.append(first[1:], many) - 1


def _pieces(text: bytes, shape: Shape) -> Iterator[tuple[int, np.ndarray]]:
    data = np.frombuffer(text, np.uint8)
    step = PIECE - shape.length + 1
    for at in range(0, max(1, len(data) - shape.length + 1), step):
        yield at, data[at : at + PIECE]


def _texts(block: pa.RecordBatch) -> list[bytes]:
    return block.column("text").cast(pa.binary()).to_pylist()


def _together(texts: list[bytes], shape: Shape) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Anchors of many short texts at once, of long ones piece by piece:
    (bytes, text of each anchor, where its text begins in the bytes, anchor, first, last) - positions in the bytes."""
    short = [i for i, t in enumerate(texts) if shape.length <= len(t) <= PIECE // 8]
    group, size = [], 0
    groups = []
    for i in short:
        group.append(i)
        size += len(texts[i])
        if size > 1 << 20:
            groups.append(group)
            group, size = [], 0
    if group:
        groups.append(group)
    for group in groups:
        data = np.frombuffer(b"".join(texts[i] for i in group), np.uint8)
        length = np.array([len(texts[i]) for i in group])
        end = np.cumsum(length)
        a, lo, hi = anchors(data, shape)
        # windows that reach over a text's end are cut off
        own = np.searchsorted(end, lo, "right")
        last = end[own] - shape.length
        over = hi > last
        more = np.flatnonzero(over & (hi >= end[own]))  # such an anchor's windows go on in the next text
        extra_lo = end[own[more]]
        a2, own2 = a[more], own[more] + 1
        hi2 = np.minimum(hi[more], end[np.minimum(own2, len(end) - 1)] - shape.length)
        hi = np.minimum(hi, last)
        a, lo, hi, own = np.concatenate([a, a2]), np.concatenate([lo, extra_lo]), np.concatenate([hi, hi2]), np.concatenate([own, own2])
        ok = (hi >= lo) & (a >= lo) & (own < len(end))
        # an anchor chosen for a window inside its text lies inside it too
        yield data, np.array(group)[own[ok]], (end - length)[own[ok]], a[ok], lo[ok], hi[ok]
    for i, t in enumerate(texts):
        if len(t) > PIECE // 8:
            for at, data in _pieces(t, shape):
                a, lo, hi = anchors(data, shape)
                yield data, np.full(len(a), i), np.full(len(a), -at), a, lo, hi


def _lead_keys(data: np.ndarray, a: np.ndarray, shape: Shape) -> np.ndarray:
    return window_hash(data, shape.lead)[a]


def _keys(shape: Shape):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            for data, _, _, a, _, _ in _together(_texts(block), shape):
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(_lead_keys(data, a, shape).view(np.int64))], names=["key"])

    return run


CONTEXT = "doc_id long, h long, first long, left int, context binary"


def _contexts(shape: Shape, bitmap: Bitmap):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            ids, hs = block.column("doc_id"), block.column("h")
            for data, doc, base, a, lo, hi in _together(_texts(block), shape):
                hit = np.flatnonzero(bitmap.has(_lead_keys(data, a, shape))) if len(a) else a
                if not len(hit):
                    continue
                raw = data.tobytes()
                cut = [raw[i:j] for i, j in zip(lo[hit].tolist(), (hi[hit] + shape.length).tolist(), strict=True)]
                at = pa.array(doc[hit])
                yield pa.RecordBatch.from_arrays(
                    [ids.take(at), hs.take(at), pa.array(lo[hit] - base[hit]), pa.array((a - lo)[hit], pa.int32()), pa.array(cut, pa.binary())],
                    names=["doc_id", "h", "first", "left", "context"],
                )

    return run


def multikey_sort(rows: np.ndarray) -> np.ndarray:
    """Order of byte rows (n, width), most significant eight bytes first; each round sorts only what is still tied."""
    n, width = rows.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = rows
    keys = padded.view(">u8").astype(np.uint64)
    order, group = np.arange(n), np.zeros(n, np.int64)  # group: rank of the tied run that a place belongs to
    open_ = np.arange(n)  # places not settled yet
    for k in range(keys.shape[1]):
        if len(open_) < 2:
            break
        value = keys[order[open_], k]
        sort = np.lexsort((value, group[open_]))
        order[open_] = order[open_[sort]]
        value, g = value[sort], group[open_]
        new = np.concatenate([[True], (value[1:] != value[:-1]) | (g[1:] != g[:-1])])
        group[open_] = open_[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
        size = np.diff(np.append(np.flatnonzero(new), len(new)))
        open_ = open_[np.repeat(size > 1, size)]
    return order


def shared_prefix(rows: np.ndarray, order: np.ndarray, chunk: int = 4096) -> np.ndarray:
    """Bytes that a row shares with the one before it in ``order`` (the first with none)."""
    out = np.zeros(len(order), np.int64)
    for at in range(1, len(order), chunk):
        now = order[at : at + chunk]
        differ = rows[now] != rows[order[at - 1 : at - 1 + len(now)]]
        out[at : at + len(now)] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return out


def repeated_windows(left: np.ndarray, contexts: list[bytes], held: np.ndarray, shape: Shape) -> np.ndarray:
    """For distinct contexts held by so many anchors each: (context, window) is repeated, as a matrix."""
    n, length, reach = len(contexts), shape.length, shape.reach
    out = np.zeros((n, reach), bool)
    right, reverse = np.zeros((n, length), np.uint8), np.zeros((n, reach), np.uint8)
    span = np.array([len(c) - length for c in contexts], np.int64)
    for i, c in enumerate(contexts):
        row, cut = np.frombuffer(c, np.uint8), int(left[i])
        right[i, : len(row) - cut] = row[cut:]
        reverse[i, :cut] = row[:cut][::-1]
    by_right, by_left = multikey_sort(right), multikey_sort(reverse)
    lcp_right, lcp_left = shared_prefix(right, by_right), shared_prefix(reverse, by_left)
    class_right, class_left = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(reach):  # windows that begin o bytes before their anchor
        part = np.flatnonzero((left - span <= o) & (o <= left))
        if len(part) == 0:
            continue
        class_right[by_right] = np.cumsum(lcp_right < length - o)
        class_left[by_left] = np.cumsum(lcp_left < o) if o else 0
        key = class_right[part] * (n + 1) + class_left[part]
        sort = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], key[sort][1:] != key[sort][:-1]]))
        total = np.add.reduceat(held[part][sort], first)
        again = np.repeat(total > 1, np.diff(np.append(first, len(sort))))
        mine = part[sort][again]
        out[mine, left[mine] - o] = True
    return out


def _runs(flags: np.ndarray) -> list[list[int]]:
    """[begin, end) pairs of set places, one after another, for each row."""
    edge = np.diff(np.pad(flags, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, place = np.nonzero(edge)
    cuts = np.searchsorted(row, np.arange(len(flags) + 1)).tolist()
    place = place.tolist()
    return [place[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]


FOUND = "context_id binary, runs array<int>, left int, held long, context binary"


def _found(ids: list[bytes], runs: list[list[int]]) -> pa.RecordBatch:
    none = [pa.nulls(len(ids), t) for t in (pa.int32(), pa.int64(), pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(runs, pa.list_(pa.int32())), *none], names=_FOUND)


def _passed_on(rows: list[tuple]) -> pa.RecordBatch:
    ids, left, held, context = zip(*rows, strict=True)
    cols = [pa.array(ids, pa.binary()), pa.nulls(len(rows), pa.list_(pa.int32())), pa.array(left, pa.int32()), pa.array(held, pa.int64()), pa.array(context, pa.binary())]
    return pa.RecordBatch.from_arrays(cols, names=_FOUND)


_FOUND = ["context_id", "runs", "left", "held", "context"]


def _buckets(shape: Shape, bucket_rows: int, whole: bool = False):
    """Rows (context_id, left, held, context) in the order of their leads: the repeated windows of each bucket, and, with
    null runs, the rows whose leads have to be compared across ranges (none if all leads are ``whole``, and fit)."""

    def close(rows: list[tuple]) -> list[pa.RecordBatch]:
        if not rows:
            return []
        flags = repeated_windows(np.array([r[1] for r in rows], np.int64), [r[3] for r in rows], np.array([r[2] for r in rows], np.int64), shape)
        runs = _runs(flags)
        some = [i for i, r in enumerate(rows) if r[2] == 1 and runs[i]]  # contexts held twice are repeated as a whole
        return [_found([rows[i][0] for i in some], [runs[i] for i in some])] if some else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        bucket: list[tuple] = []
        now, same, across = None, [], not whole  # the lead at hand, its rows, whether they are passed on
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("context_id", "left", "held", "context")]
            for row in zip(*cols, strict=True):
                lead = row[3][row[1] : row[1] + shape.lead]
                if lead != now:
                    if across and same:
                        yield _passed_on(same)
                    elif len(same) > 1:  # a lead with a single context has nothing to be compared with
                        bucket += same
                        if len(bucket) >= bucket_rows:
                            yield from close(bucket)
                            bucket = []
                    now, same, across = lead, [], now is None and not whole
                same.append(row)
                if not whole and (len(same) > bucket_rows or (across and len(same) >= BATCH_ROWS)):
                    yield _passed_on(same)
                    same, across = [], True
        if whole:
            bucket += same
        elif same:
            yield _passed_on(same)
        yield from close(bucket)

    return run


def _window_digests(shape: Shape):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                ids, helds, places, digests = [], [], [], []
                cols = [part.column(c).to_pylist() for c in ("context_id", "left", "held", "context")]
                for name, left, held, context in zip(*cols, strict=True):
                    for j in range(len(context) - shape.length + 1):
                        ids.append(name)
                        helds.append(held)
                        places.append(j)
                        digests.append(hashlib.md5(b"%d:" % (left - j) + context[j : j + shape.length]).digest())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.binary()), pa.array(helds, pa.int64()), pa.array(places, pa.int32()), pa.array(digests, pa.binary())],
                    names=["context_id", "held", "place", "digest"],
                )

    return run


def _compared(bitmap: Bitmap):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = batch.filter(pa.array(bitmap.has(batch.column("code").to_numpy(zero_copy_only=False))))
            if out.num_rows:
                yield out.select(["context_id", "left", "held", "context"])

    return run


def repeated_contexts(contexts: DataFrame, shape: Shape, bucket_rows: int) -> DataFrame:
    """context_id, runs: repeated windows of the distinct contexts (context_id, left, held, context)."""
    lead = F.substring("context", F.col("left") + 1, F.lit(shape.lead))
    coded = contexts.withColumn("code", F.xxhash64(lead))
    # a lead with a single context has nothing to be compared with
    several = saved(coded.groupBy("code").agg(F.count("*").alias("n")).filter("n > 1"), "suffix-several")
    contexts = coded.mapInArrow(_compared(Bitmap(several.select("code"))), "context_id binary, left int, held long, context binary")
    total = several.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    ranges = min(MOST_RANGES, max(1, math.ceil(total / bucket_rows)))
    ordered = contexts.repartitionByRange(ranges, lead, "context_id").sortWithinPartitions(lead, "context_id")
    joined = saved(ordered.mapInArrow(_buckets(shape, bucket_rows), FOUND), "suffix-buckets")
    local = joined.filter("runs is not null").select("context_id", "runs")
    passed = joined.filter("runs is null").select("context_id", "left", "held", "context", F.xxhash64(lead).alias("code"))
    # few leads have more rows than a bucket: Spark broadcasts them below its threshold, else it splits skewed keys
    hot = saved(passed.groupBy("code").agg(F.count("*").alias("n")).filter(F.col("n") > bucket_rows).select("code"), "suffix-hot")
    split = passed.join(hot, "code", "left_anti").repartition(ranges, "code").sortWithinPartitions(lead)
    local = local.unionByName(split.drop("code").mapInArrow(_buckets(shape, bucket_rows, whole=True), FOUND).select("context_id", "runs"))
    across = passed.join(hot, "code", "left_semi").drop("code")
    across = across.mapInArrow(_window_digests(shape), "context_id binary, held long, place int, digest binary")
    across = saved(across, "suffix-across")
    again = across.groupBy("digest").agg(F.sum("held").alias("n")).filter("n > 1").select("digest")
    places = across.filter("held = 1").join(again, "digest").groupBy("context_id").agg(F.collect_list("place").alias("p"))
    return local.unionByName(places.select("context_id", F.flatten(F.transform("p", lambda p: F.array(p, p + 1))).alias("runs")))


def _cut(length: int):
    """Rows with their repeated windows: what remains of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            cols = [batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "sha", "text", "begins", "ends")]
            for doc, n, sha, text, begins, ends in zip(*cols, strict=True):
                if not begins:
                    out.append((doc, n, 0, 0, sha))
                    continue
                data = np.frombuffer(text.encode(), np.uint8)
                edge = np.zeros(n + 1, np.int64)
                np.add.at(edge, begins, 1)
                np.add.at(edge, np.array(ends) + length - 1, -1)  # windows begin .. end - 1
                gone = np.cumsum(edge[:-1]) > 0
                spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                out.append((doc, n, int(gone.sum()), spans, hashlib.sha256(data[~gone].tobytes()).hexdigest()))
            cols = list(zip(*out, strict=True))
            types = [pa.int64()] * 4 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def _flagged(bitmap: Bitmap):
    """Digest of every text; the text itself only where it may have repeated windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            hit = bitmap.has(block.column("code").to_numpy(zero_copy_only=False)).tolist()
            raw = _texts(block)
            texts = [t.decode() if k else None for t, k in zip(raw, hit, strict=True)]
            shas = [hashlib.sha256(t).hexdigest() for t in raw]
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), block.column("h"), pa.array([len(t) for t in raw], pa.int64()), pa.array(shas), pa.array(texts, pa.string())],
                names=["doc_id", "h", "n_bytes", "sha", "text"],
            )

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of ``docs``."""
    spark = docs.sparkSession
    small_batches(spark)
    on_workers(spark)
    shape = Shape(length)
    texts = id_text(docs).withColumn("h", F.xxhash64("text"))
    keys = texts.select("doc_id", "text").mapInArrow(_keys(shape), "key long")
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    bitmap = Bitmap(saved(shared.select(F.col("key").alias("code")), "suffix-leads"))
    named = F.unhex(F.md5(F.concat(F.concat("left", F.lit(":")).cast("binary"), "context")))
    places = saved(texts.mapInArrow(_contexts(shape, bitmap), CONTEXT).withColumn("context_id", named), "suffix-contexts")
    distinct = places.groupBy("left", "context").agg(F.count("*").alias("held")).withColumn("context_id", named)
    distinct = saved(distinct.select("context_id", "left", "held", "context"), "suffix-distinct")
    runs = repeated_contexts(distinct, shape, bucket_rows)
    whole = distinct.filter("held > 1").select("context_id", F.array(F.lit(0), (F.octet_length("context") - (length - 1)).cast("int")).alias("runs"))
    found = saved(runs.unionByName(whole), "suffix-runs")
    at = F.posexplode("runs").alias("i", "edge")
    spots = places.select("doc_id", "h", "first", "context_id").join(found, "context_id").select("doc_id", "h", "first", at)
    edge = F.col("first") + F.col("edge")
    per = spots.groupBy("doc_id", "h").agg(
        F.collect_list(F.when(F.col("i") % 2 == 0, edge)).alias("begins"), F.collect_list(F.when(F.col("i") % 2 == 1, edge)).alias("ends")
    )
    per = saved(per, "suffix-documents")
    code = F.xxhash64("doc_id", "h").alias("code")
    rows = texts.select("doc_id", "h", "text", code).mapInArrow(
        _flagged(Bitmap(per.select(code))), "doc_id long, h long, n_bytes long, sha string, text string"
    )
    same = rows["doc_id"].eqNullSafe(per["doc_id"]) & (rows["h"] == per["h"])
    joined = rows.join(per, same, "left").select(rows["doc_id"], "n_bytes", "sha", "text", "begins", "ends")
    return joined.mapInArrow(_cut(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
