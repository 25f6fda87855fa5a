"""Benchmark decontamination: SimHash of item-sized windows, Hamming index, exact weighted-shingle similarity.

Words are runs of letters, marks and digits of any script in lower case; a shingle is five words (an item of fewer words
is one shingle).  The similarity of a window with an item is the weight of the item's shingles found in the window over
the weight of all its shingles; a shingle weighs log(1 + N / (1 + documents that hold it)), counted over all N documents.

1. Every document's shingles are looked up among the items'.  A window that shares none has similarity 0, so windows are
   placed where shingles are shared: as many words as the item has, at every start within a fifth of its size from a
   shared shingle's alignment (a window further off lacks more than a fifth of the item).
2. A 64-bit SimHash takes the votes of an item's distinct shingles, each with its weight; a window's is taken over the
   item's shingles that it holds.  A window of similarity ``least`` lacks a share 1 - least of the weight at most, so it
   can differ only in bits whose vote is no larger than that share: their number is the item's *radius*, known in advance,
   and no match lies beyond it.  The Hamming index of radius + 1 blocks returns all windows within it.
3. Candidates are compared exactly; those at ``least`` similarity or more are matches.

Items are processed in blocks bounded in number and bytes that are sent to all tasks, one pass over the documents a block.

Defined results: items and documents without words match nothing; rows that repeat a document's id are judged each on
their own and reported once per item with their best window; an item id repeated with several texts is matched by any of
them; rows with a null id of either kind are passed over in the list of matches.  The stage form decides by the text, so a
row without id is judged like any other, and of rows that share an id those without an item stay."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costlens.llm.common import blocks, forget, id_text, on_workers, prefilter, saved, small_batches
from costlens.llm.words import Words, mix, shingles_of, words_of

SHINGLE = 5
LEAST = 0.8
#: Items in one block, and bytes of their texts.
ITEM_BLOCK, ITEM_BYTES = 20_000, 16 << 20
#: Windows whose votes are added up at once.
WINDOWS = 8192
#: What stands between words.
BETWEEN = r"[^\p{L}\p{M}\p{N}]+"
_APART = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
_U = np.uint64


def signs(hashes: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of the 64 bits."""
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64) * 2 - 1


def fingerprints(votes: np.ndarray) -> np.ndarray:
    """SimHash of 64 columns of votes."""
    return np.packbits(votes > 0, axis=1, bitorder="little").view("<u8").reshape(-1)


class HammingIndex:
    """Multi-index hashing: all stored fingerprints within ``radius`` of a query."""

    def __init__(self, prints: np.ndarray, radius: int):
        if not 0 <= radius < 64:
            raise ValueError("radius must be from 0 to 63")
        self.prints, self.radius = prints, radius
        edges = np.linspace(0, 64, radius + 2).astype(int)
        self.blocks = []
        for low, high in zip(edges, edges[1:], strict=False):
            mask = _U((1 << int(high - low)) - 1)
            value = (prints >> _U(int(low))) & mask
            order = np.argsort(value, kind="stable")
            self.blocks.append((_U(int(low)), mask, value[order], order))

    def within(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, stored, distance) of all pairs within the radius, each once."""
        if not len(queries) or not len(self.prints):
            none = np.zeros(0, np.int64)
            return none, none, none
        pairs = []
        for low, mask, value, order in self.blocks:
            wanted = (queries >> low) & mask
            begin, end = np.searchsorted(value, wanted), np.searchsorted(value, wanted, "right")
            many = end - begin
            query = np.repeat(np.arange(len(queries)), many)
            place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(begin, many)
            pairs.append(query * len(self.prints) + order[place])
        both = np.unique(np.concatenate(pairs))
        query, stored = both // len(self.prints), both % len(self.prints)
        distance = np.bitwise_count(queries[query] ^ self.prints[stored]).astype(np.int64)
        near = distance <= self.radius
        return query[near], stored[near], distance[near]


class Items:
    """A block of items: their shingles in one sorted table, sizes, and, once weighed, fingerprints and radii."""

    def __init__(self, rows: list[tuple[int, str]]):
        words = words_of(pa.array([t for _, t in rows], pa.string()), _APART)
        size = np.diff(words.first)
        filled = np.flatnonzero(size > 0)
        self.ids = np.array([rows[i][0] for i in filled], np.int64)
        self.size = size[filled]
        self.k = np.minimum(self.size, SHINGLE)
        number = np.full(len(rows), -1)
        number[filled] = np.arange(len(filled))
        value, item, place = [], [], []
        for k in np.unique(self.k).tolist():
            v, d, at = shingles_of(words, k, whole_short=False)
            mine = np.isin(number[d], np.flatnonzero(self.k == k))
            value.append(v[mine])
            item.append(number[d[mine]])
            place.append(at[mine] - words.first[d[mine]])
        order = np.argsort(np.concatenate(value), kind="stable") if value else np.zeros(0, int)
        value, item, place = (np.concatenate(x)[order] if x else np.zeros(0, np.int64) for x in (value, item, place))
        self.value, at = np.unique(value, return_index=True)  # distinct shingles
        self.first, self.item, self.place = np.append(at, len(value)), item, place
        self.table = np.zeros(1 << 20, bool)
        self.table[(self.value.astype(np.uint64) & _U((1 << 20) - 1)).astype(np.int64)] = True
        by_item = np.argsort(item, kind="stable")
        self.own = np.repeat(np.arange(len(self.value)), np.diff(self.first))[by_item]  # shingles, item by item
        self.own_first = np.searchsorted(item[by_item], np.arange(len(self.ids) + 1))

    def shingles(self, i: int) -> np.ndarray:
        """Numbers of the distinct shingles of item ``i``."""
        return np.unique(self.own[self.own_first[i] : self.own_first[i + 1]])

    def weigh(self, weight: np.ndarray, least: float) -> None:
        """Fingerprints of all items, and the bits that a window of similarity ``least`` may have off."""
        self.weight, self.sign = weight, signs(mix(self.value.astype(np.uint64)))
        votes, self.whole = np.zeros((len(self.ids), 64)), np.zeros(len(self.ids))
        for i in range(len(self.ids)):
            own = self.shingles(i)
            votes[i], self.whole[i] = weight[own] @ self.sign[own], weight[own].sum()
        self.prints = fingerprints(votes)
        self.radius = (np.abs(votes) <= ((1 - least) * self.whole * (1 + 1e-9))[:, None]).sum(axis=1)

    def __len__(self) -> int:
        return len(self.ids)

    def hits(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the distinct shingle, text, place among the block's words) wherever an item's shingle occurs."""
        number, doc, place = [], [], []
        for k in np.unique(self.k).tolist():
            v, d, at = shingles_of(words, k, whole_short=False)
            maybe = np.flatnonzero(self.table[(v & _U((1 << 20) - 1)).astype(np.int64)])
            where = np.searchsorted(self.value, v[maybe])
            same = self.value[np.minimum(where, len(self.value) - 1)] == v[maybe]
            number.append(where[same])
            doc.append(d[maybe[same]])
            place.append(at[maybe[same]])
        return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (number, doc, place))


def _seeds(items: Items):
    """(doc_id, distinct item shingles found) of the documents that share any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for block in blocks(batches):
            number, doc, _ = items.hits(words_of(block.column("text"), _APART))
            if not len(doc):
                continue
            pair = np.unique(doc * len(items.value) + number)
            doc, number = pair // len(items.value), pair % len(items.value)
            own, begin = np.unique(doc, return_index=True)
            found = pa.ListArray.from_arrays(pa.array(np.append(begin, len(doc)), pa.int32()), pa.array(number.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([block.column("doc_id").take(pa.array(own)), found], names=["doc_id", "shingles"])

    return run


def held_by_windows(starts: np.ndarray, reach: int, spot: np.ndarray, shingle: np.ndarray, gains: np.ndarray) -> np.ndarray:
    """For each window (start s, shingles at s to s + reach), the sum of ``gains`` over its distinct shingles.

    A shingle at ``spot`` counts for the windows in which it is the last one of its kind, which are an interval of starts;
    the intervals' ends are added up."""
    order = np.lexsort((spot, shingle))
    spot, shingle, gains = spot[order], shingle[order], gains[order]
    following = np.append(spot[1:], 0)
    following = np.where(np.append(shingle[1:] == shingle[:-1], False), following, np.iinfo(np.int64).max)
    begin = np.searchsorted(starts, spot - reach, side="left")
    end = np.searchsorted(starts, np.minimum(spot, following - reach - 1), side="right")
    used = begin < end
    steps = np.zeros((len(starts) + 1, gains.shape[1]))
    np.add.at(steps, begin[used], gains[used])
    np.add.at(steps, end[used], -gains[used])
    return np.cumsum(steps[:-1], axis=0)


def match(words: Words, doc: int, number: np.ndarray, place: np.ndarray, items: Items, index: list, least: float) -> list[tuple]:
    """(item number, similarity, distance, start, size) of the best window of every matching item in one text."""
    begin, end = int(words.first[doc]), int(words.first[doc + 1])
    many = items.first[number + 1] - items.first[number]
    at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(items.first[number], many)
    item, off = items.item[at], items.place[at]
    hit, spot = np.repeat(number, many), np.repeat(place - begin, many)
    order = np.argsort(item, kind="stable")
    item, off, hit, spot = item[order], off[order], hit[order], spot[order]
    found = []
    for i, a in zip(*(x.tolist() for x in np.unique(item, return_index=True)), strict=True):
        z = int(np.searchsorted(item, i, side="right"))
        own, at_word = hit[a:z], spot[a:z]
        if items.weight[np.unique(own)].sum() < least * items.whole[i] * (1 - 1e-9):
            continue  # the whole text holds too little of the item
        size, k = int(items.size[i]), int(items.k[i])
        slack, last, width = size // 5, max(0, end - begin - size), min(size, end - begin)
        aligned = np.unique(at_word - off[a:z])
        starts = np.unique(np.clip((aligned[:, None] + np.arange(-slack, slack + 1)).ravel(), 0, last))
        at_word, own = np.divmod(np.unique(at_word * len(items.value) + own), len(items.value))
        gains = items.weight[own][:, None] * np.hstack([items.sign[own], np.ones((len(own), 1))])
        best = None
        for w in range(0, len(starts), WINDOWS):
            part = starts[w : w + WINDOWS]
            near = (at_word >= part[0]) & (at_word <= part[-1] + width - k)
            sums = held_by_windows(part, width - k, at_word[near], own[near], gains[near])
            places, distance = _candidates(index, items, i, fingerprints(sums[:, :64]))
            if not len(places):
                continue
            similar = sums[places, 64]
            top = similar >= similar.max() - 1e-9 * items.whole[i]  # ties but for rounding
            d, s = min(zip(distance[top].tolist(), part[places[top]].tolist(), strict=True))
            inside = (at_word >= s) & (at_word <= s + width - k)
            exact = float(items.weight[np.unique(own[inside])].sum() / items.whole[i])
            if best is None or (-exact, d, s) < best:
                best = (-exact, d, s)
        if best and -best[0] >= least:
            found.append((i, -best[0], best[1], best[2], width))
    return found


def _candidates(index: list, items: Items, i: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows within the item's radius, and their distances."""
    if items.radius[i] >= 64:
        return np.arange(len(prints)), np.bitwise_count(prints ^ items.prints[i]).astype(np.int64)
    if index[i] is None:
        index[i] = HammingIndex(items.prints[i : i + 1], int(items.radius[i]))
    windows, _, distance = index[i].within(prints)
    return windows, distance


MATCHES = "doc_id long, item_id long, similarity double, distance long, start long, n_words long"


def _windows(items: Items, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: list[HammingIndex | None] = [None] * len(items)
        for block in blocks(batches):
            words = words_of(block.column("text"), _APART)
            number, doc, place = items.hits(words)
            order = np.argsort(doc, kind="stable")
            number, doc, place = number[order], doc[order], place[order]
            ids, out = block.column("doc_id").to_pylist(), []
            for d in np.unique(doc).tolist():
                a, b = np.searchsorted(doc, [d, d + 1])
                out += [(ids[d], int(items.ids[i]), *rest) for i, *rest in match(words, d, number[a:b], place[a:b], items, index, least)]
            if out:
                cols = list(zip(*out, strict=True))
                types = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "item_id", "similarity", "distance", "start", "n_words"]
                )

    return run


def plain_words(text: Column) -> Column:
    """Words in lower case, a blank between them; null as empty."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), BETWEEN, " ")


def matches(docs: DataFrame, benchmark: DataFrame, least: float = LEAST, item_block: int = ITEM_BLOCK) -> DataFrame:
    """One row per document and item that it contains: doc_id, item_id, similarity, distance (Hamming), start and n_words
    of the best window, in words."""
    spark = docs.sparkSession
    small_batches(spark)
    on_workers(spark)
    texts = id_text(docs).filter("doc_id is not null").withColumn("text", plain_words(F.col("text")))
    table = benchmark.select(F.col("item_id").cast("long").alias("item_id"), plain_words(F.col("text")).alias("text"))
    table = table.filter("item_id is not null and text not in ('', ' ')").distinct()
    many, size = table.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    total, parts = texts.count(), max(1, math.ceil(many / item_block), math.ceil(size / ITEM_BYTES))
    out = spark.createDataFrame([], MATCHES)
    for part in range(parts):
        rows = table.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).collect()
        items = Items(sorted((r["item_id"], r["text"]) for r in rows))
        if not len(items):
            continue
        seeds = saved(texts.mapInArrow(_seeds(items), "doc_id long, shingles array<int>"), "decontaminate-seeds")
        held = seeds.select(F.explode("shingles").alias("number")).groupBy("number").agg(F.count("*").alias("n")).collect()
        found = np.zeros(len(items.value))
        for r in held:  # at most one row for each of this block's shingles
            found[r["number"]] = r["n"]
        items.weigh(np.log1p(total / (1 + found)), least)
        seeded = prefilter(texts, seeds.select("doc_id"))
        out = out.unionByName(seeded.mapInArrow(_windows(items, least), MATCHES))
    best = F.min(F.struct((-F.col("similarity")).alias("a"), "distance", "start", "n_words")).alias("best")
    one = out.groupBy("doc_id", "item_id").agg(best)
    return one.select("doc_id", "item_id", (-F.col("best.a")).alias("similarity"), "best.distance", "best.start", "best.n_words")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Stage form: the rows of ``docs``, all their columns, whose text contains no item."""
    key, columns = "_text_key", [F.col(f"`{c}`") for c in docs.columns]
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.withColumn(key, F.xxhash64(text, F.length(text)))
    found = matches(keyed.select(F.col(key).alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias(key)).distinct()
    # few texts hold an item: Spark broadcasts them below its threshold, else a shuffle in which skewed keys are split
    return keyed.join(saved(found, "decontaminate-found"), key, "left_anti").select(*columns)
