"""Words and word shingles of many texts at once, as 64-bit numbers (numpy).

A word is a run of bytes other than space and 0x09-0x0D, with A-Z lower-cased.
It is hashed as a polynomial over a random value per byte; a shingle of ``k``
words combines its words' hashes by position.  Equal words always get equal
numbers; different ones collide with a chance near 2**-64 a pair."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_U = np.uint64
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = _BYTE[_LOWER]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: All of ASCII but letters: for words without punctuation and digits.
NOT_LETTERS = np.array([c < 128 and not chr(c).isalpha() for c in range(256)])
_BASE = _U(0x9E3779B97F4A7C15)
_STEP = _U(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the word."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@dataclass
class Words:
    """Words of a block: hash, index of the text, byte range in ``buffer``; ``first[i]:first[i + 1]`` are text i's."""

    hashes: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    base: np.ndarray  # where each text's bytes begin


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, each followed by a line feed, and where each begins."""
    parts = [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]
    lengths = np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts))
    base = np.concatenate([[0], np.cumsum(lengths)])
    return np.frombuffer(b"\n".join(parts) + b"\n", np.uint8) if parts else np.zeros(0, np.uint8), base


def words_of(column: pa.Array, apart: np.ndarray = _SPACE) -> Words:
    """``apart``: for every byte, whether it separates words (the line feed must)."""
    data, base = text_bytes(column)
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(none.astype(np.uint64), none, none, none, np.zeros(len(base), np.int64), base)
    inside = ~apart[data]
    edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=np.int8(0)))
    start, end = edge[::2], edge[1::2]  # the last byte is a line feed, so every word ends
    first = np.searchsorted(start, base)
    doc = np.repeat(np.arange(len(base) - 1), np.diff(first))
    if not len(start):
        return Words(np.zeros(0, np.uint64), doc, start, end, first, base)
    length = end - start
    power = np.cumprod(np.concatenate([[_U(1)], np.full(int(length.max()), _BASE)]))
    at = np.flatnonzero(inside)
    offset = np.cumsum(length) - length
    place = np.arange(len(at)) - np.repeat(offset, length)
    hashes = mix(np.add.reduceat(_BYTE[data[at]] * power[place], offset) + length.astype(np.uint64))
    return Words(hashes, doc, start, end, first, base)


def shingles_of(words: Words, k: int, whole_short: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, index of the text, index of the first word) of every ``k``-word shingle in order.  A text of 1 to
    k - 1 words has its whole sequence as one shingle if ``whole_short``, else none."""
    h, first = words.hashes, words.first
    count = np.diff(first)
    n = len(h)
    if not n:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none
    whole = max(n - k + 1, 0)
    value = np.zeros(whole, np.uint64)
    for j in range(k):
        value = (value * _STEP) ^ mix(h[j : j + whole] + _U(j + 1))
    at = np.flatnonzero(words.doc[:whole] == words.doc[k - 1 : k - 1 + whole])
    value, doc = mix(value[at]), words.doc[at]
    short = np.flatnonzero((count > 0) & (count < k)) if whole_short else []
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            has = count[short] > j
            extra[has] = (extra[has] * _STEP) ^ mix(h[first[short][has] + j] + _U(j + 1))
        value = np.concatenate([value, mix(extra + count[short].astype(np.uint64))])
        doc, at = np.concatenate([doc, short]), np.concatenate([at, first[short]])
        order = np.argsort(doc, kind="stable")
        value, doc, at = value[order], doc[order], at[order]
    return value, doc, at


def distinct_by_doc(value: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (doc, value), sorted by doc then value."""
    if not len(value):
        return value, doc
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    new = np.concatenate([[True], (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])])
    return value[new], doc[new]
