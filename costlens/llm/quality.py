"""Quality: regularised quadratic discriminant on statistics of documents.

Every text gives a vector of statistics on logarithmic scales.  Per class, the mean and the covariance of a bounded
sample of labelled documents (``rows``) are taken; the covariance is shrunk towards the pooled one (``pool``) and towards
a multiple of the identity (``ridge``), and its Cholesky factor is computed once and kept in the model.  A score is the
logistic of the difference of the classes' Gaussian log densities (Mahalanobis distances through the factors, and their
log determinants) and log priors.

Defined results: a null text counts as empty (its statistics are those of no words); labels other than 0 and 1, and
labels without a document, are passed over; without labels of both classes every score is the base rate (0 without any
label); every row has its row in the result."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costlens.llm.common import TRAIN_ROWS, blocks, held_out, id_text, labelled_sample, on_workers, small_batches
from costlens.llm.words import text_bytes, words_of

FOLDS, HELD = 4, 2
THRESHOLD = 0.7
POOL, RIDGE = 0.1, 0.02
_MARKS = {
    "letters": [*range(65, 91), *range(97, 123), *range(128, 256)],
    "upper": [*range(65, 91)],
    "digits": [*range(48, 58)],
    "stops": [*b".,;:?'"],
    "cries": [*b"!"],
    "marks": [*b"\"#$%&()*+-/<=>@[\\]^_`{|}~"],
    "lines": [10],
}
NAMES = ("words", "length", "marks", "upper", "bare", "twice", "variety", "digits", "stops", "lines", "cries", "decorated")


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.log((part + 0.5) / (whole + 1.0))


def statistics(column: pa.Array) -> np.ndarray:
    """One row of ``NAMES`` per text, the empty text included."""
    n = len(column)
    if not n:
        return np.zeros((0, len(NAMES)))
    data, base = text_bytes(column)
    words = words_of(column)
    count = {}
    for name, codes in _MARKS.items():
        table = np.zeros(256, np.int64)
        table[codes] = 1
        count[name] = np.add.reduceat(table[data], base[:-1])
    count["lines"] -= 1  # the one that text_bytes adds
    many = np.diff(words.first).astype(float)
    doc, h = words.doc, words.hashes
    same = np.flatnonzero((h[1:] == h[:-1]) & (doc[1:] == doc[:-1]))
    twice = np.bincount(doc[same], minlength=n)
    order = np.lexsort((h, doc))
    hs, ds = h[order], doc[order]
    new = np.ones(len(hs), bool)
    new[1:] = (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1])
    distinct = np.bincount(ds[new], minlength=n)
    table = np.zeros(256, np.int64)
    table[_MARKS["letters"] + _MARKS["digits"]] = 1
    plain = np.concatenate([[0], np.cumsum(table[data])])
    odd = np.zeros(256, np.int64)
    odd[_MARKS["marks"] + _MARKS["cries"]] = 1
    odd = np.concatenate([[0], np.cumsum(odd[data])])
    bare = np.bincount(doc[plain[words.end] == plain[words.start]], minlength=n)
    decorated = np.bincount(doc[odd[words.end] > odd[words.start]], minlength=n)
    size = np.diff(base) - 1
    return np.column_stack([
        np.log1p(many),
        np.log((words_length(words, n) + 1) / (many + 1)),
        _share(count["marks"], size),
        _share(count["upper"], count["letters"]),
        _share(bare, many),
        _share(twice, many),
        np.log((distinct + 1) / (many + 1)),
        _share(count["digits"], size),
        _share(count["stops"], many),
        _share(count["lines"], many),
        _share(count["cries"], many),
        _share(decorated, many),
    ])


def words_length(words, n: int) -> np.ndarray:
    return np.bincount(words.doc, words.end - words.start, n)


@dataclass
class Model:
    """Per class: mean, inverse Cholesky factor, constant of the log density with the log prior; a base rate instead
    where a class has no rows."""

    means: np.ndarray
    factors: list
    constants: list
    base: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.base is not None:
            return np.full(len(x), self.base)
        density = [c - 0.5 * np.sum(((x - m) @ f.T) ** 2, axis=1) for m, f, c in zip(self.means, self.factors, self.constants, strict=True)]
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0], -50, 50)))


def solve(x: np.ndarray, y: np.ndarray, pool: float = POOL, ridge: float = RIDGE) -> Model:
    """The model of statistics ``x`` and labels ``y``."""
    if not (y == 1).any() or not (y == 0).any():
        return Model(np.zeros(0), [], [], float(y.mean()) if len(y) else 0.0)
    width = x.shape[1]
    means = np.array([x[y == k].mean(axis=0) for k in (0, 1)])
    spread = [(x[y == k] - means[k]).T @ (x[y == k] - means[k]) / max(1, (y == k).sum()) for k in (0, 1)]
    pooled = sum(s * (y == k).mean() for k, s in enumerate(spread))
    factors, constants = [], []
    for k in (0, 1):
        mixed = (1 - pool) * spread[k] + pool * pooled
        mixed = (1 - ridge) * mixed + (ridge * np.trace(mixed) / width + 1e-6) * np.eye(width)
        lower = np.linalg.cholesky(mixed)
        factors.append(np.linalg.inv(lower))
        constants.append(float(np.log((y == k).mean()) - np.log(np.diag(lower)).sum()))
    return Model(means, factors, constants)


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches):
        x = statistics(block.column("text"))
        rows = [r.tobytes() for r in np.ascontiguousarray(x)]
        yield pa.RecordBatch.from_arrays([block.column("doc_id"), block.column("label"), pa.array(rows, pa.binary())], names=["doc_id", "label", "x"])


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, pool: float = POOL, ridge: float = RIDGE, column: str = "quality") -> Model:
    """Learn from the labelled documents outside the held-out fold: at most ``rows`` vectors reach the driver."""
    small_batches(docs.sparkSession)
    on_workers(docs.sparkSession)
    sample = labelled_sample(docs, labels, column, FOLDS, HELD, rows)
    found = sample.mapInArrow(_labelled, "doc_id long, label int, x binary").collect()
    found.sort(key=lambda r: (r["doc_id"], r["x"]))  # one sum order whatever the partitions
    x = np.array([np.frombuffer(r["x"]) for r in found]).reshape(-1, len(NAMES))
    return solve(x, np.array([r["label"] for r in found], int), pool, ridge)


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    small_batches(docs.sparkSession)
    on_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            score = model.score(statistics(block.column("text")))
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(score, pa.float64())], names=["doc_id", "score"])

    rows = id_text(docs).mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", held_out(FOLDS, HELD).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
