"""Toxicity: a counterfactually regularised linear classifier on word presence.

Training uses a bounded sample of labelled documents (``rows``, 20,000 unless told otherwise).  Spark counts in how many
toxic and other documents of the sample every word occurs; the at most ``size`` words that tell most (by a chi-squared of
``CHI`` or more) and all identity terms are the features.  In every labelled sentence with an identity term the term is swapped for the others of
its group, which gives pairs of sentences that differ in nothing but the group they mention.  The loss is logistic,
plus ``l2`` |w|^2, plus ``fair`` times the mean squared change of the margin over those pairs: a mention of a group as
such cannot raise the score, while real insults beside it still do.

Scoring sees the whole text of every document.  Presence instead of frequency keeps one insult in a long text visible.

Defined results: a null text counts as empty and gets the bias's score; labels other than 0 and 1, and labels without a
document, are passed over; without labels of both classes every score is the base rate (0 without any label); every row
has its row in the result."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costlens.llm.common import TRAIN_ROWS, blocks, forget, held_out, id_text, labelled_sample, on_workers, saved, small_batches
from costlens.llm.words import NOT_LETTERS, Words, words_of

FOLDS, HELD = 3, 1
THRESHOLD = 0.7
VOCABULARY = 512
#: Least chi-squared of a feature word (chance gives it to one word in ten thousand).
CHI = 15.0
#: Terms that name groups of people, by kind; swapped within a kind.
IDENTITY = (
    ("women", "men", "girls", "boys", "transgender", "nonbinary"),
    ("woman", "man", "girl", "boy"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "african", "european", "latino"),
    ("gay", "lesbian", "straight", "bisexual", "queer"),
    ("immigrants", "refugees", "foreigners", "locals"),
    ("disabled", "deaf", "blind", "elderly", "young"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("ausländer", "flüchtlinge"),
    ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"), ("étrangers", "réfugiés"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"), ("extranjeros", "refugiados"),
)
_SENTENCE_END = np.zeros(256, bool)
_SENTENCE_END[[10, 13, *b".!?"]] = True


def _hash(word: str) -> int:
    return int(words_of(pa.array([word]), NOT_LETTERS).hashes[0])


def _identity(groups: tuple) -> tuple[np.ndarray, dict[int, list[int]]]:
    """Hashes of all terms, and of each one's partners."""
    hashed = [[_hash(t) for t in g] for g in groups]
    partners = {h: [o for o in g if o != h] for g in hashed for h in g}
    return np.array(sorted(partners), np.uint64), partners


def _present(words: Words, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of the features present, each once; ``vocabulary`` sorted and not empty."""
    at = np.searchsorted(vocabulary, words.hashes)
    hit = np.flatnonzero(vocabulary[np.minimum(at, len(vocabulary) - 1)] == words.hashes)
    pair = np.unique(words.doc[hit] * len(vocabulary) + at[hit])
    return pair // len(vocabulary), pair % len(vocabulary)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of either label that hold a word, summed up within a block."""
    forget()
    for block in blocks(batches):
        words = words_of(block.column("text"), NOT_LETTERS)
        label = block.column("label").to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.lexsort((words.doc, words.hashes))
        h, d = words.hashes[order], words.doc[order]
        if not len(h):
            continue
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])])
        h, d = h[new], d[new]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        both = np.diff(np.append(first, len(h)))
        toxic = np.add.reduceat(label[d], first)
        yield pa.RecordBatch.from_arrays(
            [pa.array(h[first].view(np.int64)), pa.array(toxic), pa.array(both - toxic)], names=["word", "toxic", "other"]
        )


def _swaps(words: Words, data: np.ndarray, terms: np.ndarray, partners: dict[int, list[int]]) -> dict[tuple[int, int], int]:
    """How many labelled sentences differ from their counterfactual in (term, partner)."""
    found: dict[tuple[int, int], int] = {}
    at = np.searchsorted(terms, words.hashes)
    hit = np.flatnonzero(terms[np.minimum(at, len(terms) - 1)] == words.hashes)
    if not len(hit):
        return found
    sentence = np.cumsum(_SENTENCE_END[data])[words.start[hit]]
    seen = set(zip(words.doc[hit].tolist(), sentence.tolist(), words.hashes[hit].tolist(), strict=True))
    for doc, number, term in seen:
        for other in partners[term]:
            if (doc, number, other) not in seen:  # a partner beside the term stays present either way
                found[term, other] = found.get((term, other), 0) + 1
    return found


def _train_rows(vocabulary: np.ndarray, terms: np.ndarray, partners: dict):
    """One row a document: label and present features; one row a block: swaps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from costlens.llm.words import text_bytes

        for block in blocks(batches):
            words = words_of(block.column("text"), NOT_LETTERS)
            doc, feature = _present(words, vocabulary)
            cuts = np.searchsorted(doc, np.arange(block.num_rows + 1)).tolist()
            rows = [feature[i:j].astype(np.int32).tobytes() for i, j in zip(cuts, cuts[1:], strict=False)]
            swaps = _swaps(words, text_bytes(block.column("text"))[0], terms, partners)
            flat = np.array([(a, b, n) for (a, b), n in sorted(swaps.items())], np.uint64).tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array([*block.column("label").to_pylist(), -1], pa.int32()), pa.array([*rows, flat], pa.binary())],
                names=["label", "data"],
            )

    return run


@dataclass
class Model:
    vocabulary: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, words: Words, n: int) -> np.ndarray:
        margin = np.full(n, self.bias)
        if len(self.vocabulary):
            doc, feature = _present(words, self.vocabulary)
            margin += np.bincount(doc, self.weights[feature], n)
        return 1 / (1 + np.exp(-np.clip(margin, -50, 50)))


def solve(doc: np.ndarray, feature: np.ndarray, label: np.ndarray, size: int, swaps: np.ndarray, l2: float, fair: float, rounds: int = 40) -> tuple[np.ndarray, float]:
    """Weights and bias by Newton's method with step halving.  ``swaps``: (term, partner, count) by feature number."""
    n = len(label)
    x = np.zeros((n, size + 1), np.float32)
    x[doc, feature] = 1
    x[:, size] = 1  # bias
    fixed = l2 * np.eye(size + 1)
    fixed[size, size] = 0
    share = swaps[:, 2] / max(1, swaps[:, 2].sum())
    a, b = swaps[:, 0].astype(int), swaps[:, 1].astype(int)
    for i, j, sign in ((a, a, 1), (b, b, 1), (a, b, -1), (b, a, -1)):
        np.add.at(fixed, (i, j), 2 * fair * sign * share)

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        margin = x @ w.astype(np.float32).astype(float)
        return float(np.mean(np.logaddexp(0, margin) - label * margin) + 0.5 * w @ fixed @ w), margin

    w = np.zeros(size + 1)
    now, margin = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(margin, -50, 50)))
        grad = x.T @ ((p - label) / n) + fixed @ w
        weighed = x * np.sqrt(p * (1 - p) / n).astype(np.float32)[:, None]
        curve = (weighed.T @ weighed).astype(float) + fixed + 1e-9 * np.eye(size + 1)
        step, scale = np.linalg.solve(curve, grad), 1.0
        while scale > 1e-4 and (then := loss(w - scale * step))[0] > now:
            scale /= 2
        if scale <= 1e-4 or now - then[0] < 1e-9:
            break
        w, (now, margin) = w - scale * step, then
    return w[:size], float(w[size])


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, size: int = VOCABULARY, l2: float = 5e-7, fair: float = 1.0, groups: tuple = IDENTITY, column: str = "toxic") -> Model:
    """Learn from the labelled documents outside the held-out fold."""
    spark = docs.sparkSession
    small_batches(spark)
    on_workers(spark)
    sample = saved(labelled_sample(docs, labels, column, FOLDS, HELD, rows), "toxicity-sample")
    totals = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    pos, neg = totals.get(1, 0), totals.get(0, 0)
    none = np.zeros(0, np.uint64)
    if not pos or not neg:
        return Model(none, np.zeros(0), float(np.log((pos + 1e-9) / (neg + 1e-9))) if pos + neg else -50.0)
    counts = sample.select("text", "label").mapInArrow(_count_words, "word long, toxic long, other long")
    counts = counts.groupBy("word").agg(F.sum("toxic").alias("t"), F.sum("other").alias("o")).filter("t + o >= 3")
    gap = F.col("t") * neg - F.col("o") * pos
    held = F.col("t") + F.col("o")
    rest = pos + neg - held
    chi = gap.cast("double") * gap * (pos + neg) / (held * rest * F.lit(float(pos) * neg) + 1)
    best = counts.withColumn("chi", chi).filter(F.col("chi") >= CHI).orderBy(F.desc("chi"), "word").limit(size).select("word").collect()
    terms, partners = _identity(groups)
    vocabulary = np.union1d(np.array([r["word"] for r in best], np.int64).view(np.uint64), terms)
    number = {h: i for i, h in enumerate(vocabulary.tolist())}
    found = sample.select("text", "label").mapInArrow(_train_rows(vocabulary, terms, partners), "label int, data binary").collect()
    label = np.array([r["label"] for r in found if r["label"] >= 0], float)
    present = [np.frombuffer(r["data"], np.int32) for r in found if r["label"] >= 0]
    swaps = np.concatenate([np.frombuffer(r["data"], np.uint64).reshape(-1, 3) for r in found if r["label"] < 0])
    pairs = np.array([(number[a], number[b], n) for a, b, n in swaps.tolist()], float).reshape(-1, 3)
    doc = np.repeat(np.arange(len(label)), [len(p) for p in present])
    weights, bias = solve(doc, np.concatenate(present), label, len(vocabulary), pairs, l2, fair)
    return Model(vocabulary, weights, bias)


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    small_batches(docs.sparkSession)
    on_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            score = model.score(words_of(block.column("text"), NOT_LETTERS), block.num_rows)
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    rows = id_text(docs).mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", held_out(FOLDS, HELD).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Stage form: the rows of ``docs``, with all their columns, whose text the classifier does not call toxic."""
    model = fit(docs, labels)
    names = docs.columns
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("text")
        for batch in batches:
            texts = batch.column(at).cast(pa.string())
            for block in blocks(iter([pa.RecordBatch.from_arrays([texts, pa.array(np.arange(batch.num_rows))], names=["text", "row"])])):
                score = model.score(words_of(block.column("text"), NOT_LETTERS), block.num_rows)
                kept = block.column("row").to_numpy()[score < threshold]
                if len(kept):
                    yield batch.take(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)
