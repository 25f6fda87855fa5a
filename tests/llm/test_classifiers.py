"""Toxicity and quality: the solvers against their definitions, held-out accuracy, odd input."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from costlens.llm import common, quality, toxicity
from costlens.llm.words import NOT_LETTERS, words_of

SF = "/root/testdata/sf0.1"


def auc(label, score):
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    n1 = int(label.sum())
    return (rank[label == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(label) - n1))


@pytest.mark.parametrize(("module", "column", "modulus", "held", "least"), [(toxicity, "toxic", 3, 1, 0.95), (quality, "quality", 4, 2, 0.99)])
def test_held_out_accuracy(spark, module, column, modulus, held, least):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = module.scored(docs, module.fit(docs, labels)).collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == held) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    known = {r.doc_id: r[column] for r in labels.collect()}
    tested = [(known[r.doc_id], r.score, r.predicted) for r in rows if r.held_out and r.doc_id in known]
    label, score, predicted = (np.array(x) for x in zip(*tested, strict=True))
    assert auc(label, score) >= least
    assert (label == predicted).mean() >= 0.96


@pytest.mark.parametrize(("module", "column"), [(toxicity, "toxic"), (quality, "quality")])
def test_held_out_labels_are_never_used(spark, module, column):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    held = common.held_out(module.FOLDS, module.HELD)
    flipped = labels.withColumn(column, F.when(held, 1 - F.col(column)).otherwise(F.col(column)))
    some = docs.limit(50)
    one = {r.doc_id: r.score for r in module.scored(some, module.fit(docs, labels)).collect()}
    two = {r.doc_id: r.score for r in module.scored(some, module.fit(docs, flipped)).collect()}
    assert one == two


@pytest.mark.parametrize("module", [toxicity, quality])
def test_odd_documents_and_labels(spark, module):
    column = "toxic" if module is toxicity else "quality"
    docs = spark.createDataFrame(
        [(1, None, 0.5, 3), (2, "", 0.5, 3), (3, "x " * 200_000, 0.5, 3), (None, "no id", 0.5, 3), (4, "a b", 0.5, 3), (4, "a b", 0.5, 3)],
        "doc_id long, text string, score double, label int",
    )
    labels = spark.createDataFrame([(1, 1), (2, None), (4, 1), (4, 1), (99, 0), (None, 0), (3, 7)], f"doc_id long, {column} int")
    for some in (labels, labels.limit(0), labels.filter("doc_id = 4")):
        rows = module.scored(docs, module.fit(docs, some)).collect()
        assert len(rows) == 6 and all(0 <= r.score <= 1 and r.held_out is not None for r in rows)
        assert len({r.score for r in rows if r.doc_id == 4}) == 1
    assert module.scored(docs.limit(0), module.fit(docs.limit(0), labels)).collect() == []


def test_training_rows_are_bounded_and_the_same_in_any_layout(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    one = common.labelled_sample(docs, labels, "toxic", 3, 1, rows=40)
    two = common.labelled_sample(docs.repartition(7), labels.repartition(5), "toxic", 3, 1, rows=40)
    ids = sorted(r.doc_id for r in one.collect())
    assert len(ids) == 40 and ids == sorted(r.doc_id for r in two.collect())


def training_frame(spark, identity_is_toxic):
    """Sentences in which a group is mentioned more often where an insult is, or not at all."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(600):
        toxic = i % 3 == 0
        words = rng.choice(["river", "stone", "cloud", "paper", "green"], 6).tolist()
        if toxic:
            words.insert(2, ["zorp", "blarg"][i % 2])
        if rng.random() < (0.8 if toxic == identity_is_toxic else 0.1):
            words.insert(4, "muslims")
        elif rng.random() < 0.1:
            words.insert(4, "christians")
        rows.append((i, " ".join(words) + ".", int(toxic)))
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    return frame.select("doc_id", "text"), frame.select("doc_id", "toxic")


def score(model, *texts):
    return model.score(words_of(pa.array(texts), NOT_LETTERS), len(texts))


def test_a_neutral_mention_does_not_raise_the_score(spark):
    docs, labels = training_frame(spark, True)
    plain = toxicity.fit(docs, labels, fair=0.0, l2=1e-3)
    fair = toxicity.fit(docs, labels, fair=10.0, l2=1e-3)
    texts = "the muslims met by the river", "the christians met by the river", "a zorp met by the river"
    biased, balanced = score(plain, *texts), score(fair, *texts)
    assert biased[0] - biased[1] > 0.02
    assert abs(balanced[0] - balanced[1]) < 0.2 * (biased[0] - biased[1])
    assert balanced[2] > 0.7


def test_solver_reaches_a_stationary_point():
    rng = np.random.default_rng(0)
    x = rng.random((80, 6)) < 0.4
    y = (x[:, 0] | (rng.random(80) < 0.2)).astype(float)
    doc, feature = np.nonzero(x)
    swaps = np.array([[1, 2, 3.0], [2, 3, 1.0]])
    w, b = toxicity.solve(doc, feature, y, 6, swaps, 1e-2, 2.0)

    def loss(v):
        margin = x @ v[:6] + v[6]
        gap = (swaps[:, 2] / 4 * (v[swaps[:, 1].astype(int)] - v[swaps[:, 0].astype(int)]) ** 2).sum()
        return np.mean(np.logaddexp(0, margin) - y * margin) + 0.005 * (v[:6] ** 2).sum() + 2.0 * gap

    at = np.append(w, b)
    for i in range(7):
        step = np.zeros(7)
        step[i] = 1e-4
        assert abs(loss(at + step) - loss(at - step)) / 2e-4 < 1e-3


def test_swaps_are_counted_by_sentence():
    terms, partners = toxicity._identity((("muslims", "christians"),))
    text = "Muslims came. The MUSLIMS and muslims left! christians\nmuslims with christians"
    from costlens.llm.words import text_bytes

    column = pa.array([text, "nothing here", None])
    found = toxicity._swaps(words_of(column, NOT_LETTERS), text_bytes(column)[0], terms, partners)
    a, b = toxicity._hash("muslims"), toxicity._hash("christians")
    assert found == {(a, b): 2, (b, a): 1}


def test_quality_score_is_the_difference_of_gaussian_log_densities():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 1, (200, 4)), rng.normal(1, 2, (300, 4))])
    y = np.repeat([0, 1], [200, 300])
    model = quality.solve(x, y, pool=0.3, ridge=0.1)
    means = [x[y == k].mean(axis=0) for k in (0, 1)]
    spread = [np.cov(x[y == k].T, bias=True) for k in (0, 1)]
    pooled = spread[0] * 0.4 + spread[1] * 0.6
    density = []
    for k in (0, 1):
        s = 0.7 * spread[k] + 0.3 * pooled
        s = 0.9 * s + (0.1 * np.trace(s) / 4 + 1e-6) * np.eye(4)
        gap = x - means[k]
        density.append(np.log([0.4, 0.6][k]) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.einsum("ij,jk,ik->i", gap, np.linalg.inv(s), gap))
    want = 1 / (1 + np.exp(-np.clip(density[1] - density[0], -50, 50)))
    assert np.allclose(model.score(x), want)


def test_statistics_by_hand():
    texts = ["One two TWO two two.", "", None, "a|b | c!!\n\n12"]
    got = quality.statistics(pa.array(texts))
    assert got.shape == (4, len(quality.NAMES)) and np.isfinite(got).all()
    by = dict(zip(quality.NAMES, got[0], strict=True))
    assert by["words"] == pytest.approx(np.log1p(5)) and by["twice"] == pytest.approx(np.log((2 + 0.5) / 6))
    assert by["variety"] == pytest.approx(np.log((3 + 1) / 6)) and by["upper"] == pytest.approx(np.log(4.5 / 16))
    assert (got[1] == got[2]).all()
    by = dict(zip(quality.NAMES, got[3], strict=True))
    assert by["bare"] == pytest.approx(np.log(1.5 / 5)) and by["decorated"] == pytest.approx(np.log(3.5 / 5))
    assert by["lines"] == pytest.approx(np.log(2.5 / 5)) and by["digits"] == pytest.approx(np.log(2.5 / 14))
    assert (quality.statistics(pa.array(texts * 3))[:4] == got).all()
