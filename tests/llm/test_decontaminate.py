"""Decontamination: index and fingerprints against their definitions, matches against every window."""

import random

import numpy as np
import pyarrow as pa
import pytest
import regex

from costlens.llm import decontaminate as D

WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")


def plain(text):
    return WORD.findall((text or "").lower())


def shingles(words, k):
    return [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]


def brute(docs, items):
    """Best similarity of every (document, item), over all windows."""
    held = {}
    for i, text in items:
        words = plain(text)
        if words:
            for s in set(shingles(words, min(5, len(words)))):
                held.setdefault(s, set())
    for n, (_, text) in enumerate(docs):
        words = plain(text)
        for k in range(1, 6):
            for s in shingles(words, k):
                if s in held:
                    held[s].add(n)
    weight = {s: np.log1p(len(docs) / (1 + len(d))) for s, d in held.items()}
    out = {}
    for d, text in docs:
        words = plain(text)
        for i, item in items:
            target = plain(item)
            if not target:
                continue
            k = min(5, len(target))
            own = set(shingles(target, k))
            total = sum(weight[s] for s in own)
            for at in range(max(1, len(words) - len(target) + 1)):
                window = set(shingles(words[at : at + len(target)], k))
                similar = sum(weight[s] for s in own & window) / total
                if similar > out.get((d, i), 0):
                    out[d, i] = similar
    return out


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([3, 5, 8, 20, 35, 60])))) for i in range(25)]
    items += [(90, None), (91, ""), (92, "... !!"), (93, items[3][1]), (94, items[4][1].upper().replace(" ", ", "))]
    docs = [(1000, None), (1001, ""), (1002, items[5][1]), (1003, "w1 " * 5000)]
    for n in range(60):
        _, text = rng.choice(items[:25])
        words = text.split()
        kind = n % 6
        if kind == 1 and len(words) > 10:  # an edit
            words[rng.randrange(len(words))] = "changed"
        elif kind == 2:  # cut off
            words = words[: max(1, int(len(words) * rng.uniform(0.6, 1)))]
        elif kind == 3:  # a word more
            words.insert(rng.randrange(len(words)), "more")
        elif kind == 4:
            words = [w.upper() + rng.choice(["", ",", "!"]) for w in words]
        elif kind == 5:
            words = rng.choices(vocabulary, k=30)
        around = lambda: rng.choices(vocabulary, k=rng.randint(0, 60))
        docs.append((n, " ".join(around() + words + around())))
    return docs, items


@pytest.mark.parametrize("block", [D.ITEM_BLOCK, 7])
def test_matches_are_those_of_all_windows(spark, block):
    docs, items = corpus(11)
    frame = spark.createDataFrame([(d, t, 0.0, 1) for d, t in docs], "doc_id long, text string, similarity double, item_id int").repartition(4)
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    found = {(r.doc_id, r.item_id): r for r in D.matches(frame, bench, item_block=block).collect()}
    want = {p: s for p, s in brute(docs, items).items() if s >= 0.8}
    assert set(found) == set(want) and len(want) > 30
    assert all(found[p].similarity == pytest.approx(s) for p, s in want.items())
    texts = dict(docs)
    for (d, i), r in found.items():
        assert 0 <= r.start and r.start + r.n_words <= len(plain(texts[d]))
    kept = {r.doc_id for r in D.drop_contaminated(frame, bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in want}
    assert D.drop_contaminated(frame, bench).columns == frame.columns


def test_nothing_and_nulls(spark):
    frame = spark.createDataFrame([(None, "one two three four five six"), (4, "one two three four five six"), (4, "one two three four five six")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "two three four five six"), (None, "one two three"), (8, None)], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in D.matches(frame, bench).collect()] == [(4, 7)]
    assert D.drop_contaminated(frame, bench).collect() == []
    shared = frame.unionByName(spark.createDataFrame([(4, "a clean text with that id"), (None, "clean, without id"), (None, None)], frame.schema))
    left = sorted(map(tuple, D.drop_contaminated(shared, bench).collect()), key=str)
    assert left == [(4, "a clean text with that id"), (None, None), (None, "clean, without id")] or set(left) == {(4, "a clean text with that id"), (None, None), (None, "clean, without id")}
    assert D.matches(frame.limit(0), bench).collect() == [] and D.matches(frame, bench.limit(0)).collect() == []


@pytest.mark.parametrize("radius", [0, 3, 8, 20])
def test_index_returns_all_within_the_radius(radius):
    rng = np.random.default_rng(radius)
    stored = rng.integers(0, 2**64, 150, dtype=np.uint64)
    queries = np.concatenate([rng.integers(0, 2**64, 60, dtype=np.uint64), stored[:40]])
    for i in range(60, 100):
        for b in rng.choice(64, rng.integers(0, 24), replace=False):
            queries[i] ^= np.uint64(1) << np.uint64(b)
    got = set(zip(*(x.tolist() for x in D.HammingIndex(stored, radius).within(queries)), strict=True))
    distance = np.bitwise_count(queries[:, None] ^ stored[None, :])
    want = {(i, j, int(distance[i, j])) for i, j in zip(*np.nonzero(distance <= radius), strict=True)}
    assert got == want and len(want) >= 1


def test_no_match_lies_beyond_its_radius():
    """Any part of an item that keeps 0.8 of its weight is within the item's radius, and the index finds it."""
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 4000, size))) for i, size in enumerate([7, 12, 30, 80, 200])]
    items = D.Items(rows)
    items.weigh(rng.choice([0.05, 1.0, 9.0], len(items.value)), 0.8)
    for i in range(len(items)):
        own = items.shingles(i)
        for _ in range(200):
            kept, missing = set(own.tolist()), 0.0
            for x in rng.permutation(own).tolist():
                if missing + items.weight[x] <= 0.2 * items.whole[i]:
                    kept.discard(x)
                    missing += items.weight[x]
            part = np.array(sorted(kept))
            prints = D.fingerprints((items.weight[part] @ items.sign[part])[None])
            assert np.bitwise_count(prints[0] ^ items.prints[i]) <= items.radius[i]
            assert len(D._candidates([None] * len(items), items, i, prints)[0]) == 1


def test_sums_over_windows_count_distinct_shingles():
    rng = np.random.default_rng(9)
    spot = np.sort(rng.choice(200, 60, replace=False))
    shingle = rng.integers(0, 12, 60)
    gains = rng.random((12, 3))
    starts = np.unique(rng.integers(0, 200, 50))
    got = D.held_by_windows(starts, 17, spot, shingle, gains[shingle])
    for s, row in zip(starts, got, strict=True):
        assert row == pytest.approx(gains[np.unique(shingle[(spot >= s) & (spot <= s + 17)])].sum(axis=0))


def test_items_behind_a_frequent_beginning_are_found(spark):
    """Forty items begin with a passage that a third of the documents hold; each is planted without it."""
    rng = random.Random(3)
    word = lambda: f"v{rng.randrange(20000)}"
    passage = [word() for _ in range(25)]
    rare = [[word() for _ in range(60)] for _ in range(40)]
    items = [(i, " ".join(passage + r)) for i, r in enumerate(rare)]
    docs = [(i, " ".join([word() for _ in range(20)] + r + [word() for _ in range(30)])) for i, r in enumerate(rare)]
    docs += [(1000 + i, " ".join([word() for _ in range(30)] + (passage if i % 2 else []) + [word() for _ in range(30)])) for i in range(80)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in D.matches(frame, bench).collect()}
    want = {p for p, s in brute(docs, items).items() if s >= 0.8}
    assert found == want and want == {(i, i) for i in range(40)}


def test_case_and_typography_of_any_script(spark):
    german = "Über die Höhe der Bäume äußerte sich der Förster erst spät am Abend und ging dann müde heim"
    russian = "Вчера вечером мы долго гуляли по старому городу и смотрели на огни больших домов у реки"
    texts = [german, german.upper().replace("SS", "ß"), "\u201e" + german.replace(" ", "\u00a0", 3).replace(" und", "\u2009\u2014 und") + "\u201c\u2026", russian.upper(), russian.replace(" ", "\u3000")]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(0, german), (1, russian)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in D.matches(frame, bench).collect()} == {(0, 0), (1, 0), (2, 0), (3, 1), (4, 1)}


def test_one_text_repeats_a_shingle_throughout(spark):
    """Many windows, many items that share a shingle: looked up in bounded chunks."""
    items = [(i, f"one two three four five unlike{i} " + " ".join(f"x{i}y{j}" for j in range(6))) for i in range(300)]
    frame = spark.createDataFrame([(1, "one two three four five " * 6000 + items[7][1])], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in D.matches(frame, bench).collect()] == [(1, 7)]
