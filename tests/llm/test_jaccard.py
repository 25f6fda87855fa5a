"""Jaccard join against all pairs of true shingle sets."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from costlens.llm import jaccard_join as J

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, k):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    if not words:
        return set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or {tuple(words)}


def brute(rows, k, percent):
    sets = [shingle_set(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    smallest = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        smallest[r] = d if smallest.get(r) is None else smallest[r] if d is None else min(smallest[r], d)
    return sorted(((d, len(s), smallest[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def family(rng, n, length, vocabulary):
    """Texts that differ from one another, or from an earlier one, by a few words."""
    base = rng.choices(vocabulary, k=length)
    out = [base]
    while len(out) < n:
        new = list(rng.choice(out))
        for _ in range(rng.randint(0, max(1, length // 40))):
            at = rng.randrange(len(new))
            new[at : at + rng.randint(0, 2)] = rng.choices(vocabulary, k=rng.randint(0, 2))
        out.append(new or ["x"])
    return [" ".join(w) for w in out]


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [None, "", "  \n", "a", "A", "a b", "a  B", "b a", "a b c", "a b c d", "a b c d a b c d", "é É"]
    for length in (4, 9, 12, 25, 60, 150, 400):
        for _ in range(4):
            texts += family(rng, rng.randint(2, 8), length, vocabulary)
    texts += family(rng, 40, 90, vocabulary)
    passage = " ".join(rng.choices(vocabulary, k=60))
    texts += [" ".join(rng.choices(vocabulary, k=rng.randint(1, 30))) + " " + passage for _ in range(30)]
    texts += ["word " * 4000, "word " * 4000 + "end", texts[30], texts[30], texts[31].upper().replace(" ", "\t\x0b")]
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("k", "percent", "rows_in_region"), [(3, 90, J.REGION_ROWS), (5, 80, J.REGION_ROWS), (3, 90, 3), (5, 80, 4), (2, 60, 5)])
def test_components_equal_all_pairs(spark, k, percent, rows_in_region):
    rows = corpus(k * percent)
    docs = spark.createDataFrame([(d, t, 1, "r") for d, t in rows], "doc_id long, text string, n long, region string").repartition(5)
    got = [tuple(r) for r in J.ngram_components(docs, k, percent, rows_in_region).collect()]
    assert sorted(got, key=str) == brute(rows, k, percent)


def test_repeated_null_and_no_rows(spark):
    text = "one two three four five six seven eight"
    rows = [(3, text), (3, text), (None, text), (None, "alone here"), (5, "alone here"), (None, None), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in J.ngram_components(docs).collect()]
    assert sorted(got, key=str) == sorted([(3, 6, 3), (3, 6, 3), (None, 6, 3), (None, 1, 5), (5, 1, 5), (None, 0, None), (9, 0, 9)], key=str)
    assert J.ngram_components(docs.limit(0)).collect() == []


def test_every_linked_pair_shares_a_node():
    """The subspace argument itself, on sets just within the threshold."""
    rng = np.random.default_rng(5)
    for percent in (60, 80, 90, 95):
        small = J.small_union(percent)
        parent = -(-percent * (small + 1) // 100)
        for size in (1, 2, 5, 9, 10, 11, 40, 300):
            for _ in range(20):
                union = rng.integers(0, 2**63, size, dtype=np.uint64)
                drop = rng.permutation(size)[: size * (100 - percent) // 100]
                side = rng.random(len(drop)) < 0.5
                x, y = np.sort(np.delete(union, drop[side])), np.sort(np.delete(union, drop[~side]))
                value, doc = np.concatenate([x, y]), np.repeat([0, 1], [len(x), len(y)])
                key, at, top = J.leaves(value, doc, small, parent)
                both = np.intersect1d(key[at == 0], key[at == 1])
                assert len(both)
                for one, n in ((0, len(x)), (1, len(y))):
                    mine = np.intersect1d(key[(at == one) & top], both)
                    assert len(mine) >= ((at == one) & top).sum() - n * (100 - percent) // percent


def test_join_region_equals_brute_force():
    rng = random.Random(3)
    for percent in (60, 80, 90):
        sets = []
        for _ in range(12):
            base = rng.sample(range(10**6), rng.randint(1, 60))
            sets += [np.array(sorted(set(rng.sample(base, max(1, len(base) - rng.randint(0, 4))))), np.uint64) for _ in range(6)]
        found = J.join_region(sets, percent)
        seen = {frozenset(p) for p in found}
        parent = list(range(len(sets)))

        def find(i, parent=parent):
            while parent[i] != i:
                i = parent[i]
            return i

        for i, j in found:
            parent[find(i)] = find(j)
        for i in range(len(sets)):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                link = 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both)
                assert not link or find(i) == find(j)
                assert frozenset((i, j)) not in seen or link


def leaf_batches(leaf, rng):
    at = 0
    while at < len(leaf):
        part = leaf[at : at + rng.randint(1, 5)]
        at += len(part)
        cols = [pa.array([k for k, _ in part], pa.int64()), pa.array([n for _, n in part], pa.int64()), pa.array([(k + n) % 2 == 0 for k, n in part])]
        yield pa.RecordBatch.from_arrays(cols, names=["key", "set", "top"])


def test_leaves_in_order_in_any_ranges_and_batches():
    rng = random.Random(1)
    for _ in range(1000):
        leaf = sorted((rng.randint(0, 8), rng.randint(0, 6)) for _ in range(rng.randint(0, 40)))
        pairs = sorted(set(leaf))
        cuts = [0, *sorted(rng.randint(0, len(pairs)) for _ in range(rng.randint(0, 4))), len(pairs)]
        found = []
        for i, j in zip(cuts, cuts[1:], strict=False):
            own = set(pairs[i:j])  # equal rows are in one range
            for out in J._met_in_order(leaf_batches([x for x in leaf if x in own], rng)):
                found += out.to_pylist()
        ends = {}
        for r in found:
            if r["last"] is not None:
                low, high = ends.get(r["key"], (r["set"], r["last"]))
                ends[r["key"]] = min(low, r["set"]), max(high, r["last"])
        got = [r for r in found if r["last"] is None]
        got = [(r["key"], r["set"], r["top"], ends.get(r["key"], (r["pivot"], None))[0]) for r in got if len(set(ends.get(r["key"], (0, 1)))) > 1]
        held = {k: [n for q, n in pairs if q == k] for k, _ in pairs}
        assert sorted(got) == [(k, n, (k + n) % 2 == 0, held[k][0]) for k, n in pairs if len(held[k]) > 1]


@pytest.mark.parametrize("rows", [7, 500_000])
def test_keys_that_span_ranges(spark, monkeypatch, rows):
    monkeypatch.setattr(J, "RANGE_ROWS", rows)
    leaf = [(k, n) for k in range(4) for n in range(60 if k == 2 else k + 1)] * 2
    got = J.met_leaves(spark.createDataFrame([(k, n, n % 2 == 0) for k, n in leaf], "key long, set long, top boolean").repartition(3))
    want = sorted((k, n, n % 2 == 0, 0) for k, n in set(leaf) if k > 0)
    assert sorted(tuple(r) for r in got.collect()) == want
