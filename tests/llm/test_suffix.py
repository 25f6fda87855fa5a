"""Repeated byte strings against every window compared with every other."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from costlens.llm import suffix_dedup as S


def brute(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (d, _), t in zip(rows, texts, strict=True):
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = sum(1 for i in range(len(t)) if gone[i] and not (i and gone[i - 1]))
        out.append((d, len(t), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=False) if not g)).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, length):
    rng = random.Random(seed)
    letters = "abcdefghij é\n"
    word = lambda n: "".join(rng.choices(letters, k=n))
    passages = [word(rng.randint(length // 2, length * 3)) for _ in range(8)]
    texts = [None, "", "x", "a" * (length - 1), "a" * length, "a" * (length + 1), "ab" * length, "abc" * length, "\x00" * length * 2]
    for _ in range(70):
        parts = []
        for _ in range(rng.randint(1, 5)):
            p = rng.choice(passages)
            i, j = sorted((rng.randint(0, len(p)), rng.randint(0, len(p))))
            parts.append(rng.choice([word(rng.randint(0, length * 2)), p, p[i:j], p[i:]]))
        texts.append("".join(parts))
    texts += [texts[20], texts[20], texts[30] + "!", "?" + texts[30], word(length * 40)]
    hot = passages[0] + passages[1]
    texts += [word(rng.randint(0, 30)) + hot[: rng.randint(length, len(hot))] + word(5) for _ in range(60)]
    return [(i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("length", "bucket"), [(200, S.BUCKET_ROWS), (40, S.BUCKET_ROWS), (24, 12), (12, 40), (200, 5)])
def test_equals_brute_force(spark, length, bucket):
    rows = corpus(length + bucket, length)
    docs = spark.createDataFrame([(d, t, 0, "r") for d, t in rows], "doc_id long, text string, h long, context string").repartition(5)
    got = sorted((tuple(r) for r in S.remove_repeats(docs, length, bucket).collect()), key=str)
    assert got == brute(rows, length)


def test_long_texts_in_pieces(spark, monkeypatch):
    rng = random.Random(4)
    passage = "".join(rng.choices("abcdef ", k=700))
    word = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    rows = [(i, word(900) + passage + word(800) + passage[100:400]) for i in range(4)]
    data = [t.encode() for _, t in rows]
    shape = S.Shape(50)
    whole = [sorted(zip(*(x.tolist() for x in S.anchors(np.frombuffer(t, np.uint8), shape)), strict=True)) for t in data]
    monkeypatch.setattr(S, "PIECE", 512)
    windows = [set() for _ in data]
    for block, doc, base, a, lo, hi in S._together(data, shape):
        for d, b, x, i, j in zip(doc.tolist(), base.tolist(), a.tolist(), lo.tolist(), hi.tolist(), strict=True):
            windows[d] |= {(x - b, s - b) for s in range(i, j + 1)}
    assert windows == [{(x, s) for x, i, j in w for s in range(i, j + 1)} for w in whole]


def test_repeated_null_ids_and_no_rows(spark):
    text = "".join(random.Random(2).choices("abcdefgh", k=300))
    rows = [(1, text), (1, text), (None, "z" + text), (None, None), (2, "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in S.remove_repeats(docs).collect()), key=str)
    assert got == brute(rows, 200)
    assert S.remove_repeats(docs.limit(0)).collect() == []


def test_multikey_sort_and_prefixes():
    rng = np.random.default_rng(1)
    for n, width, letters in ((0, 5, 2), (1, 9, 2), (300, 21, 2), (500, 8, 3), (200, 40, 1)):
        rows = rng.integers(0, letters, (n, width), dtype=np.uint8)
        order = S.multikey_sort(rows)
        ranked = [bytes(rows[i]) for i in order]
        assert ranked == sorted(ranked) and sorted(order.tolist()) == list(range(n))
        shared = S.shared_prefix(rows, order) if n else []
        for a, b, k in zip(ranked, ranked[1:], shared[1:], strict=False):
            assert a[:k] == b[:k] and (k == width or a[k] != b[k])


def test_window_hash_is_the_polynomial():
    data = np.random.default_rng(3).integers(0, 256, 90, dtype=np.uint8)
    for size in (1, 2, 3, 7, 16, 61, 90, 91):
        h = S.window_hash(data, size)
        assert len(h) == max(0, 91 - size)
        again = {}
        for i, x in enumerate(h.tolist()):
            assert again.setdefault(data[i : i + size].tobytes(), x) == x
        assert len(set(again.values())) == len(again)
