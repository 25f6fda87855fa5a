"""Centroid clustering against a brute-force reading of its rules."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from costlens.llm import centroid_clusters as cc

SCHEMA = "vec_id long, embedding array<float>, cluster string"


def brute(rows, dim, k, rounds):
    kept = []
    for vec_id, e in rows:
        if e is None or len(e) != dim or any(x is None or not math.isfinite(x) for x in e):
            continue
        kept.append((vec_id, [max(-cc.LIMIT, min(cc.LIMIT, math.floor(256 * float(np.float32(x))))) for x in e]))
    name = lambda r: hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest()
    centers = [v for _, v in sorted(kept, key=lambda r: (name(r), r[0] is not None, r[0], r[1]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centers))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for j in range(len(centers)):
            mine = [v for (_, v), c in zip(kept, own) if c == j]
            if mine:
                centers[j] = [sum(x) // len(mine) for x in zip(*mine)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    by = {}
    for _, c, d in found:
        by[c] = by.get(c, 0) + d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return [(i, c, d, by[c], sum(by.values()), digest[c]) for i, c, d in found]


def vectors(n, dim, spread=0.05):
    """Points near a lattice of centres, half of them in one; no random generator."""
    out = []
    for i in range(n):
        group = 0 if i % 2 else i % 7
        out.append((i, [math.sin(group * 3.1 + j) + spread * math.cos(i * 12.9898 + j * 78.233) for j in range(dim)]))
    return out


ODD = [
    (None, [0.5] * 8), (None, [0.25] * 8), (3, [0.5] * 8), (3, [0.5] * 8), (900, None), (901, []), (902, [1.0] * 7), (903, [1.0] * 9),
    (904, [None] + [1.0] * 7), (905, [float("nan")] * 8), (906, [float("inf")] + [0.0] * 7), (907, [-float("inf")] + [0.0] * 7),
    (908, [1e30, -1e30] + [0.0] * 6), (909, [0.0] * 8), (910, [-0.0] * 8), (911, [1 / 512] * 8), (912, [-1 / 512] * 8),
]


def run(spark, rows, dim, k, rounds, lead=3, parts=3):
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA).withColumn("lead", F.lit(0)).repartition(parts)
    return sorted(map(tuple, cc.clusters(df, dim, k, rounds, lead).collect()), key=str)


@pytest.mark.parametrize("k,rounds,parts", [(5, 3, 3), (1, 1, 1), (9, 0, 4)])
def test_equals_brute_force(spark, k, rounds, parts):
    rows = vectors(150, 8) + ODD
    assert run(spark, rows, 8, k, rounds, parts=parts) == sorted(brute(rows, 8, k, rounds), key=str)


def test_fewer_vectors_than_centroids_and_copies(spark):
    rows = [(i, [0.5, -0.5]) for i in range(6)] + [(7, [0.75, 0.0])]
    assert run(spark, rows, 2, 40, 5, lead=16) == sorted(brute(rows, 2, 40, 5), key=str)


def test_nothing_kept(spark):
    assert run(spark, [(1, None), (2, [1.0])], 8, 3, 2) == []
    df = spark.createDataFrame([], SCHEMA)
    assert cc.clusters(df).collect() == [] and cc.clusters(df).columns == [c.split()[0] for c in cc.OUT.split(", ")]


def test_filter_keeps_the_nearest_and_spares_most_pairs():
    rows = np.array([v for _, v in vectors(3000, 32)])
    points = np.floor(256 * rows).astype(np.int64)
    centers = points[np.arange(40) * 71]
    mean = points.mean(0)
    axes = np.linalg.eigh(np.cov(points.T))[1][:, ::-1]
    turn = cc.Rotation(mean, axes, 6)
    cluster, distance, measured = cc.nearest(points, *turn.apply(points), centers, turn)
    every = np.square(points[:, None] - centers[None]).sum(2)
    assert (distance == every.min(1)).all() and (cluster == every.argmin(1)).all()
    assert measured < every.size / 3
    lead, rest = turn.apply(points)
    center_lead, center_rest = turn.apply(centers)
    bound = np.square(lead[:, None] - center_lead).sum(2) + np.square(rest[:, None] - center_rest)
    assert (bound <= every * (1 + 1e-9) + 1e-6).all()
