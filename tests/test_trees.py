"""Second-order trees against a plain learner that tries every split of every node."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from costlens.operators import trees

NAMES = ["a", "b", "c"]


def table(n, missing=False, weighted=False):
    """Columns of unlike steps through lattices; the label follows two of them."""
    i = np.arange(n)
    x = np.stack([(i * 37 % 101) / 7.0, (i * 53 % 11) - 5.0, (i * 29 % 67) * 0.5], axis=1)
    y = ((x[:, 0] > 6) & (x[:, 1] < 2) | (x[:, 2] > 28)).astype(int)
    y[i % 17 == 3] ^= 1
    if missing:
        x[i % 13 == 0, 0] = np.nan
        x[i % 7 == 2, 2] = np.nan
    return x, y, np.where(y == 1, 3.25, 1.0) if weighted else np.ones(n)


def frame(spark, x, y, w, parts):
    rows = [(int(k), *[None if math.isnan(v) else float(v) for v in r], int(t), float(u)) for k, (r, t, u) in enumerate(zip(x, y, w))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y int, w double").repartition(parts)


def plain(x, y, w, rounds, depth, rate=0.1, reg=1.0, min_child=1.0, cuts=None):
    """Margins, and splits as (tree, node) -> (feature, threshold, missing left), of a learner without histograms."""
    unit = w.max() / 2.0**30
    share = (np.rint(w * 2**20) * y).sum() / np.rint(w * 2**20).sum()
    margin, splits = np.full(len(x), math.log(share / (1 - share))), {}
    cuts = cuts or [sorted(set(v[~np.isnan(v)]))[1:] for v in x.T]
    for t in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = np.rint((p - y) * w / unit), np.rint(p * (1 - p) * w / unit)

        def grow(node, rows, level):
            G, H = g[rows].sum() * unit, h[rows].sum() * unit
            best = (1e-6, None)
            for f in range(x.shape[1]) if level < depth else ():
                v = x[rows, f]
                for c in cuts[f]:
                    for missing_left in (True, False):
                        left = np.where(np.isnan(v), missing_left, v < c)
                        gl, hl = g[rows][left].sum() * unit, h[rows][left].sum() * unit
                        if hl < min_child or H - hl < min_child:
                            continue
                        gain = gl**2 / (hl + reg) + (G - gl) ** 2 / (H - hl + reg) - G**2 / (H + reg)
                        if gain > best[0]:
                            best = (gain, (f, c, missing_left, left))
            if best[1] is None:
                margin[rows] += -rate * G / (H + reg)
                return
            f, c, missing_left, left = best[1]
            splits[t, node] = (f, c, missing_left)
            grow(2 * node + 1, rows[left], level + 1)
            grow(2 * node + 2, rows[~left], level + 1)

        grow(0, np.arange(len(x)), 0)
    return margin, splits


@pytest.mark.parametrize("missing,weighted,parts", [(False, False, 1), (True, True, 3), (True, False, 7)])
def test_equals_the_plain_learner_in_every_layout(spark, missing, weighted, parts):
    x, y, w = table(300, missing, weighted)
    df = frame(spark, x, y, w, parts)
    model = trees.fit_trees(df, NAMES, "y", "w" if weighted else None, rounds=5, depth=3)
    margins, splits = plain(x, y, w, 5, 3)
    found = {(r["tree"], r["node"]): (r["feature"], r["threshold"], r["missing_left"]) for r in model.node_table(spark).collect() if r["feature"] >= 0}
    assert found == splits and len(splits) > 15
    got = {r["id"]: r["margin"] for r in model.margin(df).collect()}
    assert max(abs(got[k] - m) for k, m in enumerate(margins)) < 1e-12


def test_same_trees_in_other_layouts_with_many_values(spark):
    i = np.arange(4000)
    x = np.stack([np.sin(i * 0.37) * 10, (i * 7919 % 4001) / 3.0, np.cos(i * i * 0.01)], axis=1)
    y = (x[:, 0] + x[:, 2] * 4 > 3).astype(int)
    tables = []
    for parts in (1, 3, 8):
        df = frame(spark, x, y, np.where(y == 1, 2.5, 1.0), parts)
        model = trees.fit_trees(df, NAMES, "y", "w", rounds=4, depth=4, max_bins=32)
        tables.append((model.base, [tuple(r) for r in model.node_table(spark).collect()]))
    assert tables[0] == tables[1] == tables[2]


def test_cuts_are_weighted_quantiles(spark):
    values = [(float(v), 1 << 20) for v in range(1000)] + [(2000.0, 1000 << 20)]
    df = spark.createDataFrame(values, "v double, q long").repartition(5)
    cuts = trees.quantile_cuts(df, ["v"], "q", max_bins=10, buckets=8)[0]
    # half of the weight sits on one value: it takes the upper half of the quantiles
    assert list(cuts) == [199.0, 399.0, 599.0, 799.0, 999.0, 2000.0] or list(cuts) == [199.0, 399.0, 599.0, 799.0, 999.0]
    few = spark.createDataFrame([(float(v % 4), 1) for v in range(50)] + [(None, 1), (-0.0, 1)], "v double, q long")
    assert list(trees.quantile_cuts(few, ["v"], "q")[0]) == [1.0, 2.0, 3.0]


def test_checkpoints_and_saving(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(trees, "CUT", 2)
    x, y, w = table(120)
    df = frame(spark, x, y, w, 2).withColumn("score", F.lit("replaced"))
    model = trees.fit_trees(df, NAMES, "y", rounds=7, depth=2)
    margins, _ = plain(x, y, w, 7, 2)
    model.save(spark, str(tmp_path / "m"))
    loaded = trees.TreeEnsemble.load(spark, str(tmp_path / "m"))
    got = {r["id"]: r["score"] for r in loaded.score(df).collect()}
    assert max(abs(got[k] - 1 / (1 + math.exp(-m))) for k, m in enumerate(margins)) < 1e-12


@pytest.mark.parametrize("weighted", [False, True])
def test_one_task_trains_the_same_trees_as_a_job_a_level(spark, monkeypatch, weighted):
    x, y, w = table(400)
    df, weight = frame(spark, x, y, w, 3), "w" if weighted else None
    jobs = []
    monkeypatch.setattr(trees, "_summed", lambda *a, summed=trees._summed: jobs.append(1) or summed(*a))
    own = trees.fit_trees(df, NAMES, "y", weight, rounds=5, depth=3)
    assert not jobs  # a small table needs no job a level
    monkeypatch.setattr(trees, "TASK_ROWS", 399)
    monkeypatch.setattr(trees, "BLOCK_ROWS", 100)
    spread = trees.fit_trees(df, NAMES, "y", weight, rounds=5, depth=3)
    assert len(jobs) > 5 and own.base == spread.base and len(own.trees) == 5
    for a, b in zip(own.trees, spread.trees):
        for c in ("feature", "threshold", "missing_left", "value", "cover"):
            assert (getattr(a, c) == getattr(b, c)).all()


def test_odd_tables(spark):
    schema = "id long, a double, b double, c double, y int, w double"
    empty = spark.createDataFrame([], schema)
    model = trees.fit_trees(empty, NAMES, "y", rounds=3)
    assert model.trees == [] and model.score(empty).collect() == []
    one = spark.createDataFrame([(1, 0.5, None, float("nan"), 1, 1.0), (2, None, None, None, None, 1.0), (3, 1.0, 1.0, 1.0, 0, -1.0), (4, 1.0, 1.0, 1.0, 0, None)], schema)
    model = trees.fit_trees(one, NAMES, "y", "w", rounds=2)
    assert [len(t.feature[t.feature >= 0]) for t in model.trees] == [0, 0]
    assert all(0.99 < r["score"] <= 1 for r in model.score(one).collect())
    with pytest.raises(ValueError):
        trees.fit_trees(one, NAMES, "y", max_bins=1000)


def test_depth_limit_and_least_child(spark):
    x, y, w = table(300)
    model = trees.fit_trees(frame(spark, x, y, w, 3), NAMES, "y", rounds=2, depth=1, min_child=40.0)
    for tree in model.trees:
        assert len(tree.feature) == 3 and (tree.feature[0] < 0 or (tree.cover[1:] >= 40.0).all())


@pytest.mark.parametrize("weights", [2, 400])
def test_blocks_are_small_and_their_histograms_are_plain_sums(weights):
    n, width, scale = 1000, 2, 2.0**20
    i = np.arange(n)
    bins = np.stack([i * 37 % 101, np.where(i % 7 == 2, trees.MAX_BINS, i % 5)]).astype(np.uint8)
    y, w = (i % 3 == 0).astype(np.uint8), 1.0 + i % weights / 64
    block = trees._block({"bins": bins.tobytes(), "y": y.tobytes(), "w": w.tobytes()}, width, 0.25)
    held = sum(x.nbytes for x in block if x is not None)
    assert held <= (width + 9) * n + 64 or weights > 256  # bins, margin and one byte: a pass costs what it reads
    done, tree = trees.Tree.empty(2), trees.Tree.empty(2)
    done.feature[0], done.bin[0], done.missing_left[0], done.value[1:3] = 1, 2, False, (0.5, -0.75)
    tree.feature[:2], tree.bin[:2] = (0, 1), (50, 3)
    right = (bins[1] > 2) | (bins[1] == trees.MAX_BINS)
    p = 1 / (1 + np.exp(-(0.25 + np.where(right, -0.75, 0.5))))
    g, h = np.rint((p - y) * w * scale), np.rint(p * (1 - p) * w * scale)
    node = np.where(bins[0] > 50, 2, np.where((bins[1] > 3) & (bins[1] != trees.MAX_BINS), 4, 3))
    assert (tree.nodes_of_bins(bins) == node).all()
    for counted in ([0], [4, 2]):
        at = trees.Tree.empty(2) if counted == [0] else tree
        slots = np.full(7, -1)
        slots[counted] = np.arange(len(counted))
        got = trees._histogram(block, [done], at, slots, [102, 6], scale)
        for k, c in enumerate(counted):
            rows = node == c if c else np.ones(n, bool)
            for f, (first, values) in enumerate([(0, 101), (102, 5)]):
                for m, x in enumerate((g, h)):
                    want = [x[rows & (bins[f] == v)].sum() for v in [*range(values), trees.MAX_BINS]]
                    assert list(got[m, k, first : first + values + 1]) == want
