"""Second-order boosted trees for a 0/1 label (T2): gradient and hessian histograms over weighted quantile bins.

Each round fits a tree to the logistic loss's gradients g = w (p - y) and hessians h = w p (1 - p).  A node's split is the
(feature, cut, side of missing values) with the largest

    GL^2 / (HL + lambda) + GR^2 / (HR + lambda) - G^2 / (H + lambda)

among those whose children both have a hessian of ``min_child``; a leaf's value is -rate G / (H + lambda).

How it runs: features become bin numbers once, written to the shared folder in blocks of numpy bytes.  A level of a tree
is one pass over the blocks: every task adds up its histograms, of the lighter child of each split only (the other is what
its parent has besides: sums are exact), and of the bins that exist.  Blocks are dealt evenly to as many partitions as the
cluster has cores, so the driver is sent so many histograms a level, or by Spark's tree reduction fewer, whatever the number
of rows.  What a pass costs is mostly what it reads, so a block is small: bins, one byte of label and weight (where there
are few), margins.  Margins are renewed every ``KEPT`` trees; a pass adds the trees since then and takes gradients for the
rows that it counts.  Blocks are kept as they are, not compressed, and checkpointed every ``CUT`` trees, so a lost executor
repeats at most that many cheap updates.  A table of at most ``TASK_ROWS`` rows is trained on by one task, which takes the
same levels over the same blocks: there a job a level, 800 for 200 trees, would cost more than all rows do.

Gradients and hessians are rounded to integers before they are added (30 bits, fewer only when more than 2**31 rows
would overflow a long), so sums have no order: the same rows give the same trees in any layout.  Ties between splits go to
the smaller feature, then the smaller cut, then missing values left.

Defined results: null and NaN features are missing and take the side that a split learnt for them; rows with a null label
or weight, or a weight that is not positive, are left out; a table without rows gives a model without trees whose
probability is 1/2; one class only gives trees without splits."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from costlens.functions import count_le
from costlens.operators.frames import ensure_parallelism
from costlens.session import checkpoint_dir, scratch_path, ship_package

#: Value bins of a feature at most; the bin after them holds missing values.
MAX_BINS = 255
BLOCK_ROWS = 1 << 15
#: Rows that one task trains on: so few cost less than the jobs of every level.
TASK_ROWS = 1 << 20
#: Trees between two renewals of the margins.
KEPT = 2
#: Trees between two checkpoints of the margins.
CUT = 25
#: Copies (a power of 2) of a histogram that take neighbouring rows, which often share a bin, in turn.
LANES = 4
HELD = StorageLevel.MEMORY_AND_DISK_DESER  # serialized ones would be compressed and read anew at every pass
#: Rows scored at once, and for 16 bits the place of the lowest one that is not set.
SCORE_ROWS = 8192
_FIRST_FREE = np.array([next((b for b in range(16) if not m >> b & 1), 15) for m in range(1 << 16)], np.uint8)
#: A split must gain this much.
LEAST_GAIN = 1e-6
#: Weights are counted in this fraction when quantiles are taken.
WEIGHT_UNIT = 1 << 20


@dataclass
class Tree:
    """Nodes in heap order (children of i: 2i + 1 and 2i + 2); ``feature`` is -1 at leaves."""

    feature: np.ndarray
    threshold: np.ndarray  # values below go left
    bin: np.ndarray  # the same, in bins: at most this one
    missing_left: np.ndarray
    value: np.ndarray
    cover: np.ndarray  # sum of hessians
    gain: np.ndarray

    @staticmethod
    def empty(depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return Tree(np.full(n, -1), np.zeros(n), np.zeros(n, np.int64), np.ones(n, bool), np.zeros(n), np.zeros(n), np.zeros(n))

    def _walk(self, n: int, goes_left) -> np.ndarray:
        at = np.zeros(n, np.int64)
        for _ in range(int(math.log2(len(self.feature) + 1)) - 1):
            f = self.feature[at]
            inner = f >= 0
            if not inner.any():
                break
            left = goes_left(np.where(inner, f, 0), at)
            at = np.where(inner, 2 * at + np.where(left, 1, 2), at)
        return at

    def nodes_of_bins(self, bins: np.ndarray) -> np.ndarray:
        """Node of every column of ``bins`` (features x rows): split by split, parents first, in the smallest integers."""
        small = np.min_scalar_type(len(self.feature)).type
        at = np.zeros(bins.shape[1], small)
        for i in np.flatnonzero(self.feature >= 0):
            f = bins[self.feature[i]]
            right = f > np.uint8(self.bin[i])
            if self.missing_left[i]:
                right &= f != np.uint8(MAX_BINS)
            further = right.view(np.uint8) + small(i + 1)  # children of i: i + 1 and i + 2 further
            further *= (at == small(i)).view(np.uint8)
            at += further
        return at

    def bit_plan(self):
        """((feature, node, bits of the leaves on its left) of every split, nodes of the leaves from left to right), or
        none for a tree of more than 16 leaves."""
        if len(self.feature) > 31:
            return None
        splits, leaves = [], []

        def walk(i: int) -> int:
            if self.feature[i] < 0:
                leaves.append(i)
                return 1 << (len(leaves) - 1)
            left = walk(2 * i + 1)
            splits.append((int(self.feature[i]), i, np.uint16(left)))
            return left | walk(2 * i + 2)

        walk(0)
        return splits, leaves

    def nodes_of_values(self, x: np.ndarray) -> np.ndarray:
        rows = np.arange(len(x))

        def left(f, at):
            v = x[rows, f]
            return np.where(np.isnan(v), self.missing_left[at], v < self.threshold[at])

        return self._walk(len(x), left)


NODES = "tree int, node int, feature int, threshold double, missing_left boolean, value double, cover double, gain double"


@dataclass
class TreeEnsemble:
    """A fitted model: the margin is ``base`` plus the values of the leaves reached."""

    features: list[str]
    base: float
    trees: list[Tree] = field(default_factory=list)

    def margins(self, x: np.ndarray) -> np.ndarray:
        """A tree of at most 16 leaves is read by bits: every split that a row leaves to the right rules out the leaves on
        its left, and the first leaf left over is the row's."""
        out = np.full(len(x), self.base)
        plans = [tree.bit_plan() for tree in self.trees]
        for at in range(0, len(x), SCORE_ROWS):
            part = x[at : at + SCORE_ROWS]
            columns, missing = np.ascontiguousarray(part.T), np.isnan(part.T)
            some = missing.any(axis=1)
            for tree, plan in zip(self.trees, plans):
                if plan is None:
                    out[at : at + SCORE_ROWS] += tree.value[tree.nodes_of_values(part)]
                    continue
                splits, leaves = plan
                ruled_out = np.zeros(len(part), np.uint16)
                for f, i, left in splits:
                    right = columns[f] >= tree.threshold[i]  # missing values compare as false: left
                    if some[f] and not tree.missing_left[i]:
                        right |= missing[f]
                    ruled_out |= right * left
                out[at : at + SCORE_ROWS] += tree.value[leaves][_FIRST_FREE[ruled_out]]
        return out

    def _add(self, df: DataFrame, out: str, function) -> DataFrame:
        ship_package(df.sparkSession)
        model, given = self, "_x"
        x = F.array(*[F.col(f"`{c}`").cast("double") for c in self.features]).alias(given)
        kept = [c for c in df.columns if c != out]  # a column of that name is replaced

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                values = batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False)
                scores = function(model.margins(values.reshape(batch.num_rows, len(model.features)))) if batch.num_rows else np.zeros(0)
                columns = [batch.column(i) for i in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(scores, pa.float64())], names=[*batch.schema.names[:-1], out])

        rows = df.select(*[F.col(f"`{c}`") for c in kept], x)
        return rows.mapInArrow(run, StructType([*rows.schema.fields[:-1], StructField(out, DoubleType())]))

    def margin(self, df: DataFrame, out: str = "margin") -> DataFrame:
        """``df`` and the margin, in Arrow batches; streaming frames too."""
        return self._add(df, out, lambda m: m)

    def score(self, df: DataFrame, out: str = "score") -> DataFrame:
        """``df`` and the probability of label 1."""
        return self._add(df, out, _sigmoid)

    def node_table(self, spark: SparkSession) -> DataFrame:
        """One row a node that exists."""
        rows = []
        for t, tree in enumerate(self.trees):
            reached = [0]
            for i in reached:
                inner = tree.feature[i] >= 0
                reached.extend((2 * i + 1, 2 * i + 2) if inner else ())
                threshold = float(tree.threshold[i]) if inner else None
                left = bool(tree.missing_left[i]) if inner else None
                rows.append((t, i, int(tree.feature[i]), threshold, left, float(tree.value[i]), float(tree.cover[i]), float(tree.gain[i])))
        return spark.createDataFrame(rows, NODES)

    def save(self, spark: SparkSession, path: str) -> None:
        """Node table and a line of JSON under ``path`` (overwritten)."""
        self.node_table(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
        facts = json.dumps({"features": self.features, "base": self.base, "trees": len(self.trees)})
        spark.createDataFrame([(facts,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/facts")

    @staticmethod
    def load(spark: SparkSession, path: str) -> TreeEnsemble:
        facts = json.loads(spark.read.text(f"{path}/facts").first()["value"])
        return TreeEnsemble.of_nodes(facts["features"], facts["base"], spark.read.parquet(f"{path}/nodes").collect(), facts["trees"])

    @staticmethod
    def of_nodes(features: Sequence[str], base: float, rows, trees: int | None = None) -> TreeEnsemble:
        """From rows of a node table (as many as the model has nodes)."""
        rows = [r if isinstance(r, dict) else r.asDict() for r in rows]
        many = trees if trees is not None else 1 + max((r["tree"] for r in rows), default=-1)
        model = TreeEnsemble(list(features), float(base))
        for t in range(many):
            own = [r for r in rows if r["tree"] == t]
            tree = Tree.empty(int(math.log2(max(r["node"] for r in own) + 1)))
            for r in own:
                i = r["node"]
                tree.feature[i], tree.value[i], tree.cover[i], tree.gain[i] = r["feature"], r["value"], r["cover"], r.get("gain") or 0.0
                if r["feature"] >= 0:
                    tree.threshold[i], tree.missing_left[i] = r["threshold"], r["missing_left"]
            model.trees.append(tree)
        return model


def _sigmoid(m: np.ndarray) -> np.ndarray:
    e = np.exp(-np.abs(m))
    return np.maximum(e, m >= 0) / (1 + e)  # e is at most 1, which it gives way to where m is not negative


def _known(name: str) -> Column:
    c = F.col(f"`{name}`").cast("double")
    return F.when(F.isnan(c), None).otherwise(c)


def quantile_cuts(frame: DataFrame, features: Sequence[str], weight: str, max_bins: int = MAX_BINS, buckets: int = 64) -> list[np.ndarray]:
    """Ascending cuts of every feature, at most ``max_bins - 1``: all values but the least where there are few, else exact
    weighted quantiles.  Values are ranked by range bucket, so no task sorts a whole feature."""
    qs = [i / buckets for i in range(1, buckets)]
    row = frame.agg(*[F.percentile_approx(c, qs, 2000).alias(f"e{i}") for i, c in enumerate(features)]).first()
    edges = [sorted({float(x) for x in (row[f"e{i}"] or [])}) for i in range(len(features))]
    grouped = None
    for i, c in enumerate(features):
        # values are added up before their bucket is looked up, a feature at a time: -0.0 and 0.0 are one value
        own = frame.select((F.col(c) + 0.0).alias("value"), weight).filter("value is not null").groupBy("value").agg(F.sum(weight).alias("w"))
        own = own.select(F.lit(i).alias("f"), count_le(F.col("value"), edges[i]).alias("bucket"), "value", "w")
        grouped = own if grouped is None else grouped.union(own)
    grouped = grouped.persist()
    try:
        totals = grouped.groupBy("f", "bucket").agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("n"), F.min("value").alias("least")).collect()
        facts = []
        for i in range(len(features)):  # features x buckets rows
            own = sorted((r for r in totals if r["f"] == i), key=lambda r: r["bucket"])
            total, many, before = sum(r["w"] for r in own), sum(r["n"] for r in own), 0
            for r in own:
                facts.append((i, r["bucket"], before, total, many <= max_bins, own[0]["least"]))
                before += r["w"]
        if not facts:
            return [np.zeros(0) for _ in features]
        offsets = frame.sparkSession.createDataFrame(facts, "f int, bucket int, before long, total long, few boolean, least double")
        own = Window.partitionBy("f", "bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
        ranked = grouped.join(F.broadcast(offsets), ["f", "bucket"]).withColumn("cum", F.col("before") + F.sum("w").over(own))
        rank = lambda c: F.floor(c.cast("double") / F.col("total") * max_bins)
        chosen = F.col("few") | ((rank(F.col("cum")) > rank(F.col("cum") - F.col("w"))) & (rank(F.col("cum") - F.col("w")) < max_bins - 1))
        rows = ranked.filter(chosen & (F.col("value") > F.col("least"))).select("f", "value").collect()  # features x max_bins at most
    finally:
        grouped.unpersist()
    return [np.array(sorted(r["value"] for r in rows if r["f"] == i)) for i in range(len(features))]


def _to_blocks(cuts: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush():
            bins, y, w = (np.concatenate(x, axis=-1) for x in zip(*held))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (bins, y, w)], names=["bins", "y", "w"])

        for batch in batches:
            x = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.float64) for i in range(len(cuts))]
            bins = np.stack([np.where(np.isnan(v), MAX_BINS, np.searchsorted(c, v, side="right")).astype(np.uint8) for v, c in zip(x, cuts)])
            y = batch.column("_y").to_numpy(zero_copy_only=False).astype(np.uint8)
            held.append((bins, y, batch.column("_w").to_numpy(zero_copy_only=False).astype(np.float64)))
            if sum(len(h[1]) for h in held) >= BLOCK_ROWS:
                yield flush()
        if held:
            yield flush()

    return run


def _block(row, width: int, base: float) -> tuple:
    """Bins; weights, negative for label 0, as a table and a byte a row that points into it, or all where they are many;
    margins."""
    y, w = np.frombuffer(row["y"], np.uint8), np.frombuffer(row["w"], np.float64)
    signed = np.where(y == 1, w, -w)
    table, code = np.unique(signed, return_inverse=True)
    held = (table, code.astype(np.uint8)) if len(table) <= 256 else (None, signed)
    return np.frombuffer(row["bins"], np.uint8).reshape(width, len(y)), *held, np.full(len(y), base)


def _margins(bins: np.ndarray, margin: np.ndarray, trees: Sequence[Tree]) -> np.ndarray:
    for tree in trees:
        margin = margin + tree.value.take(tree.nodes_of_bins(bins).astype(np.intp))  # numpy is slow with other indices
    return margin


def _gradients(table: np.ndarray | None, held: np.ndarray, margin: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Integers (30 bits and a sign) that any order of adding keeps exact; ``scale``: units in a weight of 1."""
    if table is None:
        y, w = held > 0, np.abs(held)
    else:
        at = held.astype(np.intp)
        y, w = (table > 0).astype(np.float64).take(at), np.abs(table).take(at)
    p = _sigmoid(margin)
    h = 1 - p
    h *= p
    np.maximum(h, 1e-16, out=h)
    g = np.subtract(p, y, out=p)
    for x in (g, h):
        x *= w
        x *= scale
        np.rint(x, out=x)
    return g, h


def _paired(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Both in one array, to be added at once; sums stay below 2**53, so they are exact."""
    both = np.empty(len(g), np.complex128)
    both.real, both.imag = g, h
    return both


def _counted(bins: np.ndarray, tree: Tree, slots: np.ndarray) -> tuple[np.ndarray | None, np.ndarray]:
    """(rows in a node with a slot, or none for all; where in the sums each of them starts)."""
    start = (np.arange(bins.shape[1]) & (LANES - 1)) * (MAX_BINS + 1)
    if slots[0] >= 0:  # the root
        return None, start
    node = tree.nodes_of_bins(bins)
    inside = np.flatnonzero(np.logical_or.reduce([node == node.dtype.type(i) for i in np.flatnonzero(slots >= 0)]))
    return inside, start[: len(inside)] + (slots * (LANES * (MAX_BINS + 1))).take(node.take(inside).astype(np.intp))


def _bin_sums(bins: np.ndarray, both: np.ndarray, start: np.ndarray, many: int, sizes: Sequence[int]) -> np.ndarray:
    width = MAX_BINS + 1
    out, at = np.empty((2, many, sum(sizes)), np.int64), 0
    for f, size in enumerate(sizes):
        sums = np.zeros(many * LANES * width, np.complex128)
        np.add.at(sums, start + bins[f], both)
        sums = sums.reshape(many, LANES, width).sum(axis=1)
        for k, x in enumerate((sums.real, sums.imag)):
            out[k, :, at : at + size - 1], out[k, :, at + size - 1] = x[:, : size - 1], x[:, MAX_BINS]
        at += size
    return out


def _histogram(block, trees: Sequence[Tree], tree: Tree, slots: np.ndarray, sizes: Sequence[int], scale: float) -> np.ndarray:
    """(2, nodes, bins of all features in a row, ``sizes`` of each) sums of g and h over one block; ``trees``: those that its
    margins lack; ``slots``: place of each node that is counted, else -1.  A feature's last bin holds its missing values."""
    bins, table, held, margin = block
    inside, start = _counted(bins, tree, slots)
    if inside is not None:
        bins, held, margin = bins.take(inside, axis=1), held.take(inside), margin.take(inside)
    both = _paired(*_gradients(table, held, _margins(bins, margin, trees), scale))
    return _bin_sums(bins, both, start, int(slots.max()) + 1, sizes)


def _summed(blocks: RDD, trees: Sequence[Tree], tree: Tree, slots: np.ndarray, sizes: Sequence[int], scale: float) -> np.ndarray:
    """(2, nodes, features, bins)."""

    def run(part):
        total = None
        for block in part:
            one = _histogram(block, trees, tree, slots, sizes, scale)
            total = one if total is None else np.add(total, one, out=total)
        if total is not None:
            yield total

    parts = blocks.mapPartitions(run)
    # few partitions are added up by the driver as they come, many by rounds of tasks
    return _spread(parts.treeReduce(lambda a, b: a + b, 2) if blocks.getNumPartitions() > 32 else parts.reduce(lambda a, b: a + b), sizes)


def _spread(held: np.ndarray, sizes: Sequence[int]) -> np.ndarray:
    """A histogram of the bins that exist, with a place for each bin that may."""
    out, at = np.zeros((2, held.shape[1], len(sizes), MAX_BINS + 1), np.int64), 0
    for f, size in enumerate(sizes):
        out[:, :, f, : size - 1], out[:, :, f, MAX_BINS] = held[:, :, at : at + size - 1], held[:, :, at + size - 1]
        at += size
    return out


def best_splits(hist: np.ndarray, cuts: list[np.ndarray], unit: float, reg: float, min_child: float) -> list[dict | None]:
    """For each node of a histogram, its best split or none."""
    out: list[dict | None] = []
    many = np.array([len(c) for c in cuts])
    for g, h in zip(hist[0], hist[1]):
        G, H = int(g[0].sum()) * unit, int(h[0].sum()) * unit
        gl, hl = np.cumsum(g[:, :MAX_BINS], axis=1)[:, :-1], np.cumsum(h[:, :MAX_BINS], axis=1)[:, :-1]
        # side of missing values: left (0), right (1)
        gl, hl = (np.stack([x + m[:, MAX_BINS :], x], axis=-1) * unit for x, m in ((gl, g), (hl, h)))
        gr, hr = G - gl, H - hl
        gain = gl**2 / (hl + reg) + gr**2 / (hr + reg) - G**2 / (H + reg)
        open_ = (hl >= min_child) & (hr >= min_child) & (np.arange(MAX_BINS - 1) < many[:, None])[..., None]
        gain = np.where(open_, gain, -np.inf)
        at = int(np.argmax(gain))
        if not gain.size or not gain.flat[at] > LEAST_GAIN:
            out.append(None)
            continue
        f, cut, side = np.unravel_index(at, gain.shape)
        pick = (f, cut, side)
        out.append(
            {"feature": int(f), "cut": int(cut), "missing_left": side == 0, "gain": float(gain[pick]), "left": (gl[pick], hl[pick]), "right": (gr[pick], hr[pick])}
        )
    return out


def _sibling(i: int) -> int:
    return i + 1 if i % 2 else i - 1


def _lighter(tree: Tree, i: int) -> bool:
    mine, other = tree.cover[i], tree.cover[_sibling(i)]
    return bool(mine < other or (mine == other and i % 2))


def grow(summed, cuts: list[np.ndarray], depth: int, unit: float, rate: float, reg: float, min_child: float, gamma: float) -> Tree:
    """One tree; ``summed(tree, slots)`` gives the histogram of the nodes with a slot."""
    tree = Tree.empty(depth)
    open_nodes, parents, hist = [0], [], None
    for level in range(depth):
        # of two children the lighter one is counted; integers, so the other is exactly the rest of their parent
        counted = [i for i in open_nodes if level == 0 or _lighter(tree, i)]
        slots = np.full(len(tree.feature), -1)
        slots[counted] = np.arange(len(counted))
        part = summed(tree, slots)
        if level == 0:
            hist = part
        else:
            own, place = dict(zip(counted, np.moveaxis(part, 1, 0))), {i: k for k, i in enumerate(parents)}
            rest = lambda i: hist[:, place[(i - 1) // 2]] - own[_sibling(i)]  # noqa: B023, E731
            hist = np.stack([own[i] if i in own else rest(i) for i in open_nodes], axis=1)
        if level == 0:
            G, H = int(hist[0, 0, 0].sum()) * unit, int(hist[1, 0, 0].sum()) * unit
            tree.value[0], tree.cover[0] = -rate * G / (H + reg), H
        found, following = best_splits(hist, cuts, unit, reg, min_child), []
        for i, s in zip(open_nodes, found):
            if s is None or s["gain"] < gamma:
                continue
            tree.feature[i], tree.bin[i], tree.threshold[i] = s["feature"], s["cut"], cuts[s["feature"]][s["cut"]]
            tree.missing_left[i], tree.gain[i] = s["missing_left"], s["gain"]
            for child, (g, h) in ((2 * i + 1, s["left"]), (2 * i + 2, s["right"])):
                tree.value[child], tree.cover[child] = -rate * g / (h + reg), h
                following.append(child)
        parents, open_nodes = open_nodes, following
        if not open_nodes:
            break
    return tree


def fit_trees(
    train: DataFrame,
    features: Sequence[str],
    label: str,
    weight: str | None = None,
    rounds: int = 200,
    depth: int = 4,
    rate: float = 0.1,
    reg: float = 1.0,
    min_child: float = 1.0,
    gamma: float = 0.0,
    max_bins: int = MAX_BINS,
) -> TreeEnsemble:
    """``rounds`` trees of ``depth`` levels on the named columns."""
    if not 2 <= max_bins <= MAX_BINS:
        raise ValueError(f"max_bins {max_bins} is not within 2 and {MAX_BINS}")
    spark, names = train.sparkSession, [f"_f{i}" for i in range(len(features))]
    ship_package(spark)
    checkpoint_dir(spark)
    w = F.col(f"`{weight}`").cast("double") if weight else F.lit(1.0)
    frame = train.select(*[_known(c).alias(n) for c, n in zip(features, names)], F.col(f"`{label}`").cast("double").alias("_y"), w.alias("_w"))
    frame = ensure_parallelism(frame.filter("_y in (0, 1) and _w > 0"))
    frame = frame.withColumn("_q", F.greatest(F.lit(1), F.round(F.col("_w") * WEIGHT_UNIT)).cast("long")).persist()
    n, most, all_weight, positive = frame.agg(F.count(F.lit(1)), F.max("_w"), F.sum("_q"), F.sum(F.col("_q") * F.col("_y").cast("long"))).first()
    if not n:
        frame.unpersist()
        return TreeEnsemble(list(features), 0.0)
    share = min(max(positive / all_weight, 1e-6), 1 - 1e-6)
    model = TreeEnsemble(list(features), math.log(share / (1 - share)))
    cuts = quantile_cuts(frame.select(*names, "_q"), names, "_q", max_bins)
    scale = 2.0 ** min(30, 61 - int(n).bit_length()) / most  # integers of n rows fit a long
    path = scratch_path(spark, "tree-blocks")
    frame.select(*names, "_y", "_w").mapInArrow(_to_blocks(cuts), "bins binary, y binary, w binary").write.parquet(path)
    frame.unpersist()
    width, start, sizes = len(names), model.base, [len(c) + 2 for c in cuts]
    held, given = spark.read.parquet(path), (cuts, depth, 1 / scale, rate, reg, min_child, gamma)
    if n <= TASK_ROWS:

        def train(rows):
            yield from _boost([_block(r, width, start) for r in rows], rounds, sizes, scale, given)

        model.trees = held.coalesce(1).rdd.mapPartitions(train).collect()
        return model
    cores = spark.sparkContext.defaultParallelism
    stored = held.repartition(min(cores, math.ceil(n / BLOCK_ROWS))).rdd
    blocks, former, cut = stored.map(lambda r: _block(r, width, start)).persist(HELD), None, 0
    try:
        for t in range(rounds):
            now, lacking = blocks, model.trees[t - t % KEPT : t]
            model.trees.append(grow(lambda tree, slots: _summed(now, lacking, tree, slots, sizes, scale), *given))  # noqa: B023
            if former is not None:  # the first level has computed the blocks that came from these
                former.unpersist()
                former = None
            if (t + 1) % KEPT == 0:
                former, blocks = blocks, _renewed(blocks, model.trees[-KEPT:]).persist(HELD)
                if t + 1 - cut >= CUT:
                    blocks.checkpoint()
                    cut = t + 1
    finally:
        for rdd in (former, blocks):
            if rdd is not None:
                rdd.unpersist()
    return model


def _boost(blocks: list[tuple], rounds: int, sizes: Sequence[int], scale: float, given: tuple) -> Iterator[Tree]:
    """The trees of a table that one task holds: the same levels without a job for each, and gradients taken once a tree."""
    margins = [block[3] for block in blocks]
    for _ in range(rounds):
        pairs = [_paired(*_gradients(table, held, margin, scale)) for (_, table, held, _), margin in zip(blocks, margins)]

        def summed(tree: Tree, slots: np.ndarray) -> np.ndarray:
            total = None
            for (bins, *_), both in zip(blocks, pairs):  # noqa: B023
                inside, start = _counted(bins, tree, slots)
                if inside is not None:
                    bins, both = bins.take(inside, axis=1), both.take(inside)
                one = _bin_sums(bins, both, start, int(slots.max()) + 1, sizes)
                total = one if total is None else np.add(total, one, out=total)
            return _spread(total, sizes)

        tree = grow(summed, *given)
        margins = [_margins(block[0], margin, [tree]) for block, margin in zip(blocks, margins)]
        yield tree


def _renewed(blocks: RDD, trees: Sequence[Tree]) -> RDD:
    return blocks.map(lambda x: (*x[:3], _margins(x[0], x[3], trees)))
