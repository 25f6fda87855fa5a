"""Feature attribution for boosted-tree models.

Path-dependent tree SHAP: the value of a feature set S is the tree's output
with features in S fixed to the row's values and the others integrated out by
training cover (the sum of hessians) at each split.  A tree's output is a sum over
leaves of ``v_leaf * prod(path factors)``, and each leaf term only involves
the <= depth features on its path, so Shapley values are computed per leaf
term over those few features (other features are null players) and summed.
A leaf's part hangs only on which of those features take its path's steps, so
it is worked out once for every such set, and rows look it up.  Exact, and
cheap for shallow trees.

The leaves' tables are captured by the ``mapInArrow`` closure; rows stream
through in Arrow batches.  Output is long: (keys..., feature, contribution),
with sum(contribution) + base = the model margin.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from costlens.operators.trees import TreeEnsemble
from costlens.session import ship_package

#: Rows whose contributions are added up at once.
BLOCK = 8192
#: A split on the way to a leaf: feature, threshold, the leaf's side, side of missing values, share of the cover.
Step = tuple[int, float, bool, bool, float]


def leaf_terms(model: TreeEnsemble) -> list[tuple[float, list[Step]]]:
    """Per leaf: its value and the splits that lead to it."""
    terms = []
    for tree in model.trees:

        def walk(i: int, path: list) -> None:
            if tree.feature[i] < 0:
                terms.append((float(tree.value[i]), path))
                return
            for child, left in ((2 * i + 1, True), (2 * i + 2, False)):
                share = float(tree.cover[child] / tree.cover[i]) if tree.cover[i] else 0.5
                walk(child, [*path, (int(tree.feature[i]), float(tree.threshold[i]), left, bool(tree.missing_left[i]), share)])

        walk(0, [])
    return terms


def _leaf_table(v: float, path: list[Step]) -> tuple[list[int], np.ndarray, float]:
    """(features on the path, their contributions for every set of features whose steps a row takes, base value).  Bit b of a
    set stands for the b-th of the features."""
    feats = sorted({step[0] for step in path})
    r = [math.prod(step[4] for step in path if step[0] == f) for f in feats]
    many = len(feats)
    out = np.zeros((1 << many, many))
    for taken in range(1 << many):
        s = [float(taken >> b & 1) for b in range(many)]
        for i in range(many):
            others, acc = [b for b in range(many) if b != i], 0.0
            for size in range(many):
                wgt = math.factorial(size) * math.factorial(many - size - 1) / math.factorial(many)
                for sub in combinations(others, size):
                    acc += wgt * math.prod(s[b] if b in sub else r[b] for b in others)
            out[taken, i] = v * acc * (s[i] - r[i])
    return feats, out, v * math.prod(r)


def shap_tables(terms) -> tuple[list[tuple], float]:
    """For every leaf its path and table of contributions, from which all rows are read; and the base value."""
    tables, base = [], 0.0
    for v, path in terms:
        feats, table, own = _leaf_table(v, path)
        base += own
        if feats:
            tables.append((path, feats, np.ascontiguousarray(table.T)))
    return tables, base


def shap_rows(x: np.ndarray, tables) -> np.ndarray:
    """n x d contributions.  A leaf's part of a row hangs only on which of its path's features take the path's steps, so it is
    looked up; a split that leaves share is compared once."""
    n, d = x.shape
    phi = np.zeros((d, n))
    for at in range(0, n, BLOCK):
        columns = np.ascontiguousarray(x[at : at + BLOCK].T)
        missing, many = np.isnan(columns), columns.shape[1]
        part, sides = phi[:, at : at + BLOCK], {}
        for path, feats, table in tables:
            taken = {}
            for f, thr, left, missing_left, _ in path:
                key = (f, thr, missing_left)
                if key not in sides:
                    goes_left = columns[f] < thr  # missing values compare as false
                    sides[key] = goes_left | missing[f] if missing_left else goes_left
                same = sides[key] if left else ~sides[key]
                taken[f] = taken[f] & same if f in taken else same
            place = np.zeros(many, np.intp)
            for b, f in enumerate(feats):
                place += taken[f].astype(np.intp) << b
            for b, f in enumerate(feats):
                part[f] += table[b].take(place)
    return phi.T


def shap_matrix(x: np.ndarray, terms) -> tuple[np.ndarray, float]:
    """(n x d contributions, base value)."""
    tables, base = shap_tables(terms)
    return shap_rows(x, tables), base


def tree_shap(model: TreeEnsemble, df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, float]:
    """Long SHAP table for the rows of ``df`` (keys kept) and the base value."""
    ship_package(df.sparkSession)
    names = model.features
    tables, base = shap_tables(leaf_terms(model))
    values = F.array(*[F.col(f"`{c}`").cast("double") for c in names]).alias("_x")
    pre = df.select(*[F.col(f"`{c}`") for c in keys], values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, d = batch.num_rows, len(names)
            if not n:
                continue
            x = batch.column(len(keys)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            phi = shap_rows(x.reshape(n, d), tables)
            rows = pa.array(np.repeat(np.arange(n), d))
            feature = pa.DictionaryArray.from_arrays(np.tile(np.arange(d, dtype=np.int32), n), pa.array(names, pa.string())).cast(pa.string())
            columns = [batch.column(i).take(rows) for i in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*columns, feature, pa.array(np.ascontiguousarray(phi).ravel())], names=[*keys, "feature", "contribution"])

    own = [StructField("feature", StringType()), StructField("contribution", DoubleType())]
    out = pre.mapInArrow(run, StructType([*pre.schema.fields[:-1], *own]))
    return out, base + model.base


def margin(model: TreeEnsemble, df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return model.margin(df).select(*keys, "margin")
