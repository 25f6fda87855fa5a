"""Centroid clustering (Lloyd's rounds) in exact integers, filtered by a PCA rotation.

Vectors become integers (``floor(256 x)``), and everything that decides is computed in integers, so the result is the same
in any layout.  The work is saved by a *filter*: the vectors are rotated once about their mean by the eigenvectors of their
covariance, and each keeps its ``lead`` leading rotated coordinates and the norm of the rest.  A rotation keeps distances,
and two remainders of norms a and b lie at least |a - b| apart, so

    (distance of the leading coordinates)^2 + (difference of the residual norms)^2 <= squared distance

for every vector and centroid.  A centroid whose bound exceeds the integer distance of the vector to its most promising
centroid cannot be nearest; the survivors are measured in integers.  The bound is in floating point and is lowered by
``SLACK`` of the norms, far beyond its rounding errors, so no nearest centroid (nor a tie) is filtered away.

Sizes: the driver sees the covariance (dim x dim), the centroids and their sums (k x dim), nothing of the number of
vectors.  The rotated table is written once to the shared folder and read by every round.

Defined results: vectors of another length, null vectors, and those with a null, NaN or infinite component are not kept
and give no row; a null ``vec_id`` is hashed as the empty string and its vector is kept; rows that repeat a ``vec_id`` each
get their row (equal hashes are ordered by id, nulls first, then components); components beyond +-2**24 (inputs beyond
65,536) are clamped there, so that distances fit a long; fewer vectors than centroids give that many centroids; an
inertia beyond a long is null; no kept vectors, no rows; extra columns are ignored."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from costlens.llm.common import on_workers, saved

DIM, CENTROIDS, ROUNDS, LEAD = 64, 40, 5, 16
SCALE, SEED = 256, "2"
LIMIT = 1 << 24
SLACK = 1e-9
#: Vectors bounded at once, and pairs measured at once.
BLOCK, PAIRS = 4096, 1 << 15


@dataclass(frozen=True)
class Rotation:
    mean: np.ndarray
    axes: np.ndarray  # columns, by falling variance
    lead: int

    def apply(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leading coordinates and the norm of the others."""
        turned = (vectors.astype(np.float64) - self.mean) @ self.axes
        return turned[:, : self.lead], np.sqrt(np.square(turned[:, self.lead :]).sum(1))


def integers(vectors: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """vec_id, v (``dim`` integers) of the vectors that are kept."""
    bad = F.exists("embedding", lambda x: F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(True)))
    kept = vectors.filter(F.coalesce(F.size("embedding") == dim, F.lit(False))).filter(~bad)
    whole = F.transform(
        "embedding",
        lambda x: F.floor(F.greatest(F.lit(float(-LIMIT)), F.least(F.lit(float(LIMIT)), x.cast("double") * scale))).cast("int"),
    )
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _rows(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(values.reshape(-1), kind))


def _moments(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many, moments = 0, np.zeros((dim + 1, dim))
        for batch in batches:
            v = _matrix(batch.column("v"), dim).astype(np.float64)
            many += len(v)
            moments[dim] += v.sum(0)
            moments[:dim] += v.T @ v
        if many:
            flat = np.append(moments.reshape(-1), many)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat, pa.float64())], names=["place", "part"])

    return run


def rotation(kept: DataFrame, dim: int = DIM, lead: int = LEAD) -> Rotation | None:
    """Principal axes of all kept vectors (none without any): second moments summed by tasks."""
    on_workers(kept.sparkSession)
    sums = kept.select("v").mapInArrow(_moments(dim), "place int, part double").groupBy("place").agg(F.sum("part").alias("total"))
    flat = np.zeros(dim * (dim + 1) + 1)
    for place, total in sums.collect():  # dim * (dim + 1) + 1 rows at most
        flat[place] = total
    many = flat[-1]
    if not many:
        return None
    moments = flat[:-1].reshape(dim + 1, dim)
    mean = moments[dim] / many
    _, axes = np.linalg.eigh(moments[:dim] / many - np.outer(mean, mean))
    return Rotation(mean, np.ascontiguousarray(axes[:, ::-1]), min(lead, dim))


def rotated(kept: DataFrame, turn: Rotation) -> DataFrame:
    """vec_id, v, lead (leading rotated coordinates), rest (norm of the others); written to the shared folder."""
    dim = len(turn.mean)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lead, rest = turn.apply(_matrix(batch.column("v"), dim))
            columns = [batch.column("vec_id"), batch.column("v").cast(pa.list_(pa.int32())), _rows(lead, pa.float64()), pa.array(rest, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "v", "lead", "rest"])

    schema = "vec_id long, v array<int>, lead array<double>, rest double"
    return saved(kept.mapInArrow(run, schema), "rotated-vectors")


def nearest(vectors: np.ndarray, lead: np.ndarray, rest: np.ndarray, centers: np.ndarray, turn: Rotation) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid (the smaller number on ties), squared distance, pairs measured; exact in integers."""
    center_lead, center_rest = turn.apply(centers)
    center_norm = np.square(center_lead).sum(1)
    center_size = np.square(centers.astype(np.float64) - turn.mean).sum(1)
    cluster, distance, measured = np.zeros(len(vectors), np.int64), np.zeros(len(vectors), np.int64), 0
    for at in range(0, len(vectors), BLOCK):
        v, a, r = vectors[at : at + BLOCK].astype(np.int64), lead[at : at + BLOCK], rest[at : at + BLOCK]
        norm = np.square(a).sum(1)
        bound = norm[:, None] - 2 * (a @ center_lead.T) + center_norm + np.square(r[:, None] - center_rest)
        bound -= SLACK * ((norm + r * r)[:, None] + center_size + 1)
        first = bound.argmin(1)
        known = np.square(v - centers[first]).sum(1)
        row, center = np.nonzero(bound <= known[:, None])  # holds (row, first): its bound is below its distance
        measured += len(v) + len(row)
        exact = np.empty(len(row), np.int64)
        for k in range(0, len(row), PAIRS):
            exact[k : k + PAIRS] = np.square(v[row[k : k + PAIRS]] - centers[center[k : k + PAIRS]]).sum(1)
        begin = np.searchsorted(row, np.arange(len(v)))
        least = np.minimum.reduceat(exact, begin)
        ties = np.flatnonzero(exact == least[row])
        cluster[at : at + BLOCK] = center[ties[np.searchsorted(row[ties], np.arange(len(v)))]]
        distance[at : at + BLOCK] = least
    return cluster, distance, measured


def _blocks(batches: Iterator[pa.RecordBatch], dim: int, turn: Rotation, centers: np.ndarray):
    for batch in batches:
        if batch.num_rows:
            v, lead = _matrix(batch.column("v"), dim), _matrix(batch.column("lead"), turn.lead)
            yield batch, v, nearest(v, lead, batch.column("rest").to_numpy(zero_copy_only=False), centers, turn)


def _sums(turn: Rotation, centers: np.ndarray):
    """Component sums and sizes (place -1) of the clusters in one partition."""
    dim = centers.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((len(centers), dim + 1), np.int64)
        for _, v, (cluster, _, _) in _blocks(batches, dim, turn, centers):
            order = np.argsort(cluster, kind="stable")
            own, begin, many = np.unique(cluster[order], return_index=True, return_counts=True)
            totals[own, 1:] += np.add.reduceat(v[order].astype(np.int64), begin, axis=0)
            totals[own, 0] += many
        held = np.flatnonzero(totals[:, 0])
        columns = [np.repeat(held, dim + 1), np.tile(np.arange(-1, dim), len(held)), totals[held].reshape(-1)]
        kinds = (pa.int32(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["cluster", "place", "part"])

    return run


def moved(table: DataFrame, turn: Rotation, centers: np.ndarray) -> np.ndarray:
    """One round: every vector to its nearest centroid, then each non-empty centroid to the floor of its vectors' mean."""
    parts = table.select("v", "lead", "rest").mapInArrow(_sums(turn, centers), "cluster int, place int, part long")
    sums = parts.groupBy("cluster", "place").agg(F.sum(F.col("part").cast("decimal(20,0)")).alias("total"))
    found = {(r["cluster"], r["place"]): int(r["total"]) for r in sums.collect()}  # k * (dim + 1) rows at most
    out = centers.copy()
    for c in range(len(centers)):
        if many := found.get((c, -1)):
            out[c] = [found[c, place] // many for place in range(centers.shape[1])]
    return out


def assigned(table: DataFrame, turn: Rotation, centers: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance (squared)."""
    dim = centers.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, (cluster, distance, _) in _blocks(batches, dim, turn, centers):
            columns = [batch.column("vec_id"), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance"])

    return table.mapInArrow(run, "vec_id long, cluster int, distance long")


def first_centroids(table: DataFrame, k: int = CENTROIDS, seed: str = SEED) -> np.ndarray:
    """The ``k`` vectors with the smallest hashes."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    chosen = table.select("vec_id", "v", name.alias("_h")).orderBy("_h", "vec_id", "v").limit(k).collect()
    return np.array([r["v"] for r in chosen], np.int64)


def fit(table: DataFrame, turn: Rotation, k: int = CENTROIDS, rounds: int = ROUNDS, seed: str = SEED) -> np.ndarray:
    """Centroids (integers) after ``rounds`` rounds over a table made by ``rotated``."""
    on_workers(table.sparkSession)
    centers = first_centroids(table, k, seed)
    for _ in range(rounds):
        centers = moved(table, turn, centers)
    return centers


def centroid_sha256(center: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in center).encode()).hexdigest()


OUT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def clusters(
    vectors: DataFrame, dim: int = DIM, k: int = CENTROIDS, rounds: int = ROUNDS, lead: int = LEAD, scale: int = SCALE, seed: str = SEED
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector."""
    spark: SparkSession = vectors.sparkSession
    kept = integers(vectors, dim, scale)
    turn = rotation(kept, dim, lead)
    if turn is None:
        return spark.createDataFrame([], OUT)
    table = rotated(kept, turn)
    centers = fit(table, turn, k, rounds, seed)
    found = saved(assigned(table, turn, centers), "assigned-vectors")
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("total")).collect()  # k rows at most
    least, total = {r["cluster"]: int(r["total"]) for r in sums}, sum(int(r["total"]) for r in sums)
    fits = lambda x: x if x < 1 << 63 else None
    facts = [(c, fits(x), fits(total), centroid_sha256(centers[c])) for c, x in least.items()]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(dim: int = DIM, k: int = CENTROIDS, rounds: int = ROUNDS) -> str:
    """DuckDB SQL of the same result: every vector against every centroid."""
    parts = [
        f"""WITH base AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, vec_id NULLS FIRST, v) - 1 AS c, v
  FROM (SELECT vec_id, v, sha256('{SEED}:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h FROM base)
  QUALIFY row_number() OVER (ORDER BY h, vec_id NULLS FIRST, v) <= {k})"""
    ]
    for i in range(rounds + 1):
        parts.append(
            f"""a{i} AS MATERIALIZED (
  SELECT r, min(key) % {k} AS c, min(key) // {k} AS d
  FROM (SELECT r, {k} * CAST(list_inner_product(b.v, b.v) + list_inner_product(q.v, q.v) - 2 * list_inner_product(b.v, q.v) AS BIGINT) + c AS key
        FROM base b, c{i} q)
  GROUP BY r)"""
        )
        if i < rounds:
            parts.append(
                f"""s{i} AS MATERIALIZED (
  SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n
  FROM (SELECT c, unnest(range(1, {dim + 1})) AS i, unnest(CAST(v AS BIGINT[])) AS x FROM a{i} JOIN base USING (r))
  GROUP BY c, i),
c{i + 1} AS MATERIALIZED (
  SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY i) AS v FROM s{i} GROUP BY c
  UNION ALL SELECT c, v FROM c{i} WHERE c NOT IN (SELECT c FROM a{i}))"""
            )
    return ",\n".join(parts) + f"""
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(CAST(q.v AS BIGINT[]), ',')) AS centroid_sha256
FROM a{rounds} JOIN base b USING (r) JOIN c{rounds} q USING (c)
"""
