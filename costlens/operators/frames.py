"""Small DataFrame combinators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def attach_one_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """Append the columns of a frame that is known to hold exactly one row
    (a global aggregate) to every row of ``df``: broadcast equi-join on a
    constant key, so no cartesian product is planned."""
    k = "_one_row_key"
    return df.withColumn(k, F.lit(1)).join(F.broadcast(row.withColumn(k, F.lit(1))), k).drop(k)


def join_small(df: DataFrame, small: DataFrame, on: Sequence[str], limit: int = 10_000) -> DataFrame:
    """Equi-join with a frame that is usually small (a row a group): computed once, counted, and broadcast if it has at
    most ``limit`` rows; otherwise Spark joins as it sees fit."""
    small = materialize(small)
    return df.join(F.broadcast(small) if small.count() <= limit else small, list(on))


def and_(conditions: Sequence[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


#: A key of more than this share of all rows is looked up by broadcast; so there are this many such keys at most.
HOT_SHARE = 1000


def looked_up(df: DataFrame, table: DataFrame, keys: Sequence[str], many: str) -> DataFrame:
    """``df`` with the columns of ``table``'s row of the same ``keys`` (nulls match; without one, nulls).

    ``table`` has one row a key and ``many``, the number of ``df``'s rows that hold it (read twice: pass a computed one;
    not returned).  Keys of more than one in ``HOT_SHARE`` of those are broadcast, and their rows are spread over all tasks
    in the shuffle that brings the others to their key."""
    own = [c for c in table.columns if c not in keys and c != many]
    total = table.agg(F.coalesce(F.sum(many), F.lit(0))).first()[0]
    hot = F.col(many) * HOT_SHARE > F.lit(total)

    def side(rows: DataFrame, tag: str) -> DataFrame:
        return rows.select(*[F.col(f"`{k}`").alias(f"_{tag}{i}") for i, k in enumerate(keys)], F.struct(*own).alias(f"_{tag}"), F.lit(0).alias(f"_{tag}_salt"))

    same = lambda tag: [F.col(f"`{k}`").eqNullSafe(F.col(f"_{tag}{i}")) for i, k in enumerate(keys)]
    out = df.join(F.broadcast(side(table.filter(hot), "hot")), and_(same("hot")), "left")
    spread = 1 + F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns], F.monotonically_increasing_id()), F.lit(1 << 20))
    out = out.withColumn("_salt", F.when(F.col("_hot_salt").isNull(), 0).otherwise(spread).cast("int"))
    cold = side(table.filter(~hot), "cold").hint("shuffle_hash")
    out = out.join(cold, and_([*same("cold"), F.col("_salt") == F.col("_cold_salt")]), "left")
    found = F.coalesce("_hot", "_cold")
    return out.select(*[F.col(f"`{c}`") for c in df.columns], *[found[c].alias(c) for c in own])


def side_by_side(*rows: DataFrame) -> DataFrame:
    out = rows[0]
    for r in rows[1:]:
        out = attach_one_row(out, r)
    return out


def ensure_parallelism(df: DataFrame) -> DataFrame:
    """Iterative learners scan their input many times; if it has fewer
    partitions than the cluster has cores (e.g. one small file), spread it once.
    On a large input this is a no-op: file splits already give the parallelism."""
    sc = df.sparkSession.sparkContext
    target = sc.defaultParallelism
    if df.rdd.getNumPartitions() < target:
        return df.repartition(target)
    return df


def materialize(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder, computed once.

    ``checkpoint()`` alone evaluates its input twice (once to count, once to
    write); persisting around it makes the write read the cached blocks.  The
    result no longer depends on its lineage, so it survives executor loss."""
    from costlens.session import checkpoint_dir

    checkpoint_dir(df.sparkSession)
    df.persist()
    try:
        return df.checkpoint(eager=True)
    finally:
        df.unpersist()
