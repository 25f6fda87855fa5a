"""Global order statistics without a single-partition sort.

Several operators need a running total in a global order (average precision,
ROC-AUC, the chronological split, exact percentiles).  A window with no
partition would pull every row into one task; instead:

1. the caller groups the rows by the ordering value first (map-side combine,
   so a hot value becomes one row);
2. approximate quantiles of the ordering value give range-bucket edges
   (a bounded list collected to the driver);
3. per-bucket totals (at most ``n_buckets`` rows per group) give each bucket's
   offset with a window over that tiny frame;
4. a window partitioned by bucket adds the offset to the in-bucket running sum.

Every step is partitioned and the same at every size; the only driver traffic is the
edge list and, for selections, the handful of rows that answer the question.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from costlens.functions import lex_less_equal
from costlens.functions.columns import epoch_micros
from costlens.session import shuffle_partitions

def _bucket_count(df: DataFrame, n_buckets: int | None) -> int:
    if n_buckets:
        return max(1, int(n_buckets))
    return min(65536, max(16, 4 * shuffle_partitions(df.sparkSession)))


#: Strings looked at for each bucket, and the characters of one that are looked at.
LOOKED_AT, LOOKED_CHARS = 16, 1000


def _splitters(df: DataFrame, text: Column, n_buckets: int) -> list[str]:
    """At most ``n_buckets`` hex strings that cut the values of ``text`` (hex) into about equal parts: every sixteenth of the distinct values of a
    sample chosen by hash (the same in every layout), cut to what tells it from the one before.  They only balance."""
    values = df.select(F.substring(text, 1, 2 * LOOKED_CHARS).alias("v"), F.xxhash64(text).alias("h")).filter(F.col("v").isNotNull())
    share = min(1.0, LOOKED_AT * n_buckets / max(1, values.count()))
    chosen = values.filter(F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30))).select("v")
    held = sorted({r["v"] for r in chosen.collect()})
    out: list[str] = []
    for i in sorted({i * len(held) // n_buckets for i in range(1, n_buckets)} if held else ()):
        at, before = held[i], held[i - 1] if i else ""
        same = next((j for j, (x, y) in enumerate(zip(at, before)) if x != y), min(len(at), len(before)))
        out.append(at[: same // 2 * 2 + 2])  # whole bytes
    return [x for x in out if x]


def _place(text: Column, splitters: Sequence[str]) -> Column:
    """How many of the sorted ``splitters`` are at most ``text``: a binary search in one constant array."""
    if not splitters:
        return F.lit(0)
    held = F.split(F.lit(",".join(splitters)), ",")

    def step(s: Column, _) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        low = F.element_at(held, F.least(mid + 1, F.lit(len(splitters)))) <= s["v"]
        over = s["lo"] >= s["hi"]
        lo, hi = F.when(~over & low, mid + 1).otherwise(s["lo"]), F.when(~over & ~low, mid).otherwise(s["hi"])
        return F.struct(lo.alias("lo"), hi.alias("hi"), s["v"].alias("v"))

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(splitters)).alias("hi"), text.alias("v"))
    steps = F.sequence(F.lit(1), F.lit(len(splitters).bit_length()))
    return F.when(text.isNotNull(), F.aggregate(steps, start, step, lambda s: s["lo"]))


def order_key(df: DataFrame, order_col: str, n_buckets: int | None = None) -> Column:
    """A double that never decreases in the order of ``order_col`` (any orderable atomic type; null first, NaN last).

    It only deals values to range buckets; inside a bucket the column itself orders.  A string's or binary's key is its
    place among splitters taken from the values themselves, whatever prefixes they share."""
    c, kind = F.col(order_col), df.schema[order_col].dataType.typeName()
    if kind in ("string", "binary", "varchar", "char"):
        text = F.hex(c.cast("binary"))  # hex orders as the bytes do
        key = _place(text, _splitters(df, text, _bucket_count(df, n_buckets))).cast("double")
    elif kind == "timestamp":
        key = F.unix_micros(c).cast("double")
    elif kind == "timestamp_ntz":
        key = epoch_micros(c).cast("double")
    elif kind == "date":
        key = F.unix_date(c).cast("double")
    elif kind == "boolean":
        key = c.cast("int").cast("double")
    else:
        key = c.cast("double")
    key = F.when(F.isnan(key), F.lit(float("inf"))).otherwise(key)
    return F.coalesce(key, F.lit(float("-inf")))


def range_edges(df: DataFrame, order_col: str, n_buckets: int | None = None, key: Column | None = None) -> list[float]:
    """Sorted distinct approximate quantile edges of the column's order key."""
    b = _bucket_count(df, n_buckets)
    if b <= 1:
        return []
    qs = [i / b for i in range(1, b)]
    key = order_key(df, order_col, n_buckets) if key is None else key
    finite = df.select(key.alias("k")).filter(F.abs("k") < F.lit(float("inf")))
    row = finite.agg(F.percentile_approx("k", qs, max(10_000, 10 * b)).alias("e")).first()
    return sorted({float(x) for x in (row["e"] or []) if x is not None})


def bucketize(df: DataFrame, key: Column, edges: Sequence[float], out: str) -> DataFrame:
    """Range bucket = number of edges <= key, by the JVM's binary search; every row keeps a bucket."""
    if not len(edges):
        return df.withColumn(out, F.lit(0))
    from pyspark.ml.feature import Bucketizer

    tmp = f"{out}__d"
    bz = Bucketizer(splits=[float("-inf"), *edges, float("inf")], inputCol=tmp, outputCol=out, handleInvalid="error")
    return bz.transform(df.withColumn(tmp, key)).drop(tmp).withColumn(out, F.col(out).cast("int"))


def prefix_sums(
    df: DataFrame,
    order_col: str,
    sum_cols: Sequence[str],
    *,
    by: Sequence[str] = (),
    descending: bool = False,
    n_buckets: int | None = None,
    prefix: str = "cum_",
    totals_prefix: str = "",
    edges_from: DataFrame | None = None,
) -> DataFrame:
    """Add ``cum_<c>``: inclusive running total of each ``c`` in ``order_col`` order.

    ``df`` should hold one row per distinct (by, order value); rows with equal
    order values would get an arbitrary relative order.  ``edges_from`` takes the
    bucket edges from another (cheaper) frame with the same value distribution;
    any edges give exact sums, only the bucket balance depends on them.
    ``totals_prefix`` also adds each group's totals under that prefix.
    """
    by = list(by)
    key = order_key(df, order_col, n_buckets)
    edges = range_edges(edges_from if edges_from is not None else df, order_col, n_buckets, key)
    nb = len(edges)
    dfb = bucketize(df, key, edges, "_bkt")
    if descending:
        dfb = dfb.withColumn("_bkt", F.lit(nb) - F.col("_bkt"))
    totals = dfb.groupBy(*by, "_bkt").agg(*[F.sum(c).alias(f"_t_{c}") for c in sum_cols])
    # totals has at most (nb + 1) rows per group: the windows over it are tiny.
    w_all = Window.partitionBy(*by)
    w_tot = w_all.orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(b).alias(f"_g{i}") for i, b in enumerate(by)],
        F.col("_bkt").alias("_b"),
        *[F.coalesce(F.sum(f"_t_{c}").over(w_tot), F.lit(0)).alias(f"_o_{c}") for c in sum_cols],
        *[F.sum(f"_t_{c}").over(w_all).alias(f"{totals_prefix}{c}") for c in sum_cols if totals_prefix],
    )
    if not by:
        offsets = F.broadcast(offsets)  # bounded by the number of buckets
    same = [F.col("_bkt") == F.col("_b"), *[F.col(b).eqNullSafe(F.col(f"_g{i}")) for i, b in enumerate(by)]]
    joined = dfb.join(offsets, on=_and(same), how="inner").drop("_b", *[f"_g{i}" for i in range(len(by))])
    order = F.col(order_col).desc() if descending else F.col(order_col).asc()
    w = Window.partitionBy(*by, "_bkt").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = joined
    for c in sum_cols:
        out = out.withColumn(f"{prefix}{c}", F.col(f"_o_{c}") + F.sum(c).over(w))
    return out.drop("_bkt", *[f"_o_{c}" for c in sum_cols])


@dataclass(frozen=True)
class Bound:
    """A value of a column as text that its type reads back exactly, so that no driver-side type is involved."""

    text: str | None
    kind: str

    def lit(self) -> Column:
        if self.text is None:
            return F.lit(None).cast(self.kind)
        if self.kind == "timestamp":
            return F.timestamp_micros(F.lit(int(self.text)))
        if self.kind == "binary":
            return F.unhex(F.lit(self.text))
        return F.lit(self.text).cast(self.kind)

    @staticmethod
    def text_of(df: DataFrame, name: str) -> Column:
        kind = df.schema[name].dataType.simpleString()
        c = F.col(name)
        return (F.unix_micros(c) if kind == "timestamp" else F.hex(c) if kind == "binary" else c).cast("string")


def select_ranks(
    grouped: DataFrame, order_col: str, count_col: str, ks: Sequence[int], n_buckets: int | None = None
) -> list[dict]:
    """For each 1-based rank k, the value (a :class:`Bound`) of ``grouped`` (one row per distinct value, ``count_col``
    rows each) that holds the k-th smallest element, its count, and ``before`` = number of elements with a smaller
    value: a distributed prefix sum of which only the rows that answer come to the driver."""
    ks = [int(k) for k in ks]
    if not ks:
        return []
    ps = prefix_sums(grouped, order_col, [count_col], n_buckets=n_buckets)
    cum = F.col(f"cum_{count_col}")
    before = cum - F.col(count_col)
    hit = None
    for k in ks:
        cond = (before < F.lit(k)) & (cum >= F.lit(k))
        hit = cond if hit is None else hit | cond
    kind = grouped.schema[order_col].dataType.simpleString()
    rows = ps.filter(hit).select(
        Bound.text_of(grouped, order_col).alias("text"), F.col(count_col).alias("count"), before.alias("before")
    ).collect()
    out = []
    for k in ks:
        for r in rows:
            if r["before"] < k <= r["before"] + r["count"]:
                out.append({"k": k, "value": Bound(r["text"], kind), "count": r["count"], "before": r["before"]})
                break
    return out


def boundary(df: DataFrame, cols: Sequence[str], k: int, n_buckets: int | None = None) -> tuple[list[Bound], int, int]:
    """(bounds, left, tied): the rows that are lexicographically at most ``bounds`` (null first) are the first ``k``
    if ``left`` is 0; otherwise ``tied`` rows equal ``bounds`` in all ``cols`` and ``left`` of them belong to the first k.

    Refines level by level: the k-th value of c0, then, only among the rows
    tied on it, the residual rank on c1, and so on.  Each level is an exact
    distributed selection; the rows carried to the next level shrink to one
    value's tie group, and the filter on it is pushed to the scan.
    """
    if k <= 0:
        return [], 0, 0
    bounds: list[Bound] = []
    cur, tied = df, 0
    for c in cols:
        grouped = cur.groupBy(c).agg(F.count(F.lit(1)).alias("_n"))
        hit = select_ranks(grouped, c, "_n", [k], n_buckets=n_buckets)
        if not hit:
            raise ValueError(f"rank {k} exceeds the row count")
        h = hit[0]
        bounds.append(h["value"])
        k, tied = k - h["before"], h["count"]
        if k == tied:
            return bounds, 0, tied
        cur = cur.filter(F.col(c).eqNullSafe(h["value"].lit()))
    return bounds, k, tied


def kth_tuple(df: DataFrame, cols: Sequence[str], k: int, n_buckets: int | None = None) -> list[Bound]:
    """Values (v0, .., vL) such that exactly ``k`` rows satisfy
    (c0, .., cL) <= (v0, .., vL) lexicographically; ``cols`` must order all rows."""
    bounds, left, _ = boundary(df, cols, k, n_buckets)
    if left:
        raise ValueError("tie columns do not form a unique key: cannot place an exact boundary")
    return bounds


def mark_first(df: DataFrame, cols: Sequence[str], k: int, out: str, n_buckets: int | None = None) -> DataFrame:
    """``df`` with a boolean ``out`` that is true for exactly ``min(k, rows)`` rows: the first in the order of ``cols``.

    Rows that tie in all of ``cols`` are ordered by a digest of the whole row; of rows equal in every column any are
    taken.  Without such copies at the boundary this is a narrow predicate against literals."""
    if k <= 0:
        return df.withColumn(out, F.lit(False))
    bounds, left, _ = boundary(df, cols, k, n_buckets)
    if not left:
        return df.withColumn(out, lex_less_equal(list(cols)[: len(bounds)], bounds))
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    keyed = df.withColumn("_row", F.md5(F.to_json(whole)))
    order = [*cols, "_row"]
    bounds, left, tied = boundary(keyed, order, k, n_buckets)
    names = order[: len(bounds)]
    if not left:
        return keyed.withColumn(out, lex_less_equal(names, bounds)).drop("_row")
    same = _and([F.col(c).eqNullSafe(b.lit()) for c, b in zip(names, bounds)])
    others = keyed.filter(~same).withColumn(out, lex_less_equal(names, bounds)).drop("_row")
    # the copies are one row and a number: written out again in chunks over all tasks
    chunk = 100_000
    one = keyed.filter(same).limit(1).select(whole.alias("_v"))
    spread = one.select("_v", F.explode(F.sequence(F.lit(0), F.lit((tied - 1) // chunk))).alias("_c")).repartition("_c")
    number = F.sequence(F.col("_c") * chunk + 1, F.least((F.col("_c") + 1) * chunk, F.lit(tied)))
    copies = spread.select("_v", F.explode(number).alias("_i")).select("_v.*", (F.col("_i") <= left).alias(out))
    return others.unionByName(copies)


def exact_percentiles(
    df: DataFrame,
    value_col: str,
    qs: Sequence[float],
    *,
    by: Sequence[str] = (),
    n_buckets: int | None = None,
) -> DataFrame:
    """Linear-interpolation percentiles (numpy's default), exact, distributed; nulls are left out.

    Returns (by..., q, value); a group without values has no row.  Rank positions are
    ``q * (n - 1)``; the rows of the prefix-sum frame that hold one of the two neighbouring
    order statistics say so themselves, from their running count and their group's total.
    """
    by = list(by)
    counts = df.filter(F.col(value_col).isNotNull()).groupBy(*by, value_col).agg(F.count(F.lit(1)).alias("_n"))
    ps = prefix_sums(counts, value_col, ["_n"], by=by, n_buckets=n_buckets, totals_prefix="tot_")
    start, end = F.col("cum__n") - F.col("_n"), F.col("cum__n")

    def rank(q: float) -> Column:
        pos = F.lit(float(q)) * (F.col("tot__n") - 1)
        lo = F.floor(pos)
        hi = F.least(lo + 1, F.col("tot__n") - 1)
        holds = lambda r: F.when((start <= r) & (end > r), F.col(value_col).cast("double"))
        return F.struct(F.lit(float(q)).alias("q"), (pos - lo).alias("frac"), holds(lo).alias("lo"), holds(hi).alias("hi"))

    held = F.filter(F.array(*[rank(q) for q in qs]), lambda r: r["lo"].isNotNull() | r["hi"].isNotNull())
    agg = ps.select(*by, F.explode(held).alias("_r")).groupBy(*by, F.col("_r.q").alias("q")).agg(
        F.max("_r.frac").alias("_f"), F.max("_r.lo").alias("_lo"), F.max("_r.hi").alias("_hi")
    )
    return agg.select(*by, "q", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_f")).alias("value"))


def _and(conds: list[Column]) -> Column:
    out = conds[0]
    for c in conds[1:]:
        out = out & c
    return out


def percentile_values(df: DataFrame, value_col: str, qs: Sequence[float], n_buckets: int | None = None) -> list[float | None]:
    """Driver-side list of a few global percentiles (bounded: one value per q)."""
    rows = {r["q"]: r["value"] for r in exact_percentiles(df, value_col, qs, n_buckets=n_buckets).collect()}
    return [rows.get(float(q)) for q in qs]


def dense_index(df: DataFrame, id_col: str, out: str = "_idx") -> DataFrame:
    """0-based position of each row in ``id_col`` order (unique ids): a
    distributed prefix count, no global sort in one task."""
    g = df.withColumn("_one", F.lit(1).cast("long"))
    ps = prefix_sums(g, id_col, ["_one"])
    return ps.withColumn(out, F.col("cum__one") - 1).drop("_one", "cum__one")
