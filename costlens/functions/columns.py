"""Column-expression builders shared by the operators.

Everything here returns a ``Column`` that stays inside whole-stage codegen: no
Python UDFs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str

# Fixed values (must equal the reference): the default decision-threshold grid
# is 101 evenly spaced points 0.00, 0.01, ..., 1.00, built as i * 0.01 in
# double precision (this equals an evenly spaced 0..1 grid of 101 points bit
# for bit; i / 100 does not).
DEFAULT_GRID_SIZE = 101


def default_grid() -> list[float]:
    return [i * 0.01 for i in range(DEFAULT_GRID_SIZE)]


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(num: ColumnOrName, den: ColumnOrName, default: float = 0.0) -> Column:
    """num / den, ``default`` when the denominator is 0 (ANSI mode raises on /0)."""
    return F.coalesce(F.try_divide(col(num).cast("double"), col(den).cast("double")), F.lit(default))


def decide(score: ColumnOrName, threshold: float | Column) -> Column:
    """Inclusive decision rule: flagged when score >= threshold, as 0/1 int."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return (col(score) >= t).cast("int")


def count_le(value: ColumnOrName, sorted_edges: Sequence[float]) -> Column:
    """Number of ``sorted_edges`` that are <= value, as a balanced CASE tree.

    Evaluates in O(log n) comparisons per row (binary search unrolled into
    nested CASE WHEN), so a 101-point threshold grid costs 7 comparisons per
    row instead of 101, and it is ordinary codegen'd SQL.
    """
    edges = [float(e) for e in sorted_edges]
    v = col(value)

    def build(lo: int, hi: int) -> Column:
        # answer lies in [lo, hi]; edges[lo..hi-1] undecided
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2  # compare with edges[mid]
        return F.when(v >= F.lit(edges[mid]), build(mid + 1, hi)).otherwise(build(lo, mid))

    return build(0, len(edges))


def count_lt(value: ColumnOrName, sorted_edges: Sequence[float]) -> Column:
    """Number of ``sorted_edges`` strictly less than value (searchsorted 'left')."""
    edges = [float(e) for e in sorted_edges]
    v = col(value)

    def build(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(v > F.lit(edges[mid]), build(mid + 1, hi)).otherwise(build(lo, mid))

    return build(0, len(edges))


def portable_hash(seed: int | Column, *cols: ColumnOrName) -> Column:
    """Deterministic 32-bit hash of (seed, cols) as a non-negative bigint.

    md5 over the '|'-joined text of the values, first 8 hex digits.  The same
    number comes out of DuckDB's ``('0x' || substr(md5(...), 1, 8))::BIGINT``,
    which makes every random operator partition-independent and checkable by
    SQL.  Only pass integer or string columns (double text differs by engine).
    """
    s = seed if isinstance(seed, Column) else F.lit(str(int(seed)))
    parts = [s.cast("string")] + [col(c).cast("string") for c in cols]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("bigint")


def portable_hash_sql(seed: int | str, *cols: str) -> str:
    """DuckDB text of :func:`portable_hash`."""
    parts = " || '|' || ".join([f"CAST({seed} AS VARCHAR)"] + [f"CAST({c} AS VARCHAR)" for c in cols])
    return f"('0x' || substr(md5({parts}), 1, 8))::BIGINT"


def epoch_micros(ts: ColumnOrName) -> Column:
    """Microseconds since 1970-01-01 of a TIMESTAMP_NTZ, independent of session time zone."""
    c = col(ts)
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c)


def lex_less_equal(cols: Sequence[ColumnOrName], values: Sequence[object]) -> Column:
    """(c0, c1, ...) <= (v0, v1, ...) in lexicographic order with null first, as plain predicates that are never null.

    Written out instead of a struct comparison so that each conjunct can be
    pushed to the parquet scan and types need not match a struct literal.
    A value is a plain one or has a ``lit()`` that gives its column.
    """
    assert len(cols) == len(values) and cols
    c = [col(x) for x in cols]
    v = [x.lit() if hasattr(x, "lit") else F.lit(x) for x in values]

    def less(i: int, strict: bool) -> Column:
        below = c[i] < v[i] if strict else c[i] <= v[i]
        return F.coalesce(below, c[i].isNull() & (v[i].isNotNull() if strict else F.lit(True)))

    expr = less(len(c) - 1, False)
    for i in range(len(c) - 2, -1, -1):
        expr = less(i, True) | (c[i].eqNullSafe(v[i]) & expr)
    return expr


def round6(c: ColumnOrName) -> Column:
    """Round an order-dependent floating aggregate to 6 decimals (sum order differs by engine)."""
    return F.round(col(c), 6)
