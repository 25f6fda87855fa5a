import duckdb
import pytest

import __spark_entry__ as E
from costlens.sources import TABLES

SF = "/root/testdata/sf0.001"
FAST = [
    "optimal_threshold", "cost_ratio_sweep", "evaluate_full", "reliability_curve", "chronological_split",
    "undersample_majority", "box_stats", "trailing_window_30s", "bootstrap_ci_confusion", "isotonic", "smote",
]


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 1 and set(df.columns) == {"optimal_threshold", "optimal_cost"}


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = E.queries()[name](spark, SF)
    got = sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in (r[c] for c in sorted(df.columns))) for r in df.collect())
    res = con.execute(E.oracle_sql()[name])
    cols = [d[0] for d in res.description]
    idx = sorted(range(len(cols)), key=lambda i: cols[i])
    want = sorted(tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in idx) for r in res.fetchall())
    assert sorted(df.columns) == sorted(cols)
    assert got == want


def test_flagship_value_at_sf001(spark):
    r = E.queries()["optimal_threshold"](spark, "/root/testdata/sf0.01").first()
    assert (r["optimal_threshold"], r["optimal_cost"]) == (0.19, 268950.0)


@pytest.mark.parametrize("sf,want", [("0.001", (349, 79, 56)), ("0.01", (3707, 732, 50)), ("0.1", (36578, 7266, 199))])
def test_view_positive_counts(spark, sf, want):
    from pyspark.sql import functions as F

    from costlens.plans.views import events_scored, matrix, scored

    d = f"/root/testdata/sf{sf}"
    got = tuple(v(spark, d).agg(F.sum("label")).first()[0] for v in (scored, events_scored, matrix))
    assert got == want


@pytest.mark.parametrize("name", FAST + ["stream_late_data", "class_balance", "validate_contract"])
def test_pandas_dtypes_match_oracle(spark, name):
    """The driver may hash pandas frames: both engines must give the same dtypes."""
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    a = E.queries()[name](spark, SF).toPandas()
    b = con.execute(E.oracle_sql()[name]).df()
    assert {c: str(a[c].dtype) for c in a.columns} == {c: str(b[c].dtype) for c in b.columns}
