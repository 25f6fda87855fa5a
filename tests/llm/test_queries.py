"""The registered queries of this subpackage, and SQL against them on the small tables."""

import duckdb
import pytest

import __spark_entry__ as E
from costlens.llm import queries
from costlens.sources import TABLES

SF = "/root/testdata/sf0.001"


def test_oracles_are_sql_of_registered_queries():
    assert set(queries.ORACLES) <= set(queries.QUERIES) and all(isinstance(s, str) for s in queries.ORACLES.values())
    assert {name.split("_")[0] for name in queries.QUERIES} == {f"op{n}" for n in range(1, 14)}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = E.queries()[name](spark, SF)
    found = con.execute(E.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    want = sorted((tuple(r[names.index(c)] for c in sorted(names)) for r in found.fetchall()), key=str)
    assert sorted((tuple(r[c] for c in sorted(names)) for r in df.collect()), key=str) == want and want
