"""Plan-shape guards for the registered queries (scale properties, not values)."""

import contextlib
import io
import re

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
NAMES = [n for n in E.oracle_sql() if not n.startswith("stream_")]


@pytest.mark.parametrize("name", NAMES)
def test_no_cartesian_product_and_pruned_scans(spark, name):
    df = E.queries()[name](spark, SF)
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    plan = buf.getvalue()
    assert "CartesianProduct" not in plan
    for schema in re.findall(r"ReadSchema: struct<([^>]*)>", plan):
        cols = {c.split(":")[0] for c in schema.split(",")}
        # lineitem has 11 columns; no query needs l_returnflag + l_linestatus + every measure at once
        assert not {"l_linestatus", "l_tax", "l_discount", "l_returnflag"} <= cols, schema
