"""Same answers whatever the shuffle partitioning."""

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
NAMES = [
    "optimal_threshold", "average_precision", "chronological_split", "undersample_majority",
    "trailing_window_30s", "bootstrap_ci_confusion", "box_stats", "smote",
]


def _rows(df):
    cols = sorted(df.columns)
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in (r[c] for c in cols)) for r in df.collect())


@pytest.mark.parametrize("name", NAMES)
def test_shuffle_partitions_do_not_change_results(spark, name):
    q = E.queries()[name]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        a = _rows(q(spark, SF))
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        b = _rows(q(spark, SF))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert a == b
