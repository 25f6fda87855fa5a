import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .appName("costlens-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="costlens-test-ckpt-"))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def lattice_scores(n, every=23, lift=0.45):
    """Labels and scores without a random generator: every ``every``-th row is positive; scores run through a fixed
    lattice, and positives sit ``lift`` of the way closer to 1."""
    labels = [int(i % every == 4) for i in range(n)]
    place = [(i * 377 % 1009) / 1009 for i in range(n)]
    return labels, [u + lift * (1 - u) if y else u * u for y, u in zip(labels, place)]


def scored_frame(spark, ys, ps, ids=None):
    ids = ids if ids is not None else list(range(len(ys)))
    return spark.createDataFrame(
        [(int(i), int(y), float(p)) for i, y, p in zip(ids, ys, ps)], "id long, label int, score double"
    )
