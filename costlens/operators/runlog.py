"""Run metrics as a long table (A9): (run_id, experiment, kind, key, value, text).

A metric record (one row, many columns) is unpivoted, and a run's metrics and
parameters are committed together, so every run of every analysis is queryable
with plain SQL afterwards.  A metric has a number in ``value``, a parameter its
spelling in ``text`` (and in ``value`` too if it is a number), so both kinds
share one dataset and one schema.

A run is there whole or not at all: its rows go to a folder of their own that no reader looks at, and one renamed file, the
run's entry, then names that folder.  Committing a run again replaces its entry, so a job that is retried logs its run once,
and one cut off midway logs nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from functools import reduce
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from costlens.sources.files import exists, replace_text

SCHEMA = "run_id string, experiment string, kind string, key string, value double, text string"


def metrics_long(record: DataFrame, run_id: str, experiment: str, kind: str = "metric") -> DataFrame:
    cols = record.columns
    wide = record.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in cols])
    long = wide.unpivot([], [F.col(f"`{c}`") for c in cols], "key", "value")
    return long.select(
        F.lit(run_id).alias("run_id"),
        F.lit(experiment).alias("experiment"),
        F.lit(kind).alias("kind"),
        "key",
        "value",
        F.lit(None).cast("string").alias("text"),
    )


def params_long(spark, params: Mapping[str, object], run_id: str, experiment: str) -> DataFrame:
    number = {k: float(v) for k, v in params.items() if isinstance(v, int | float)}
    rows = [(run_id, experiment, "param", str(k), number.get(k), str(v)) for k, v in params.items()]
    return spark.createDataFrame(rows, SCHEMA)


def commit_run(parts: list[DataFrame], path: str, run_id: str, experiment: str) -> None:
    """Log a run's frames (``metrics_long``, ``params_long``) under ``path``; replaces what the run logged before."""
    spark, name = parts[0].sparkSession, quote(f"{experiment}/{run_id}", safe="")
    folder = f"{path}/experiment={quote(experiment, safe='')}/run={quote(run_id, safe='')}-{uuid.uuid4().hex}"
    reduce(DataFrame.unionByName, parts).coalesce(1).write.parquet(folder)
    replace_text(spark, f"{path}/runs/{name}.json", json.dumps({"run_id": run_id, "experiment": experiment, "rows": folder.removeprefix(f"{path}/")}))


def read_runs(spark: SparkSession, path: str, experiment: str | None = None) -> DataFrame:
    """Every metric and parameter of the committed runs under ``path``; ``experiment``: of that one alone."""
    if not exists(spark, f"{path}/runs"):
        return spark.createDataFrame([], SCHEMA)
    rows = spark.read.schema("run_id string, experiment string, rows string").json(f"{path}/runs/*.json")
    if experiment is not None:
        rows = rows.filter(F.col("experiment") == experiment)
    folders = [f"{path}/{r['rows']}" for r in rows.collect()]  # one row a run
    return spark.read.schema(SCHEMA).parquet(*folders) if folders else spark.createDataFrame([], SCHEMA)
