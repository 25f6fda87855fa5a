"""Query registry: every registered name has a Spark callable ``(spark, sf_dir)
-> DataFrame`` and, where the operator is expressible in SQL, an equivalent
DuckDB query over the same parquet tables.  Column names match exactly."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_ORACLES: dict[str, str] = {}
_LOADED = False


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = fn
        if sql is not None:
            _ORACLES[name] = sql
        return fn

    return deco


def _load() -> None:
    global _LOADED
    if _LOADED:
        return
    _LOADED = True
    from costlens.plans import q_cost, q_metrics  # noqa: F401

    for mod in ("q_split", "q_profile", "q_windows", "q_bootstrap", "q_calibration", "q_models", "q_given", "q_anomaly", "q_streaming"):
        try:
            __import__(f"costlens.plans.{mod}")
        except ModuleNotFoundError as e:  # modules are added incrementally
            if e.name != f"costlens.plans.{mod}":
                raise


def queries() -> dict[str, QueryFn]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
