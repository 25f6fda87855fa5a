"""costlens: cost-sensitive detection analytics expressed as Spark jobs.

Sub-packages
------------
``functions``  column-expression builders (hashing, safe division, bucketing)
``sources``    table readers, CSV/JSON/parquet round trips, model persistence
``operators``  the analytic operators (splits, sampling, metrics, cost engine,
               calibration, bootstrap, windows, models, attribution)
``plans``      derived views and the query registry (Spark query + SQL oracle)
``streaming``  Structured Streaming jobs (replay, trailing windows, scoring)
"""

__all__ = ["session"]
