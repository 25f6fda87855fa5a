"""Registered trailing-window queries (W1) on events."""

from __future__ import annotations

from pyspark.sql import functions as F

from costlens.operators.windows import trailing_window
from costlens.plans.registry import register
from costlens.plans.views import EVENTS_SQL, events_scored, with_sql


def _sql(window_ms: int, by: str = "") -> str:
    part = f"PARTITION BY {by} " if by else ""
    return with_sql(
        EVENTS_SQL,
        body=f"""SELECT event_id, ms, count(*) OVER w AS window_count, round(sum(value) OVER w, 6) AS window_sum
FROM events_scored
WINDOW w AS ({part}ORDER BY ms RANGE BETWEEN {window_ms - 1} PRECEDING AND CURRENT ROW)""",
    )


def _q(window_ms: int, by=(), method: str = "auto"):
    def run(spark, sf):
        ev = events_scored(spark, sf).select("event_id", "ms", "user_id", "value")
        out = trailing_window(ev, "ms", "value", window_ms, by=by, method=method)
        return out.select("event_id", "ms", "window_count", F.round("window_sum", 6).alias("window_sum"))

    return run


register("trailing_window_30s", _sql(30_000))(_q(30_000))
register("trailing_window_1h", _sql(3_600_000))(_q(3_600_000))
register("trailing_window_by_user", _sql(3_600_000, "user_id"))(_q(3_600_000, by=["user_id"]))
# the plan for bursts: a window's rows never meet in one task
register("trailing_window_prefix", _sql(3_600_000, "user_id"))(_q(3_600_000, by=["user_id"], method="prefix"))
register("trailing_window_all_prefix", _sql(3_600_000))(_q(3_600_000, method="prefix"))
