"""Stateful trailing-window features on a stream, as an operator for continuous queries.

The jobs run to completion (``streaming.jobs``) keep their state as a log of batches instead.

Per entity key, the state holds the (ms, amount) pairs that a future on-time
event can still see.  Each micro-batch merges the new events into the state
(sorted) and answers, for every new event at t, count and sum over
(t - w, t] with two binary searches on the merged arrays, which equals the
batch RANGE frame W1 when events arrive in time order.

Late data: an event not after the watermark (time <= watermark, the engine's
own rule) is not windowed.
The engine drops most such events before this function; those it lets through
are emitted with ``late = true``, and so are events without a time.  The key may have any type; events with a null key are
one entity; a null amount adds nothing.
Pairs older than watermark - w are dropped from the state, and keys idle past
the window time out and free their state, so state per key is bounded by the
events of one window plus the watermark delay.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

BASE_SCHEMA = "event_id long, ms long, window_count long, window_sum double, late boolean"
STATE_SCHEMA = "ms array<long>, amount array<double>"


def _window_fn(window_ms: int, passthrough: Sequence[str]):
    w = int(window_ms)
    extra = list(passthrough)

    def frame(key, rows: pd.DataFrame, counts, sums, late: bool) -> pd.DataFrame:
        out = pd.DataFrame(
            {
                "key": pd.Series([key[0]] * len(rows), index=rows.index, dtype=object),
                "event_id": rows["event_id"],
                "ms": rows["ms"].astype("Int64"),
                "window_count": counts,
                "window_sum": sums,
                "late": np.full(len(rows), late),
            }
        )
        for c in extra:
            out[c] = rows[c]
        return out.reset_index(drop=True)

    def fn(key, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        frames = [p for p in pdfs if len(p)]
        if not frames:
            return
        new = pd.concat(frames, ignore_index=True)
        old_ms = np.array(state.get[0], dtype=np.int64) if state.exists else np.zeros(0, dtype=np.int64)
        old_amt = np.array(state.get[1], dtype=np.float64) if state.exists else np.zeros(0)
        wm = state.getCurrentWatermarkMs()
        late_mask = (new["ms"].isna() | (new["ms"] <= wm)).to_numpy(dtype=bool)
        on_time = new[~late_mask]
        ms_all = np.concatenate([old_ms, on_time["ms"].to_numpy(dtype=np.int64)])
        amt_all = np.concatenate([old_amt, on_time["amount"].fillna(0.0).to_numpy(dtype=np.float64)])
        order = np.argsort(ms_all, kind="stable")
        ms_sorted, amt_sorted = ms_all[order], amt_all[order]
        csum = np.concatenate([[0.0], np.cumsum(amt_sorted)])
        t = on_time["ms"].to_numpy(dtype=np.int64)
        hi = np.searchsorted(ms_sorted, t, side="right")
        lo = np.searchsorted(ms_sorted, t - w, side="right")
        parts = [frame(key, on_time, (hi - lo).astype(np.int64), csum[hi] - csum[lo], False)]
        if late_mask.any():
            late = new[late_mask]
            parts.append(frame(key, late, np.zeros(len(late), dtype=np.int64), np.full(len(late), np.nan), True))
        # every later on-time event has t > watermark, so older pairs can go
        keep = ms_sorted > (wm - w) if wm > 0 else np.ones(len(ms_sorted), dtype=bool)
        state.update((ms_sorted[keep].tolist(), amt_sorted[keep].tolist()))
        newest = int(ms_sorted[-1]) if len(ms_sorted) else wm
        state.setTimeoutTimestamp(max(newest + w, wm + 1, 1))
        yield pd.concat(parts, ignore_index=True)

    return fn


def stream_trailing_window(
    events: DataFrame, key_col: str, window_ms: int = 30_000, passthrough: Sequence[str] = ()
) -> DataFrame:
    """events: streaming frame with (event_id long, ms long, amount double, key_col)
    and an event-time watermark.  Output: one row per event (BASE_SCHEMA plus the
    ``passthrough`` columns with their input types)."""
    from costlens.session import ship_package

    ship_package(events.sparkSession)
    types = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    schema = f"key {types[key_col]}, " + BASE_SCHEMA + "".join(f", `{c}` {types[c]}" for c in passthrough)
    return events.groupBy(key_col).applyInPandasWithState(
        _window_fn(window_ms, passthrough), schema, STATE_SCHEMA, "append", GroupStateTimeout.EventTimeTimeout
    )
