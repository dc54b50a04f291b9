"""Streams of usage events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _timed(events: DataFrame, time: str) -> DataFrame:
    """Event times without a zone are read in the session's zone."""
    return events.withColumn(time, F.col(time).cast("timestamp"))


def windows(events: DataFrame, time: str = "ts", tool: str = "tool", value: str = "elapsed", length: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Calls and summed values per tool and tumbling window; events later than the watermark are left out, and state is bounded by it."""
    return _timed(events, time).withWatermark(time, late).groupBy(F.window(time, length).alias("window"), tool).agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum(value), 2).alias("elapsed"))


def sessions(events: DataFrame, time: str = "ts", session: str = "session", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Runs of a session's events without a gap, with their number of calls."""
    return _timed(events, time).withWatermark(time, late).groupBy(F.session_window(time, gap).alias("window"), session).agg(F.count(F.lit(1)).alias("calls"))


def without_repeats(events: DataFrame, keys: list[str], time: str = "ts", late: str = "1 hour") -> DataFrame:
    """Events once for each key within the watermark: debounced file events, or retried uploads."""
    return _timed(events, time).withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def append_once(batch_sink, name: str):
    """A ``foreachBatch`` function that hands each batch to ``batch_sink(df, name, batch_id)``; the checkpoint advances only after it returns."""

    def run(df: DataFrame, batch_id: int) -> None:
        batch_sink(df, name, batch_id)

    return run


_STATE = "tool string, run int, calls long, seen array<string>"
_OUT = "session string, event_id long, hint string"
KEEP_ARGS, LONG_SESSION, IDLE_MS = 200, 50, 3_600_000


def _hints(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    tool, run, calls, seen = state.get if state.exists else (None, 0, 0, [])
    seen = list(seen)
    out = []
    rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
    for r in rows.itertuples():
        run = run + 1 if r.tool == tool else 1
        tool, calls = r.tool, calls + 1
        if run == 3:
            out.append((key[0], r.event_id, "H2"))
        if calls == LONG_SESSION:
            out.append((key[0], r.event_id, "H10"))
        if r.args in seen:
            out.append((key[0], r.event_id, "H5"))
        else:
            # the oldest of a bounded memory go first
            seen = [*seen, r.args][-KEEP_ARGS:]
    state.update((tool, run, calls, seen))
    last = int(rows["ts"].max().timestamp() * 1000)
    state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + IDLE_MS)
    yield pd.DataFrame(out, columns=["session", "event_id", "hint"])


def hints(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Hints over ``(session string, event_id, ts, tool, args string)``: three equal calls in a row, fifty calls, repeated arguments.

    State per session: the last tool, its run, a counter and the last 200 arguments; it goes an hour of event time
    after the session's last event.
    """
    timed = _timed(events, "ts").withWatermark("ts", late)
    return timed.groupBy("session").applyInPandasWithState(_hints, _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
