"""Keyed state over call streams. The state per key is two numbers (limits) or at most ``cap``
sessions; a micro-batch's rows of one key are put in time order before they are applied, so the
size of a trigger bounds the memory of a busy key."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import params
from ..operators.calls import SessionTable, micros


def _in_order(frames) -> pd.DataFrame:
    return pd.concat(list(frames), ignore_index=True).sort_values(["us", "id"], kind="stable")


def rate_limit(calls: DataFrame, limit: int = 60, window_seconds: float = 60.0, lateness: str = "10 minutes") -> DataFrame:
    """Streaming calls(key, ts, id) -> key, id, us, window_start, allowed. A key's state goes once
    its window has ended."""
    params.int_in(limit, 1, 1_000_000, "limit", optional=False)
    width = int(window_seconds * 1_000_000)
    types = dict(calls.dtypes)

    def step(key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        start, used = state.get if state.exists else (None, 0)
        out = []
        for row in _in_order(frames).itertuples(index=False):
            if start is None or row.us - start >= width:
                start, used = int(row.us), 0
            used += 1
            out.append((key[0], row.id, row.us, start, used <= limit))
        state.update((start, used))
        state.setTimeoutTimestamp(max((start + width) // 1000, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame(out, columns=["key", "id", "us", "window_start", "allowed"])

    timed = calls.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    return timed.select("key", "id", "ts", micros("ts").alias("us")).groupBy("key").applyInPandasWithState(
        step, f"key {types['key']}, id {types['id']}, us bigint, window_start bigint, allowed boolean",
        "start bigint, used bigint", "append", GroupStateTimeout.EventTimeTimeout)


def idle_sessions(activity: DataFrame, timeout_seconds: int = 3_600, lateness: str = "10 minutes") -> DataFrame:
    """Streaming activity(session_id, ts): a row when a session has been idle for the timeout."""
    params.int_in(timeout_seconds, 1, 10 ** 9, "timeout_seconds", optional=False)
    timed = activity.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    runs = timed.groupBy(F.session_window("ts", f"{timeout_seconds} seconds").alias("w"), "session_id").agg(
        F.count("*").alias("events"), F.max("ts").alias("last"))
    return runs.select("session_id", F.unix_micros("w.start").alias("first_us"), F.unix_micros("last").alias("last_us"),
                       "events", F.unix_micros("w.end").alias("expires_us"))


def session_cap(operations: DataFrame, max_sessions: int = 100, timeout_seconds: int = 3_600) -> DataFrame:
    """Streaming operations(tenant, ts, id, op, session_id) -> outcome, evicted, active."""
    params.int_in(max_sessions, 1, 1_000_000, "max_sessions", optional=False)
    timeout = timeout_seconds * 1_000_000
    types = dict(operations.dtypes)
    sid = types["session_id"]

    def step(key, frames, state: GroupState):
        live = zip(*state.get) if state.exists else ()
        table = SessionTable(max_sessions, timeout, live)
        out = [(key[0], r.id, *table.step(r.op, r.session_id, r.us)) for r in _in_order(frames).itertuples(index=False)]
        state.update((list(table.live.keys()), list(table.live.values())))
        frame = pd.DataFrame(out, columns=["tenant", "id", "outcome", "evicted", "active"])
        frame["evicted"] = frame["evicted"].astype("object").where(frame["evicted"].notna(), None)
        yield frame

    rows = operations.select("tenant", "id", "op", "session_id", micros("ts").alias("us"))
    return rows.groupBy("tenant").applyInPandasWithState(
        step, f"tenant {types['tenant']}, id {types['id']}, outcome string, evicted {sid}, active int",
        f"ids array<{sid}>, times array<bigint>", "append", GroupStateTimeout.NoTimeout)
