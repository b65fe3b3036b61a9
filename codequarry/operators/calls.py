"""Call streams in batch form: rate limits, idle sessions, session caps."""

from __future__ import annotations

import itertools
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import params
from ..plans.skew import matched, matched_hot
from ..plans.topn import top_n
from ..session import stored


def micros(ts: str | Column) -> Column:
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def bucket(us: Column, width: int) -> Column:
    """Exact integer floor, negative times included."""
    return ((us - F.pmod(us, F.lit(width))) / width).cast("bigint")


# --- rate limit -------------------------------------------------------------------------
#
# A key's window opens at its first call and lasts ``width``; the first call at or after its end
# opens the next one. The distinct instants are sorted and cut into runs of bounded length, whatever
# the keys. A run works out where it would be left for every instant at which it may be entered;
# instants that leave it alike are one entry. Between the runs a pointer leads from each way out to
# the next: it is found by sorting the ways out among the entries, and followed by doubling over
# tables. Level k holds the pointers over 2**k runs, of just those ways out that level k - 1 leads
# to; then marks go down the levels, each adding what lies half as far. A run that is entered lists
# its openings. Pointers are rows keyed by (key, instant): a key that is busy in one hour is many
# runs and many pointers, on all tasks, and no key or range of time is ever a group.

RUN_INSTANTS = 100_000
TASK_ROWS = 1_000_000


def _runs(width: int):
    """Sorted (key, us) -> key, run, times and entries (at, exit), a run at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, held = TaskContext.get().partitionId(), 0, []

        def packed(key, kind):
            nonlocal made
            t = np.concatenate(held)
            held.clear()
            after = np.searchsorted(t, t + width)
            last = np.where(after < len(t), after, np.arange(len(t)))  # one step; the last opening stays
            while not np.array_equal(further := last[last], last):
                last = further
            enter, leave = t[:np.searchsorted(t, t[0] + width) + 1], t[last][:np.searchsorted(t, t[0] + width) + 1]
            keep = np.append(leave[1:] != leave[:-1], True)  # entries that leave alike need only the last
            made += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([key], kind), pa.array([part << 32 | made], pa.int64()), pa.array([t.astype("<i8").tobytes()], pa.binary()),
                 pa.array([enter[keep]], pa.list_(pa.int64())), pa.array([leave[keep]], pa.list_(pa.int64()))], ["key", "run", "times", "at", "exit"])

        key, kind = None, None
        for batch in batches:
            keys, us = batch.column(0), batch.column(1).to_numpy()
            kind, codes = keys.type, keys.dictionary_encode().indices.fill_null(-1).to_numpy()
            for a, z in itertools.pairwise([0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(us)] if len(us) else [0]):
                mine = keys[a].as_py()
                if held and mine != key:
                    yield packed(key, kind)
                key = mine
                for i in range(a, z, RUN_INSTANTS):
                    if held and sum(map(len, held)) + min(z, i + RUN_INSTANTS) - i > RUN_INSTANTS:
                        yield packed(key, kind)
                    held.append(us[i:min(z, i + RUN_INSTANTS)])
        if held:
            yield packed(key, kind)

    return run


def _pointers(entries: DataFrame, width: int) -> DataFrame:
    """key, us (a way out), next (the way out of the run entered next), run (which one that is), if there is one.

    Entries and the ends of the windows that the ways out opened are sorted together into ranges of about equal numbers of rows. A range
    looks ahead within itself; what it cannot see is the first entry of the key in a later range, one row a range."""
    none = F.lit(None).cast("bigint")
    ends = entries.select("key", F.col("exit").alias("us")).distinct().select("key", (F.col("us") + width).alias("at"), "us", F.lit(None).cast("struct<exit:bigint,run:bigint>"))
    both = entries.select("key", "at", none.alias("us"), F.struct("exit", "run").alias("to")).union(ends)
    ranges = max(int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-2 * entries.count() // TASK_ROWS))
    placed = stored(both.repartitionByRange(ranges, "key", "at").withColumn("range", F.spark_partition_id()), "ranges")
    ahead = Window.partitionBy("range", "key").orderBy(F.desc("at"), F.col("us").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = placed.withColumn("next", F.last("to", ignorenulls=True).over(ahead)).filter("us IS NOT NULL")
    first = placed.groupBy("range", "key").agg(F.min_by("to", F.when(F.col("us").isNull(), F.col("at"))).alias("first"))
    later = Window.partitionBy("key").orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)  # of one row a range
    beyond = first.withColumn("later", F.last("first", ignorenulls=True).over(later)).filter("later IS NOT NULL").select("range", "key", "later")
    # a key goes on in a later range at most once a range, so these rows are no more than the ranges
    found = matched(seen, F.broadcast(beyond), ["range", "key"], "left").select("key", "us", F.coalesce("next", "later").alias("next"))
    return found.filter("next IS NOT NULL").select("key", "us", F.col("next.exit").alias("next"), F.col("next.run").alias("run"))


def _openings(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, times, end in zip(*(batch.column(c).to_pylist() for c in ("key", "times", "end"))):
                t, found = np.frombuffer(times, "<i8"), []
                i = int(np.searchsorted(t, end))
                while i < len(t):
                    found.append(t[i])
                    i = int(np.searchsorted(t, t[i] + width))
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(found), batch.column("key").type), pa.array(found, pa.int64())], ["key", "start"])

    return run


def window_openings(calls: DataFrame, window_seconds: float = 60.0) -> DataFrame:
    """key, start (µs): every moment at which a window opens; calls without a time open none."""
    width = int(params.number_in(window_seconds, 0.001, 10 ** 9, "window_seconds") * 1_000_000)
    kind = dict(calls.dtypes)["key"]
    instants = calls.select("key", micros("ts").alias("us")).filter("us IS NOT NULL").distinct()
    tasks = max(int(calls.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-calls.count() // TASK_ROWS))
    ordered = instants.repartitionByRange(tasks, "key", "us").sortWithinPartitions("key", "us")
    runs = stored(ordered.mapInArrow(_runs(width), f"key {kind}, run bigint, times binary, at array<bigint>, exit array<bigint>"), "runs")
    entries = stored(runs.select("key", "run", F.explode(F.arrays_zip("at", "exit")).alias("e")).select("key", "run", "e.at", "e.exit"), "entries")
    heads = stored(entries.groupBy("key").agg(F.min_by(F.struct("exit", "run"), "at").alias("h"), F.lit(-(1 << 62)).alias("end"))
                   .select("key", F.col("h.exit").alias("us"), F.col("h.run").alias("run"), "end"), "heads")
    pointers = stored(_pointers(entries, width), "pointers")
    levels, starts = [pointers.select("key", "us", "next")], heads.select("key", "us")
    while matched(starts, levels[-1], ["key", "us"], "left_semi").limit(1).count():  # until no key goes on so far
        last = levels[-1]
        led_to = last.select("key", F.col("next").alias("us")).union(starts).distinct()
        once = matched(led_to, last, ["key", "us"]).select("key", F.col("us").alias("from"), F.col("next").alias("us"))
        levels.append(stored(matched(once, last, ["key", "us"]).select("key", F.col("from").alias("us"), "next"), "pointers"))
    marks = starts
    for level in reversed(levels):
        marks = matched(marks, level, ["key", "us"], "left").select("key", F.explode(F.array("us", "next")).alias("us")).filter("us IS NOT NULL")
    entered = matched(marks, pointers, ["key", "us"]).select("key", "run", (F.col("us") + width).alias("end")).union(heads.select("key", "run", "end"))
    return matched(runs.select("key", "run", "times"), entered, ["key", "run"]).mapInArrow(_openings(width), f"key {kind}, start bigint")


def rate_limit(calls: DataFrame, limit: int = 60, window_seconds: float = 60.0) -> DataFrame:
    """calls(key, ts, id) -> key, id, us, window_start, allowed. Rejected calls use up nothing
    further, so the first ``limit`` calls of a window are the allowed ones; they are found by a
    bounded selection, and every call is compared with the last of them. Which window a call belongs to is
    worked out once and stored. Calls without a time are left out."""
    params.int_in(limit, 1, 1_000_000, "limit", optional=False)
    width = int(window_seconds * 1_000_000)
    opened = window_openings(calls, window_seconds)
    first = bucket(F.col("start"), width)
    reach = stored(opened.select("key", "start", F.explode(F.array(first, first + 1)).alias("slot")), "openings")  # a window touches two slots
    timed = calls.select("key", "id", micros("ts").alias("us")).filter("us IS NOT NULL").withColumn("slot", bucket(F.col("us"), width))
    placed = stored(matched_hot(timed, reach, ["key", "slot"]).filter((F.col("us") >= F.col("start")) & (F.col("us") < F.col("start") + width))
                    .drop("slot"), "placed")
    allowed = top_n(placed, ["key", "start"], [F.col("us"), F.col("id")], limit, ["id"], rank="n")
    last = allowed.filter(F.col("n") == limit).select("key", "start", F.struct("us", "id").alias("last"))
    return matched_hot(placed, last, ["key", "start"], "left").select(
        "key", "id", "us", F.col("start").alias("window_start"),
        (F.col("last").isNull() | (F.struct("us", "id") <= F.col("last"))).alias("allowed"))


# --- idle sessions ----------------------------------------------------------------------

def idle_sessions(activity: DataFrame, timeout_seconds: int = 3_600) -> DataFrame:
    """activity(session_id, ts) -> one row per unbroken run: a gap longer than the timeout ends it.

    Events closer than the timeout belong together, so each slot of that width is merged first, in
    a map-side aggregate; only slots reach the window, however busy a session is."""
    params.int_in(timeout_seconds, 1, 10 ** 9, "timeout_seconds", optional=False)
    gap = timeout_seconds * 1_000_000
    us = micros("ts")
    slots = activity.select("session_id", us.alias("us")).groupBy("session_id", bucket(F.col("us"), gap).alias("slot")).agg(
        F.min("us").alias("lo"), F.max("us").alias("hi"), F.count("*").alias("n"))
    order = Window.partitionBy("session_id").orderBy("slot")
    starts = (F.col("lo") - F.lag("hi").over(order) > gap).cast("int")
    runs = slots.withColumn("starts", F.coalesce(starts, F.lit(0))).withColumn("run", F.sum("starts").over(order))
    return runs.groupBy("session_id", "run").agg(
        F.min("lo").alias("first_us"), F.max("hi").alias("last_us"), F.sum("n").alias("events")).withColumn(
        "expires_us", F.col("last_us") + gap)


# --- session cap ------------------------------------------------------------------------

class SessionTable:
    """Live sessions of one tenant, least recently active first; at most ``cap`` of them."""

    def __init__(self, cap: int, timeout_us: int, live=()):
        self.cap, self.timeout = cap, timeout_us
        self.live: OrderedDict = OrderedDict(live)

    def step(self, op: str, session, us: int):
        """Returns (outcome, evicted session or None, active count)."""
        while self.live and us - next(iter(self.live.values())) > self.timeout:
            self.live.popitem(last=False)
        evicted = None
        if op == "create":
            if session not in self.live and len(self.live) >= self.cap:
                evicted, _ = self.live.popitem(last=False)
            outcome = "created"
        elif session not in self.live:
            return "unknown", None, len(self.live)
        else:
            outcome = "touched" if op == "touch" else "destroyed"
        self.live.pop(session, None)
        if op != "destroy":
            self.live[session] = us
        return outcome, evicted, len(self.live)


def session_cap(operations: DataFrame, max_sessions: int = 100, timeout_seconds: int = 3_600) -> DataFrame:
    """operations(tenant, ts, id, op, session_id) -> outcome, evicted, active per operation.

    Which session a create pushes out depends on everything before it, so a tenant's operations
    are one ordered stream; the fold keeps only the live sessions, never more than the cap."""
    params.int_in(max_sessions, 1, 1_000_000, "max_sessions", optional=False)
    params.int_in(timeout_seconds, 1, 10 ** 9, "timeout_seconds", optional=False)
    timeout = timeout_seconds * 1_000_000
    types = dict(operations.dtypes)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tenant, state = object(), None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if row.tenant != tenant:
                    tenant, state = row.tenant, SessionTable(max_sessions, timeout)
                out.append((tenant, row.id, *state.step(row.op, row.session_id, row.us)))
            frame = pd.DataFrame(out, columns=["tenant", "id", "outcome", "evicted", "active"])
            frame["evicted"] = frame["evicted"].astype("object").where(frame["evicted"].notna(), None)
            yield frame

    rows = operations.select("tenant", "id", "op", "session_id", micros("ts").alias("us"))
    ordered = rows.repartition("tenant").sortWithinPartitions("tenant", "us", "id")
    return ordered.mapInPandas(
        fold, f"tenant {types['tenant']}, id {types['id']}, outcome string, evicted {types['session_id']}, active int")
