import random
from collections import OrderedDict
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from codequarry.operators import calls

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema).repartition(5)


def at(seconds):
    return START + timedelta(seconds=seconds)


def sequential(events, limit, window):
    """(allowed ids) the way one process counts."""
    state, out = {}, {}
    for key, t, i in sorted(events, key=lambda e: (str(e[0]), e[1], e[2])):
        start, n = state.get(key, (None, 0))
        if start is None or t - start >= window:
            start, n = t, 0
        state[key] = (start, n + 1)
        out[i] = (start, n + 1 <= limit)
    return out


@pytest.mark.parametrize("seed,limit,window,rows", [(1, 3, 10, 1_000_000), (2, 1, 7, 20), (3, 5, 60, 10), (4, 2, 1, 50), (5, 60, 60, 7)])
def test_rate_limit(spark, monkeypatch, seed, limit, window, rows):
    monkeypatch.setattr(calls, "RUN_INSTANTS", rows)
    monkeypatch.setattr(calls, "TASK_ROWS", 3 * rows)
    rnd = random.Random(seed)
    keys = ["hot"] * 6 + ["b", None]
    events = [(rnd.choice(keys), rnd.choice([rnd.randrange(600), rnd.randrange(40), 100]), i) for i in range(700)]
    df = table(spark, [(k, at(t), i) for k, t, i in events], "key string, ts timestamp, id long")
    got = {r.id: (r.window_start // 1_000_000 - int(START.timestamp()), r.allowed)
           for r in calls.rate_limit(df, limit, float(window)).collect()}
    assert got == sequential(events, limit, window)


def test_fourth_of_four_calls_is_refused(spark):
    df = table(spark, [("t", at(i), i) for i in range(4)], "key string, ts timestamp, id long")
    assert [r.allowed for r in calls.rate_limit(df, 3, 60.0).orderBy("id").collect()] == [True, True, True, False]


def test_one_key_in_one_hour_is_spread(spark, monkeypatch):
    """No range holds more than its share of a key, calls crowd in a few windows, and calls without a time are left out."""
    monkeypatch.setattr(calls, "RUN_INSTANTS", 50)
    monkeypatch.setattr(calls, "TASK_ROWS", 200)
    from codequarry.plans import skew
    monkeypatch.setattr(skew, "SHARE", 50)
    events = [("one", (i * 7919 % 3_600_000) / 1000 if i % 3 else 1.5, i) for i in range(4000)]
    df = table(spark, [(k, START + timedelta(milliseconds=round(t * 1000)), i) for k, t, i in events] + [("one", None, 9999)], "key string, ts timestamp, id long")
    got = {r.id: (r.window_start / 1e6 - START.timestamp(), r.allowed) for r in calls.rate_limit(df, 10, 1.0).collect()}
    want = {i: (round(s, 6), ok) for i, (s, ok) in sequential([(k, round(t * 1000), i) for k, t, i in events], 10, 1000).items()}
    assert {i: (round(s * 1000), ok) for i, (s, ok) in got.items()} == want


def test_window_starts_at_the_first_call(spark):
    df = table(spark, [("t", at(s), s) for s in (50, 70, 109, 110)], "key string, ts timestamp, id long")
    assert [r.start // 1_000_000 - int(START.timestamp()) for r in calls.window_openings(df, 60.0).orderBy("start").collect()] == [50, 110]


def test_idle_sessions(spark):
    rnd = random.Random(9)
    events = [("hot" if rnd.random() < .6 else f"u{rnd.randrange(4)}", rnd.randrange(100_000)) for _ in range(500)]
    events += [("edge", 0), ("edge", 3600), ("edge", 7201)]
    df = table(spark, [(u, at(t)) for u, t in events], "session_id string, ts timestamp")
    want = []
    for user in {u for u, _ in events}:
        times = sorted(t for u, t in events if u == user)
        run = [times[0]]
        for t in times[1:] + [10 ** 9]:
            if t - run[-1] > 3600:
                want.append((user, run[0], run[-1], len(run)))
                run = []
            run.append(t)
    zero = int(START.timestamp())
    got = [(r.session_id, r.first_us // 10 ** 6 - zero, r.last_us // 10 ** 6 - zero, r.events) for r in calls.idle_sessions(df).collect()]
    assert sorted(got) == sorted(want) and len([w for w in want if w[0] == "edge"]) == 2


def plain_sessions(ops, cap, timeout):
    live, out = OrderedDict(), []
    for t, i, op, s in ops:
        for k in [k for k, v in live.items() if t - v > timeout]:
            del live[k]
        evicted = None
        if op == "create":
            if s not in live and len(live) >= cap:
                evicted = min(live, key=lambda k: live[k])
                del live[evicted]
            live.pop(s, None)
            live[s], outcome = t, "created"
        elif s not in live:
            outcome = "unknown"
        elif op == "touch":
            live[s], outcome = t, "touched"
        else:
            del live[s]
            outcome = "destroyed"
        out.append((i, outcome, evicted, len(live)))
    return out


@pytest.mark.parametrize("seed,cap", [(1, 1), (2, 3), (3, 50)])
def test_session_cap(spark, seed, cap):
    rnd = random.Random(seed)
    ops = [(i * 7 + rnd.randrange(7), i, rnd.choice(["create", "create", "touch", "touch", "destroy"]), rnd.randrange(12)) for i in range(300)]
    rows = [(f"t{k}", at(t), i, op, s) for k in range(2) for t, i, op, s in ops]
    df = table(spark, rows, "tenant string, ts timestamp, id long, op string, session_id long")
    got = calls.session_cap(df, cap, 40).filter(F.col("tenant") == "t1").orderBy("id").collect()
    assert [(r.id, r.outcome, r.evicted, r.active) for r in got] == plain_sessions(ops, cap, 40)
    assert max(r.active for r in got) <= cap


@pytest.mark.parametrize("bad", [dict(limit=0), dict(limit=True), dict(window_seconds=0)])
def test_bad_parameters(spark, bad):
    df = table(spark, [("t", at(0), 1)], "key string, ts timestamp, id long")
    with pytest.raises(ValueError):
        calls.rate_limit(df, **{"limit": 3, "window_seconds": 60.0, **bad})
