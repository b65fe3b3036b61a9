"""Stream forms against their batch twins on the same rows, over several triggers."""

import random
from datetime import datetime, timedelta, timezone

import pandas as pd
import pytest
from pyspark.sql import functions as F

from codequarry.operators import audit, calls, scan
from codequarry.streaming import audit as stream_audit
from codequarry.streaming import calls as stream_calls
from codequarry.streaming import scan as stream_scan

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


@pytest.fixture()
def replay(spark, tmp_path):
    """Writes rows as one file per trigger and runs a stream operator over them."""

    def run(batches, operator, name):
        folder = tmp_path / name
        for i, df in enumerate(batches):
            df.coalesce(1).write.mode("append").parquet(str(folder / "in"))
        source = spark.readStream.schema(batches[0].schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))
        query = (operator(source).writeStream.format("memory").queryName(name).outputMode("append")
                 .option("checkpointLocation", str(folder / "state")).trigger(availableNow=True).start())
        query.awaitTermination(180)
        assert query.exception() is None
        return spark.table(name)

    return run


def slices(df, column, n):
    rows = df.orderBy(column).collect()
    size = -(-len(rows) // n)
    return [df.sparkSession.createDataFrame(rows[i:i + size], df.schema) for i in range(0, len(rows), size)]


def events(spark):
    rnd = random.Random(4)
    times = sorted(rnd.randrange(30_000) for _ in range(300))
    rows = [(rnd.choice(["a", "a", "b"]), START + timedelta(seconds=t), i, rnd.choice(["create", "touch", "destroy"]), rnd.randrange(5)) for i, t in enumerate(times)]
    return spark.createDataFrame(rows, "key string, ts timestamp, id long, op string, s long")


def test_rate_limit(spark, replay):
    df = events(spark).select("key", "ts", "id")
    got = replay(slices(df, "id", 4), lambda s: stream_calls.rate_limit(s, 3, 600.0), "limits")
    want = calls.rate_limit(df, 3, 600.0)
    columns = ["key", "id", "us", "window_start", "allowed"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))


def test_idle_sessions(spark, replay):
    df = events(spark).select(F.col("key").alias("session_id"), "ts")
    late = spark.createDataFrame([("z", START + timedelta(days=9))], df.schema)
    got = replay(slices(df, "ts", 3) + [late], lambda s: stream_calls.idle_sessions(s, 300), "idle")
    columns = ["session_id", "first_us", "last_us", "events", "expires_us"]
    want = calls.idle_sessions(df, 300).select(columns).collect()
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want))


def test_session_cap(spark, replay):
    df = events(spark).select(F.col("key").alias("tenant"), "ts", "id", "op", F.col("s").alias("session_id"))
    got = replay(slices(df, "id", 3), lambda s: stream_calls.session_cap(s, 2, 900), "caps")
    want = calls.session_cap(df, 2, 900)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)


def test_audit(spark, replay):
    records = spark.createDataFrame([(r, i, "t", f'{{"op":{i}}}') for r in "ab" for i in range(30)], "repo string, ord long, timestamp_utc string, record string")
    log = audit.append(records).withColumn("raw", F.when((F.col("repo") == "b") & (F.col("pos") == 17), F.replace("raw", F.lit('"op":'), F.lit('"op":9'))).otherwise(F.col("raw")))
    got = replay(slices(log, "pos", 3), stream_audit.verify, "chain").collect()
    assert len(got) == 60
    assert [(r.repo, r.position) for r in got if not r.ok] == [("b", 17)]
    assert {r.first_invalid_seq for r in got if r.repo == "b" and r.position >= 17} == {17}


def test_audit_of_lines_out_of_order(spark, replay):
    """Every line in any trigger, some twice, blank lines and other JSON between, positions as byte offsets."""
    records = spark.createDataFrame([(r, i, "t", f'{{"op":{i},"x":1e22}}') for r in "ab" for i in range(120)], "repo string, ord long, timestamp_utc string, record string")
    rows, at = [], {}
    for r in sorted(audit.append(records).collect()):
        for raw in ([r.raw.replace('"op":60,', '"op":61,')] if r.repo == "b" else [r.raw, "", "[1]"]):
            pos = at.get(r.repo, 0)
            at[r.repo] = pos + len(raw) + 1
            rows.append((r.repo, pos, at[r.repo], raw))
    want = [(r.repo, r.entry_count, r.first_invalid_seq) for r in audit.verify(spark.createDataFrame(rows, "repo string, pos long, next long, raw string")).collect()]
    assert sorted(want) == [("a", 120, None), ("b", 120, 61)]
    rnd = random.Random(2)
    again = rows + rnd.sample(rows, 60)
    rnd.shuffle(again)
    parts = [spark.createDataFrame(again[i::5], "repo string, pos long, next long, raw string") for i in range(5)]
    got = replay(parts, lambda s: stream_audit.verify(s, start=0), "disorder").collect()
    assert sorted((r.repo, r.position) for r in got) == [(r, i + 1) for r in "ab" for i in range(120)]
    assert [(r.repo, r.position) for r in got if not r.ok] == [("b", 61)]
    assert {r.first_invalid_seq for r in got if r.repo == "b" and r.position > 60} == {61}


def test_scans(spark, replay, files):
    key = "AK" + "IA" + "ABCDEFGHIJKLMNOP"
    token = "Q1w2E3r4T5y6U7i8O9p0AsDfGhJkLzXc"
    df = files(("r", "a", f"x\n{key}"), ("r", "secrets/b", "x"), ("r", "c", f"{token}\n{token}"), ("r", "d", token), ("s", "e", token))
    got = replay(slices(df, "path", 3), stream_scan.secret_findings, "secrets")
    want = scan.secret_findings(df)
    key_of = lambda r: str(r)
    assert sorted(map(tuple, got.collect()), key=key_of) == sorted(map(tuple, want.collect()), key=key_of)
    timed = df.withColumn("arrived", F.lit(START))
    found = replay(slices(timed, "path", 3), stream_scan.entropy_findings, "tokens").collect()
    assert sorted((r.repo, r.length) for r in found) == [("r", 32), ("s", 32)]


class Held(dict):
    """A value or map state that counts how often it is asked."""

    calls = 0

    def exists(self):
        return "value" in self

    def get(self):
        return self["value"]

    def update(self, value):
        self["value"] = value

    def containsKey(self, key):
        Held.calls += 1
        return key in self

    def getValue(self, key):
        Held.calls += 1
        return self[key]

    def updateValue(self, key, value):
        Held.calls += 1
        self[key] = value

    def removeKey(self, key):
        Held.calls += 1
        self.pop(key, None)


def test_audit_asks_the_state_by_blocks():
    """Shuffled lines over three triggers: all entries in order, with far fewer state calls than lines."""

    class Handle:
        def getValueState(self, *_):
            return Held()

        getMapState = getValueState

    n, check = 50_000, stream_audit.ChainCheck(1)
    check.init(Handle())
    lines = [(i, i + 1, False, i, f'"{i - 1}"' if i > 1 else None, f'"{i}"', i != 40_000) for i in range(1, n + 1)]
    random.Random(3).shuffle(lines)
    lines += lines[:500]
    Held.calls, got = 0, []
    for part in (lines[0::3], lines[1::3], lines[2::3]):
        frames = (pd.DataFrame(part[i:i + 9_000], columns=["pos", "next", "corrupt", "seq", "names", "hash", "sound"]) for i in range(0, len(part), 9_000))
        for out in check.handleInputRows(("r",), frames, None):
            got += zip(out["position"], out["ok"], out["first_invalid_seq"].fillna(0))
    assert got == [(i, i != 40_000, 0 if i < 40_000 else 40_000) for i in range(1, n + 1)]
    assert Held.calls < n / 50
