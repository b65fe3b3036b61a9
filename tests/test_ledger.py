import json
import os

import pytest

from codequarry.operators import audit
from codequarry.sinks import ledger


def records(spark, rows):
    return spark.createDataFrame([(r, i, "t", json.dumps({"op": i})) for r, i in rows], "repo string, ord long, timestamp_utc string, record string")


def test_two_writers_cannot_fork_a_chain(spark, tmp_path):
    path = str(tmp_path / "log")
    assert ledger.version(spark, path) == 0
    assert ledger.extend(records(spark, [("a", i) for i in range(5)] + [("b", 0)]), path) == 1
    first, second = records(spark, [("a", 10), ("c", 11)]), records(spark, [("a", 20)])
    assert ledger.extend(first, path, expected=1) == 2
    before = sorted(os.listdir(path))
    with pytest.raises(ledger.Conflict):
        ledger.extend(second, path, expected=1)
    assert sorted(os.listdir(path)) == before
    assert ledger.extend(second, path) == 3
    found = ledger.read(spark, path)
    state = {r.repo: (r.entry_count, r.chain_valid) for r in audit.verify(found, chunk=2).collect()}
    assert state == {"a": (7, True), "b": (1, True), "c": (1, True)}
    assert ledger.read(spark, path, at=1).count() == 6
    with pytest.raises(ValueError):
        ledger.extend(second, path, expected=9)


def test_rows_that_were_not_committed_are_not_read(spark, tmp_path):
    path = str(tmp_path / "log")
    df = spark.createDataFrame([("s", i) for i in range(4)], "session string, pos long")
    with pytest.raises(ValueError):
        ledger.read(spark, path)
    assert ledger.append(df, path, 0) == 1
    df.write.parquet(f"{path}/rows-of-a-writer-that-died")
    with open(f"{path}/commits/{1:012d}.json", "w") as handle:
        handle.write('{"rows": "rows-of-a-wri')  # a record that was never finished
    assert ledger.version(spark, path) == 1 and ledger.read(spark, path).count() == 4
    with pytest.raises(ledger.Conflict):
        ledger.append(df, path, 1)
    with pytest.raises(ValueError):
        ledger.append(df.drop("pos"), path, 1)


def test_a_late_writer_chains_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "log")
    ledger.extend(records(spark, [("a", 1)]), path)
    chained = []
    monkeypatch.setattr(ledger.audit, "append", lambda *given: chained.append(given))
    with pytest.raises(ledger.Conflict):
        ledger.extend(records(spark, [("a", 2)]), path, expected=0)
    assert not chained and ledger.version(spark, path) == 1


def test_two_that_read_the_same_version(spark, tmp_path, monkeypatch):
    """The other commits while this one chains: nothing of this one is left."""
    path, append = str(tmp_path / "log"), audit.append
    ledger.extend(records(spark, [("a", 1)]), path)

    def overtaken(given, tails):
        monkeypatch.setattr(ledger.audit, "append", append)
        ledger.extend(records(spark, [("a", 2)]), path)
        listed.extend(sorted(os.listdir(path)))
        return append(given, tails)

    listed = []
    monkeypatch.setattr(ledger.audit, "append", overtaken)
    with pytest.raises(ledger.Conflict):
        ledger.extend(records(spark, [("a", 3)]), path)
    assert sorted(os.listdir(path)) == listed and ledger.version(spark, path) == 2
