import hashlib
import json
import random

import pytest

from codequarry.functions import audit as fa
from codequarry.operators import audit
from codequarry.sources import logs
from pyspark.sql import functions as F


def python_verify(lines):
    entries = []
    for line in lines:
        if not line.strip():
            continue
        try:
            parsed = json.loads(line)
        except ValueError:
            parsed = {"corrupt": True}
        if isinstance(parsed, dict):
            entries.append(parsed)
    last = None
    for n, e in enumerate(entries, 1):
        body = {k: v for k, v in e.items() if k != "entryHash"}
        text = json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        if (e.get("corrupt") or body.get("seq") != n or body.get("prevHash") != last
                or e.get("entryHash") != hashlib.sha256(f"{last or 'GENESIS'}|{text}".encode()).hexdigest()):
            return len(entries), n
        last = e["entryHash"]
    return len(entries), None


RECORDS = [
    {"changeId": "c1", "operation": "write_file", "path": "é/ x", "bytesAfter": 3, "bytesBefore": None},
    {"operation": "rollback", "path": None, "applied": [{"path": "b", "action": "restored"}, {"action": "x", "path": "a"}]},
    {"text": "quote \" back\\slash \\u000B \x0b\x1f\x7f tab\t", "zz": True, "Aa": False, "nested": {"b": [], "a": {}}},
    {}, {"seqx": 1, "prev": "GENESIS", "n": -12345678901},
]


def chain(spark, records, tails=None):
    df = spark.createDataFrame([(r, i, f"2024-01-01T00:00:{i:02d}Z", json.dumps(v, ensure_ascii=False)) for r, i, v in records],
                               "repo string, ord long, timestamp_utc string, record string").repartition(3)
    return audit.append(df, tails)


def by_repo(log):
    out = {}
    for r in sorted(log.collect(), key=lambda r: (r.repo, r.pos)):
        out.setdefault(r.repo, []).append(r.raw)
    return out


def test_chain_matches_python(spark):
    log = chain(spark, [(repo, i, v) for repo in ("a", "b") for i, v in enumerate(RECORDS)])
    for lines in by_repo(log).values():
        assert python_verify(lines) == (len(RECORDS), None)
        assert [json.loads(x).get("operation") for x in lines] == [v.get("operation") for v in RECORDS]
    assert all(r.chain_valid and r.entry_count == 5 for r in audit.verify(log, chunk=2).collect())


def test_append_continues_a_log(spark):
    first = chain(spark, [("a", i, v) for i, v in enumerate(RECORDS[:3])])
    second = chain(spark, [("a", i, v) for i, v in enumerate(RECORDS[3:])] + [("new", 0, RECORDS[0])], audit.log_state(first))
    whole = by_repo(first.unionByName(second))
    assert python_verify(whole["a"]) == (5, None) and python_verify(whole["new"]) == (1, None)


@pytest.mark.parametrize("seed", range(6))
def test_tampering_is_found_where_python_finds_it(spark, seed):
    rnd = random.Random(seed)
    lines = by_repo(chain(spark, [("a", i, {"op": i, "p": "x" * i}) for i in range(40)]))["a"]
    kind, at = seed, rnd.randrange(1, 38)
    if kind == 0:
        lines[at] = lines[at].replace('"op":', '"op":1')
    elif kind == 1:
        lines[at], lines[at + 1] = lines[at + 1], lines[at]
    elif kind == 2:
        lines[at] = lines[at][:20]
    elif kind == 3:
        del lines[at]
    elif kind == 4:
        lines[at:at] = ["", "[1, 2]", "  ", "3"]
    else:
        lines[at] = lines[at].replace(f'"seq":{at + 1}', f'"seq":"{at + 1}"')
    df = spark.createDataFrame([("a", i * 3, x) for i, x in enumerate(lines)], "repo string, pos long, raw string").repartition(4)
    for chunk in (1, 7, 1000):
        r = audit.verify(df, chunk=chunk).first()
        assert (r.entry_count, r.first_invalid_seq) == python_verify(lines)


NUMBERS = ["1.0", "1e22", "1E+22", "1e-07", "0.0000001", "-0", "-0.0", "0.30000000000000004", "2.2250738585072014e-308", "5e-324", "8.41e21", "1.7976931348623157e308",
           "123456789012345678901234567890", "100000000000000000000.0", "1e16", "9007199254740993.0", "1e400", "0.1000000000000000055511151231257827"]


def test_canonical_form(spark):
    texts = [json.dumps(v) for v in RECORDS] + NUMBERS + [f'{{"b": [{n}, {{"z": {n}, "a": null}}]}}' for n in NUMBERS]
    texts += ['{"\uff5e": 1, "\U0001f600": 2, "z": 3, "\u00e9": 4}', '{"a": 1, "b": 2, "a": 3}', '[NaN, -Infinity]', ' {"a" : "\\u0041\\ud83d\\ude00\\/"} ', "[" * 500 + "]" * 500]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", fa.canonical("t").alias("c"))
    for r in df.collect():
        assert r.c == json.dumps(json.loads(r.t), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    bad = ["", "{", "{'a': 1}", '"\\ud800"', "01", "[" * 200_000, None]
    assert {r.c for r in spark.createDataFrame([(t,) for t in bad], "t string").select(fa.canonical("t").alias("c")).collect()} == {None}


ODD = ['{"n": %s, "\uff5e": {"\U0001f600": %s, "\ue000": [%s]}, "\U0001f600": "x"}' % (n, n, n) for n in NUMBERS]


def test_odd_numbers_and_keys_verify(spark):
    """Chains of numbers that are no decimals and of keys beyond the first plane."""
    df = spark.createDataFrame([("a", i, "t", r) for i, r in enumerate(ODD)], "repo string, ord long, timestamp_utc string, record string").repartition(3)
    lines = by_repo(audit.append(df))["a"]
    assert python_verify(lines) == (len(ODD), None)
    check = lambda ls: audit.verify(spark.createDataFrame([("a", i, x) for i, x in enumerate(ls)], "repo string, pos long, raw string"), chunk=5).first()
    assert check(lines).chain_valid
    for old, new, same in (('"n":1.0,', '"n":1.00,', True), ('"n":1e+22,', '"n":1E22,', True), ('"n":1.0,', '"n":1,', False), ('"n":1e-07,', '"n":1.1e-07,', False),
                           ('"seq":1,', '"seq":1.0,', False), ('0.30000000000000004', '0.3', False)):
        changed = [x.replace(old, new) for x in lines]
        assert changed != lines and (check(changed).first_invalid_seq is None) == same
        assert (check(changed).entry_count, check(changed).first_invalid_seq) == python_verify(changed)


def test_records_that_cannot_be_logged(spark):
    records = ["", "[]", "{", '{"seq": 1}', '{"a": 1, "prevHash": null}', '{"a": "\\ud800"}', '{"a": 1, "a": 2}', "{}", None, '{"entryHash": "x"}']
    df = spark.createDataFrame([("a", i, "t", r) for i, r in enumerate(records)], "repo string, ord long, timestamp_utc string, record string")
    lines = by_repo(audit.append(df))["a"]
    assert [json.loads(x).get("a") for x in lines] == [2, None] and python_verify(lines) == (2, None)
    assert sorted(r.ord for r in audit.rejected(df).collect()) == [0, 1, 2, 3, 4, 5, 8, 9]


def test_tail_and_sessions(spark):
    log = chain(spark, [("a", i, {"op": i}) for i in range(9)])
    assert [json.loads(r.raw)["seq"] for r in audit.tail(log, 3).orderBy("back").collect()] == [9, 8, 7]
    records = [("r", "s1", 1, "active"), ("r", "s2", 2, "active"), ("r", "s1", 3, "destroyed")]
    df = spark.createDataFrame(records, "repo string, session_id string, pos int, status string")
    assert {r.session_id: r.status for r in audit.latest_sessions(df).collect()} == {"s1": "destroyed", "s2": "active"}


@pytest.mark.parametrize("split", [1, 37, 4000, 1 << 20])
def test_log_files_at_any_split(spark, tmp_path, split):
    """One scan, no join, and positions as a sequential read has them."""
    entries = by_repo(chain(spark, [("a", i, {"op": i}) for i in range(40)]))["a"]
    texts = {"a": "\n".join(entries) + "\n", "b": "\r\n".join(entries), "c": "x\r\ry\n\n\xff".encode("latin1").decode("latin1"), "d": ""}
    want = []
    for repo, content in texts.items():
        (tmp_path / repo).mkdir()
        raw = content.encode("latin1")
        (tmp_path / repo / "audit.jsonl").write_bytes(raw)
        at = 0
        for piece in raw.splitlines(keepends=True):
            want.append((repo, at, at + len(piece), piece.rstrip(b"\r\n").decode("utf-8", "replace")))
            at += len(piece)
    if split == 1:
        want = [w for w in want if w[0] in "cd"]
    pattern = str(tmp_path / "*" / "audit.jsonl") if split > 1 else [str(tmp_path / r / "audit.jsonl") for r in "cd"]
    df = logs.read_lines(spark, pattern, r"/([^/]+)/audit\.jsonl$", split)
    assert "Join" not in df._jdf.queryExecution().toString() and "Exchange" not in df._jdf.queryExecution().toString()
    assert sorted((r.repo, r.pos, r.next, r.raw) for r in df.collect()) == sorted(want)
    if split > 1:
        log = logs.audit_log(spark, pattern, r"/([^/]+)/audit\.jsonl$", split)
        assert {r.repo: (r.chain_valid, r.entry_count) for r in audit.verify(log, chunk=500).collect() if r.repo in "ab"} == {"a": (True, 40), "b": (True, 40)}


def test_lines_hold_for_any_chunk(monkeypatch):
    import re

    from codequarry.sources import lines
    rng = random.Random(3)
    for _ in range(400):
        monkeypatch.setattr(lines, "CHUNK", rng.choice([1, 2, 3, 7, 50]))
        data = b"".join(rng.choice([b"a", b"bc", b"\n", b"\r", b"\r\n", b"x" * 9, "é".encode()]) for _ in range(rng.randint(0, 30)))
        want, at = [], 0
        for m in re.finditer(rb"\r\n|\n|\r", data):
            want.append((at, m.end(), data[at:m.start()]))
            at = m.end()
        want += [(at, len(data), data[at:])] if at < len(data) else []
        for split in (1, 2, 5, 1000):
            got = [x for a in range(0, len(data), split)
                   for x in lines.lines(lambda o, n: data[o:o + n] if n > 0 else b"", a, min(a + split, len(data)), len(data))]
            assert got == want


def test_log_stream_takes_what_was_added(spark, tmp_path):
    path = tmp_path / "a.log"
    seen = []
    for i, added in enumerate([b"one\ntw", b"o\n", b"", b"three\nfour"]):
        with open(path, "ab") as handle:
            handle.write(added)
        stream = logs.stream_lines(spark, str(tmp_path / "*.log"), r"/(\w+)\.log$", split_bytes=3)
        query = (stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
                 .trigger(availableNow=True).start())
        query.awaitTermination(120)
        seen = sorted((r.pos, r.next, r.raw) for r in spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).collect())
    assert seen == [(0, 4, "one"), (4, 8, "two"), (8, 14, "three")]


def test_history_and_session_logs(spark, tmp_path):
    us = "\x1f"
    (tmp_path / "r.log").write_text(f"h1{us}A{us}A@x{us}2024-01-02T03:04:05+02:00{us}{'s' * 250}\nshort{us}line\nh2{us}B{us}a@X{us}bad{us}t{us}extra\n")
    (tmp_path / "r.names").write_text("b.txt\n\n a.txt \nb.txt\nc.txt\n")
    (tmp_path / "r.sessions").write_text('{"sessionId":"s","status":"active","createdAtUtc":"t"}\nnot json\n\n{"sessionId":"s","status":"destroyed"}\n')
    read = logs.read_lines(spark, str(tmp_path / "r.log"), r"/(\w+)\.log$")
    assert sorted(len(r.subject) for r in logs.commit_records(read).collect()) == [1, 250]
    commits = logs.commit_records(read, subject_chars=200)
    got = {r.hash: (r.repo, r.email, len(r.subject), str(r.ts)) for r in commits.collect()}
    assert got == {"h1": ("r", "A@x", 200, "2024-01-02 01:04:05"), "h2": ("r", "a@X", 1, "None")}
    from codequarry.operators import history
    assert history.commit_summary(commits).first().distinct_authors == 1
    names = logs.change_records(logs.read_lines(spark, str(tmp_path / "r.names"), r"/(\w+)\.names$"))
    assert [(r.file, r.changes) for r in history.churn_from_names(names).orderBy("pos").collect()] == [("b.txt", 2), ("a.txt", 1), ("c.txt", 1)]
    sessions = logs.session_records(logs.read_lines(spark, str(tmp_path / "r.sessions"), r"/(\w+)\.sessions$"))
    assert [(r.session_id, r.status) for r in audit.latest_sessions(sessions).collect()] == [("s", "destroyed")]


def test_records_are_dealt_out_before_they_are_prepared(spark):
    df = spark.createDataFrame([("a", i, "t", f'{{"op":{i}}}') for i in range(9)], "repo string, ord long, timestamp_utc string, record string").coalesce(1)
    plan = audit.append(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2 and plan.rindex("RepartitionByExpression [ord") > plan.rindex("MapInArrow")


def test_number_log_is_verified_from_storage(spark):
    """Entries are not taken apart in the few tasks that chain them."""
    from __spark_entry__ import SMOKE, queries

    assert queries()["audit_verify_numbers"](spark, SMOKE)._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
