import hashlib

import pytest
from pyspark.sql import functions as F

from codequarry.operators import changes, merge

ROOT = "/srv/code"
NOW = F.lit("2024-05-01 10:00:00").cast("timestamp")
EDIT = "repo string, path string, mode string, content string, expected_sha256 string, allow_sensitive boolean"


def edits(spark, *rows):
    return spark.createDataFrame([("r", *row) for row in rows], EDIT)


def content(df):
    return {r.path: bytes(r.content).decode() for r in df.collect()}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_write_modes_and_guards(spark, files):
    df = files(("r", "a.txt", "old"), ("r", "log.txt", "first\n"), ("r", "bin", b"\xff\xfe"), ("r", "big", "x" * 1_048_577), ("r", "k.txt", "k"), ("r", "twice", "1"))
    plan = changes.write_plan(edits(
        spark, ("a.txt", "overwrite", "new", sha("old"), False), ("log.txt", "append", "second\n", None, False), ("notes.md", "create", "alpha\n", None, False),
        ("k.txt", "create", "x", None, False), ("../evil.txt", "create", "x", None, True), (".git/config", "overwrite", "x", None, True),
        ("sub/.sdlc/x", "create", "x", None, True), (".env", "create", "x", None, False), ("x/.env", "create", "x", None, True), (".env.example", "create", "x", None, False),
        ("bin", "overwrite", "x", None, False), ("big", "overwrite", "x", None, False), ("m", "patch", "x", None, False), ("n", "create", None, None, False),
        ("h", "create", "x", "ABC", False), ("log2", "append", "only", None, False), ("huge", "create", "é" * 600_000, None, False),
        ("twice", "overwrite", "2", None, False), ("twice", "overwrite", "3", None, False)), df, ROOT, max_bytes=1 << 20)
    got = {r.path: r.reject_reason for r in plan.collect()}
    accepted = {p for p, reason in got.items() if reason is None}
    assert accepted == {"a.txt", "log.txt", "notes.md", "x/.env", ".env.example", "log2"}
    for path, word in {"k.txt": "already there", "../evil.txt": "leads out", ".git/config": "closed", "sub/.sdlc/x": "closed", ".env": "sensitive",
                       "bin": "no UTF-8", "big": "1048576 bytes", "m": "unknown mode", "n": "no content", "h": "hex", "huge": "1048576 bytes", "twice": "more than once"}.items():
        assert word in got[path], path
    after = changes.apply_plan(df.filter("path NOT IN ('bin', 'big')"), plan)
    assert content(after) == {"a.txt": "new", "log.txt": "first\nsecond\n", "notes.md": "alpha\n", "x/.env": "x", ".env.example": "x",
                              "log2": "only", "k.txt": "k", "twice": "1"}
    wrong = changes.write_plan(edits(spark, ("a.txt", "overwrite", "n", sha("other"), False)), df, ROOT).first()
    assert "has changed" in wrong.reject_reason and wrong.sha256_before == sha("old")


def test_any_size_unless_a_limit_is_given(spark, files):
    df = files(("r", "big", "x" * 1_048_577))
    edit = edits(spark, ("big", "append", "y" * 1_048_577, None, False))
    assert changes.write_plan(edit, df, ROOT).first().bytes_after == 2 * 1_048_577
    with pytest.raises(ValueError):
        changes.write_plan(edit, df, ROOT, max_bytes=0)


def test_replace_checks_occurrences(spark, files):
    df = files(("r", "app.txt", "v=1\nother\n"), ("r", "aaa", "aaaa"), ("r", "data.json", '{"key": "hello"}\n'))
    schema = "repo string, path string, find string, replace string, expected_occurrences int, allow_sensitive boolean"
    rows = [("r", "app.txt", "v=1", "v=2", 5, False), ("r", "aaa", "aa", "b", 2, False), ("r", "data.json", "hello", "", None, False), ("r", "none", "a", "b", 1, False)]
    plan = changes.replace_plan(spark.createDataFrame(rows, schema), df, ROOT)
    got = {r.path: (r.occurrences, r.reject_reason, r.after) for r in plan.collect()}
    assert got["app.txt"][:2] == (1, "occurs 1 times, not 5")
    assert got["aaa"] == (2, None, "bb") and got["data.json"] == (1, None, '{"key": ""}\n') and "no such file" in got["none"][1]


def test_rollback_undoes_an_applied_batch(spark, files):
    df = files(("r", "config.txt", "original"), ("r", "keep", "k"))
    plan = changes.write_plan(edits(spark, ("config.txt", "overwrite", "changed", None, False), ("new/x", "create", "n", None, False)), df, ROOT)
    ops, backups = changes.change_log(plan, "b1", NOW, digits=8)
    assert {len(r.change_id) for r in ops.collect()} == {len("20240501T100000Z-") + 8}
    after = changes.apply_plan(df, plan)
    assert content(after) == {"config.txt": "changed", "new/x": "n", "keep": "k"}
    undo = changes.rollback_plan(ops, backups, after, root=ROOT)
    assert {r.path: r.applied for r in undo.collect()} == {"config.txt": "restored", "new/x": "deleted-created-file"}
    assert content(changes.apply_rollback(after, undo)) == content(df)
    one = ops.filter("path = 'new/x'")
    assert content(changes.apply_rollback(after, changes.rollback_plan(ops, backups, after, one, root=ROOT))) == {"config.txt": "changed", "keep": "k"}
    lost = changes.rollback_plan(ops, backups.limit(0), after, root=ROOT)
    assert "no backup" in lost.filter("path = 'config.txt'").first().reject_reason


def test_rollback_of_two_changes_ends_before_the_first(spark, files):
    v0 = files(("r", "f", "0"))
    p1 = changes.write_plan(edits(spark, ("f", "overwrite", "1", None, False)), v0, ROOT)
    o1, b1 = changes.change_log(p1, "one", NOW)
    v1 = changes.apply_plan(v0, p1)
    p2 = changes.write_plan(edits(spark, ("f", "overwrite", "2", None, False)), v1, ROOT)
    o2, b2 = changes.change_log(p2, "two", F.lit("2024-05-02").cast("timestamp"))
    ops, backups, v2 = o1.unionByName(o2), b1.unionByName(b2), changes.apply_plan(v1, p2)
    assert content(changes.apply_rollback(v2, changes.rollback_plan(ops, backups, v2, root=ROOT))) == {"f": "0"}
    assert [r.operation_count for r in changes.newest_changes(ops).orderBy("pos").collect()] == [1, 1]
    newest = changes.newest_changes(ops, 1)
    assert newest.first().change_id.startswith("20240502") and changes.change_paths(ops, newest).count() == 1


def test_merge(files):
    base = files(("r", "same", "0"), ("r", "mine", "0"), ("r", "theirs", "0"), ("r", "both", "0"), ("r", "equal", "0"), ("r", "gone", "0"), ("r", "goneboth", "0"), ("q", "x", "0"))
    main = files(("r", "same", "0"), ("r", "mine", "0"), ("r", "theirs", "m"), ("r", "both", "m"), ("r", "equal", "e"), ("r", "gone", "m"), ("q", "x", "0"))
    shadow = files(("r", "same", "0"), ("r", "mine", "s"), ("r", "theirs", "0"), ("r", "both", "s"), ("r", "equal", "e"), ("r", "added", "a"), ("q", "x", "new"), ("q", "empty", ""))
    found = merge.three_way(base, main, shadow)
    assert {(r.path, r.change, r.conflict) for r in found.filter("repo = 'r'").collect()} == {
        ("mine", "M", False), ("both", "M", True), ("equal", "M", True), ("added", "A", False), ("gone", "D", False), ("goneboth", "D", False)}
    summary = {r.repo: (r.conflict_count, r.clean_count, r.has_conflicts) for r in merge.merge_summary(found).collect()}
    assert summary == {"r": (2, 2, True), "q": (0, 2, False)}
    held = merge.promote_plan(found)
    assert {r.action for r in held.filter("repo = 'r'").collect()} == {"held"}
    after = merge.promote(main, shadow, held)
    assert content(after.filter("repo = 'q'")) == {"x": "new", "empty": ""} and content(after.filter("repo = 'r'")) == content(main.filter("repo = 'r'"))
    forced = merge.promote_plan(found, force=True)
    assert {r.status for r in forced.filter("repo = 'r'").collect()} == {"conflicts-detected"}
    assert {r.path: r.action for r in forced.filter("repo = 'r'").collect()} == {
        "mine": "copied", "both": "copied", "equal": "copied", "added": "copied", "gone": "deleted", "goneboth": "none"}
    assert content(merge.promote(main, shadow, forced).filter("repo = 'r'")) == {
        "same": "0", "mine": "s", "theirs": "m", "both": "s", "equal": "e", "added": "a"}


def test_digits_range(spark, files):
    with pytest.raises(ValueError):
        changes.change_log(changes.write_plan(edits(spark, ("a", "create", "x", None, False)), files(("r", "z", "")), ROOT), "b", NOW, digits=7)
