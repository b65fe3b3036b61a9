import os
import pathlib
import random
import re

import pytest
from pyspark.sql import functions as F

from codequarry import rules
from codequarry.functions import paths

P = F.col("p")
SAMPLE = [
    "README.md", "src/a.py", "src/A2.py", "src/b/c.py", "src/b.py", "a/z", "a/b/c", "a/B", "ab/x", ".env", ".env.example", ".ENV.sample", "x/.env.prod",
    "build", "src/target/x", "targets/x", "node_modules/a.js", "Secrets.yaml", "cfg/credentials/x", "secret_keys.txt", "mysecrets", "my.secrets.txt",
    "id_rsa", "id_rsa.pub", "k/server.PEM", ".github/workflows/ci.yml", ".GITHUB/WORKFLOWS/x", "Jenkinsfile", "ci/azure-pipelines.yml", "test", "a/tests/b",
    "a.spec.ts", "a.test.tar.gz", "spec/x", "Dockerfile", "docker-compose.yaml", "k8s/x", "poetry.lock", "go.sum", "Cargo.toml", "a.tar.gz", "..a", "a.", "a..b",
    "Straße/x", "STRASSE/y", ".git/config", "x/.sdlc/a", "dist", "a.min.js", "img.PNG", "x\ny.env", "été/ÉTÉ.md",
]


@pytest.fixture(scope="module")
def check(spark):
    df = spark.createDataFrame([(p,) for p in SAMPLE], "p string")

    def run(column, expected):
        for p, v in df.select("p", column).collect():
            assert v == expected(p), p

    return run


def test_names(check):
    check(paths.base_name(P), lambda p: pathlib.PurePosixPath(p).name)
    check(paths.suffix(P), lambda p: "" if p in ("a.",) else pathlib.PurePosixPath(p).suffix.lower())
    check(paths.depth(P), lambda p: p.count("/"))


def test_rules(check):
    name = lambda p: p.split("/")[-1]
    search = lambda pattern: (lambda p: bool(re.search(pattern, p, re.I)))
    check(paths.not_ignored(P), lambda p: not set(p.split("/")) & set(rules.IGNORED_NAMES))
    check(paths.is_protected(P), lambda p: bool(set(p.split("/")) & {".git", ".sdlc"}))
    check(paths.is_manifest(P), lambda p: name(p) in rules.MANIFEST_NAMES)
    check(paths.is_lockfile(P), lambda p: name(p) in rules.LOCKFILE_NAMES)
    check(paths.is_ci(P), search(rules.CI_PATTERN))
    check(paths.is_test(P), search(rules.TEST_PATTERN))
    check(paths.is_infrastructure(P), search(rules.INFRASTRUCTURE_PATTERN))
    check(paths.is_sensitive_path(P), lambda p: search(rules.SENSITIVE_PATH_PATTERN)(p) and name(p) not in rules.ENV_TEMPLATE_NAMES)
    check(paths.is_sensitive_file(P), lambda p: search(rules.SENSITIVE_FILE_PATTERN)(p) and name(p).lower() not in rules.ENV_TEMPLATE_NAMES)
    check(paths.is_write_sensitive(P), lambda p: search(rules.WRITE_SENSITIVE_PATTERN)(name(p)) and name(p) not in rules.ENV_TEMPLATE_NAMES)
    check(paths.entropy_skipped(P), lambda p: paths_suffix(p) in rules.ENTROPY_IGNORED_SUFFIXES)


def paths_suffix(p):
    return pathlib.PurePosixPath(p).suffix.lower()


def test_poetry_lock_is_both():
    assert "poetry.lock" in rules.MANIFEST_NAMES and "poetry.lock" in rules.LOCKFILE_NAMES


def depth_first(all_paths):
    """Files of a folder by folded name, then each folder."""
    here = sorted((p for p in all_paths if "/" not in p), key=lambda p: (p.casefold(), p))
    below = {}
    for p in all_paths:
        if "/" in p:
            below.setdefault(p.split("/", 1)[0], []).append(p.split("/", 1)[1])
    for folder in sorted(below, key=lambda n: (n.casefold(), n)):
        here += [f"{folder}/{p}" for p in depth_first(below[folder])]
    return here


def test_walk_order(spark):
    rnd = random.Random(3)
    sample = sorted({"/".join(rnd.choice(["a", "B", "ab", "a-b", "a.b", "Z", "_", "é", "0"]) for _ in range(rnd.randint(1, 4))) + rnd.choice(["", ".x"])
                     for _ in range(300)})
    df = spark.createDataFrame([(p,) for p in sample], "p string").repartition(4)
    assert [r.p for r in df.orderBy(paths.walk_key(P), "p").collect()] == depth_first(sample)


def test_containment(spark):
    cases = ["a", "../x", "a/../../x", "a/../b", "./", "", "  ", "a\0b", "/etc/passwd", "/root/repo/x", "/root/repository", "x" * 4097, "..", "a/..", "../repo/a", "/root/repo/../repo/b"]
    df = spark.createDataFrame([(c,) for c in cases], "p string")
    for p, v in df.select("p", paths.is_within_root(P, "/root/repo")).collect():
        full = os.path.normpath(os.path.join("/root/repo", p))
        want = bool(p.strip()) and "\0" not in p and len(p) <= 4096 and os.path.commonpath(["/root/repo", full]) == "/root/repo"
        assert v == want, p


def test_versions(spark):
    for value, ok in {"1.2.3": True, "1.2": False, "1.2.3-rc.1+b": True, "v1.2.3": False, "1.2.3\n": False, "1.2.3_": False}.items():
        assert spark.createDataFrame([(value,)], "p string").select(paths.is_semver(P)).first()[0] == ok
