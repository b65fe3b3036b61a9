"""Plan shapes and skew: what is read, what is shuffled, and that results do not depend on layout."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from catalog import QUERIES
from catalog.views import files as derived
from codequarry.operators import inventory, readiness, scan
from codequarry.plans.topn import top_n

DATA = "/root/testdata/sf0.001"


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("files") / "t")
    derived(spark, DATA).repartition(4).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("op", [inventory.path_flags, inventory.snapshot_counts, inventory.directory_tree, lambda d: inventory.sample(d, 10),
                                inventory.snapshot_members, readiness.signals, readiness.root_documents])
def test_path_operators_never_read_content(stored, op):
    reads = [line for line in plan(op(stored)).splitlines() if line.startswith("ReadSchema")]
    assert reads and all("content" not in line for line in reads)


def test_size_guard_reaches_the_scan(stored):
    assert "LessThanOrEqual(size_bytes" in plan(stored.filter(F.col("size_bytes") <= 1024))


def test_findings_need_no_shuffle(stored):
    for df in (scan.secret_findings(stored), scan.search_code(stored, "x"), scan.token_occurrences(stored), scan.redacted(stored)):
        assert "Exchange" not in plan(df)


def test_rollups_shuffle_once(stored):
    assert plan(scan.secret_scan(stored)).count("Exchange\nInput") == 1
    assert plan(readiness.risk_score(readiness.signals(stored, with_secrets=True))).count("Exchange\nInput") == 1


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_joins(spark, name):
    text = plan(QUERIES[name](spark, DATA))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_caps_are_cut_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    assert plan(top_n(df, ["k"], [F.col("id")], 5, ["id"])).count("WindowGroupLimit") >= 2


@pytest.mark.parametrize("partitions", [1, 3, 17])
def test_a_hot_key_changes_nothing(spark, partitions):
    # one key holds two thirds of the rows
    df = spark.range(3000).select(F.when(F.col("id") % 3 < 2, 0).otherwise(F.col("id") % 50).alias("k"), (F.col("id") * 7919 % 3001).alias("v")).repartition(partitions)
    rows = df.collect()
    for k in {r.k for r in rows}:
        want = sorted(r.v for r in rows if r.k == k)[:20]
        got = [r.v for r in top_n(df, ["k"], [F.col("v")], 20, ["v"]).filter(F.col("k") == k).orderBy("pos").collect()]
        assert got == want
        if k > 3:
            break


def test_layout_does_not_matter(stored):
    def result(df):
        return sorted(map(tuple, scan.secret_findings(df, max_findings=4).collect()), key=str), sorted(map(tuple, inventory.code_metrics(inventory.file_metrics(df)).collect()))

    assert result(stored.coalesce(1)) == result(stored.repartition(13, "path"))
