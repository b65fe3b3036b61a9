import zlib

import duckdb
import pytest

from codequarry.llm import queries, quality


def auc(rows):
    rows = sorted(rows)
    good = [i for i, (_, y) in enumerate(rows) if y]
    n = len(good)
    return (sum(good) - n * (n - 1) / 2) / (n * (len(rows) - n))


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in queries.QUERIES["op10_quality"](spark, d).collect()}
    labels = duckdb.sql(f"SELECT doc_id, quality FROM '{d}/labels.parquet'").fetchall()
    assert len(got) == duckdb.sql(f"SELECT count(*) FROM '{d}/documents.parquet'").fetchall()[0][0]
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for k, r in got.items())
    held = [(got[k].score, y) for k, y in labels if got[k].held_out]
    assert auc(held) > 0.97
    assert sum((s >= 0.5) == (y == 1) for s, y in held) / len(held) > 0.95
    assert sum(s >= 0.5 for s, y in held if y) / sum(y for _, y in held) > 0.97


@pytest.fixture(scope="module")
def small(spark):
    good, bad = "the quiet river runs past old stone houses and green fields ", "BUY!!! $$$ NOW!!! %%% CLICK &&& "
    docs = [(i, (good if i % 2 else bad) * (i % 5 + 1) + str(i)) for i in range(60)] + [(100, None), (101, ""), (102, good * 20_000), (None, good), (5, good)]
    labels = [(i, i % 2) for i in range(40)] + [(3, 0), (None, 1), (7, None), (7, 1)]
    return (spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "'x' AS score", "1 AS y", "2 AS k"),
            spark.createDataFrame(labels, "doc_id bigint, quality int").selectExpr("*", "'z' AS text"))


def test_edges(small):
    docs, labels = small
    got = [tuple(r) for r in quality.scored(docs, labels).collect()]
    assert len(got) == 65 and got == [tuple(r) for r in quality.scored(docs, labels).collect()]
    by = {r[0]: r for r in got}
    assert 0 <= by[100][2] <= 1 and by[100][2] == by[101][2] and by[None][1] is False
    assert by[57][2] > by[58][2] and by[102][3] == 1


def test_no_labels_and_no_documents(small):
    docs, labels = small
    assert {r.predicted for r in quality.scored(docs, labels.limit(0)).collect()} == {1}
    assert quality.scored(docs.limit(0), labels).count() == 0


def test_bounds_do_not_move_the_share(spark, monkeypatch):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{d}/labels.parquet")
    rate = lambda model: quality.score(docs, model).selectExpr("avg(score)", "avg(CAST(score < 0.5 AS INT))").first()
    monkeypatch.setattr(quality, "DICTIONARY_DOCS", 150)
    whole = rate(quality.fit(docs, labels))
    monkeypatch.setattr(quality, "CALIBRATION_DOCS", 190)  # as many good ones as bad ones
    bounded = rate(quality.fit(docs, labels))
    assert abs(whole[0] - bounded[0]) < 0.01 and abs(whole[1] - bounded[1]) < 0.01, (whole, bounded)
