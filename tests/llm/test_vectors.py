import math
import random

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from codequarry.llm import forest, queries, topk

from pyspark.sql import functions as F

SCHEMA = "vec_id bigint, embedding array<float>"


def brute_scores(rows, every, k):
    out = []
    good = [(i, [max(-2**63, min(2**63 - 1, math.floor(64 * x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    for q, qv in sorted(set((i, tuple(v)) for i, v in good if i % every == 0)):
        found = sorted((-max(1 - 2**63, min(2**63 - 1, sum(a * b for a, b in zip(qv, v)))), i) for i, v in good if i != q and len(v) == len(qv))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


def noisy(seed, n, dims=8, scale=1.0):
    rng = random.Random(seed)
    rows = [(i, [float(np.float32(rng.gauss(0, scale))) for _ in range(dims)]) for i in range(n)]
    same = rows[3][1]
    rows += [(n + i, same) for i in range(n // 2)]  # a third of all rows are one vector
    return rows + [(5000, None), (5001, []), (5002, [0.0] * dims), (5003, [None] * dims), (5020, [float("nan")] * dims), (5040, [float("inf")] * dims), (None, same),
                   (5060, [1.0, 2.0]), (5061, [2.0, 1.0]), (20, rows[20][1]), (20, rows[21][1]), (7, rows[7][1]), (5080, [1e5] * dims), (5081, [1e30] * dims)]


def test_exact_search(spark):
    for seed, scale in ((1, 1.0), (2, 300.0)):
        rows = noisy(seed, 300, scale=scale)
        df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS key", "2 AS tag", "3 AS id").repartition(5)
        got = topk.top_k(df, F.col("vec_id") % 20 == 0, k=7).collect()
        assert sorted(map(tuple, got)) == brute_scores(rows, 20, 7)
    assert topk.top_k(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 20 == 0).count() == 0
    assert topk.top_k(spark.createDataFrame([(0, [1.0])], SCHEMA), F.col("vec_id") % 20 == 0).count() == 0


def test_bounds_stop_early_and_lose_nothing():
    rng = np.random.default_rng(3)
    for kind in (1, 40, 2**20):
        c = rng.integers(-20 * kind, 20 * kind, (500, 16))
        c[:50] *= 30  # few stand out
        q = rng.integers(-20 * kind, 20 * kind, (20, 16))
        exact = np.array((q.astype(object) @ c.astype(object).T).tolist(), dtype=object)
        none = (np.zeros(0, np.int64),) * 2
        row, col, score = topk.bounded_search(q, c, 5, np.full(20, -np.inf), none)
        for i in range(20):
            best = sorted(exact[i])[-5:]
            mine = sorted(int(s) for s in score[row == i])[-5:]
            assert mine == best
        if kind == 1:
            assert len(row) < exact.size / 4


def cosines(rows):
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good.setdefault(i, v)
    return good


def test_forest_is_exact_on_small_tables(spark):
    rng = random.Random(9)
    rows = [r for r in noisy(4, 300) if r[0] != 20 or r[1] is not None]
    rows += [(6000 + 10 * i, [rng.gauss(0, 1) for _ in range(3)]) for i in range(12)] + [(7000, [1.0, 0.0, 0.0, 1.0])]  # other lengths, one of them alone
    rows = [r for i, r in enumerate(rows) if r[0] is None or r[0] not in {x[0] for x in rows[:i]}]
    rows = [(i, v and [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    good = cosines(rows)
    df = spark.createDataFrame(rows + rows[:30], SCHEMA).selectExpr("*", "1 AS key", "2 AS tag").repartition(4)
    got = forest.nearest(df, F.col("vec_id") % 50 == 0).collect()
    for q in (i for i in good if i % 50 == 0):
        a = np.array(good[q])
        exact = sorted(((-float((np.array(v) * a).sum() / (np.sqrt((np.array(v) ** 2).sum()) * np.sqrt((a * a).sum()))), i) for i, v in good.items() if i != q and len(v) == len(a)))[:5]
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [m[1] for m in mine] == [i for _, i in exact] and np.allclose([m[2] for m in mine], [-s for s, _ in exact], atol=1e-12)
    assert {r.query_id for r in got} == {i for i in good if i % 50 == 0} - {7000}
    assert forest.nearest(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 50 == 0).count() == 0
    assert forest.nearest(spark.createDataFrame([(0, None), (50, [0.0])], SCHEMA), F.col("vec_id") % 50 == 0).count() == 0


def recall(ids, v, got):
    v = v / np.sqrt((v * v).sum(axis=1, keepdims=True))
    hits = total = 0
    for at in np.flatnonzero(ids % 50 == 0):
        score = v @ v[at]
        score[at] = -9
        best = set(ids[np.argsort(-score, kind="stable")[:5]].tolist())
        hits += len(best & got.get(int(ids[at]), set()))
        total += 5
    return hits / total


def lists(rows):
    out = {}
    for r in rows:
        out.setdefault(r.query_id, set()).add(r.vec_id)
    return out


def test_recall(spark):
    ids, v = zip(*duckdb.sql("SELECT vec_id, embedding FROM '/root/testdata/sf0.1/embeddings.parquet' ORDER BY vec_id").fetchall())
    got = lists(queries.QUERIES["op4_forest"](spark, "/root/testdata/sf0.1").collect())
    assert recall(np.array(ids), np.array(v, float), got) >= 0.9


def test_recall_on_a_larger_table(spark, tmp_path):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(20_000, 64)).astype(np.float32)
    pq.write_table(pa.table({"vec_id": pa.array(np.arange(len(v))), "embedding": pa.array(list(v), pa.list_(pa.float32()))}), str(tmp_path / "v.parquet"))
    df = spark.read.parquet(str(tmp_path / "v.parquet"))
    got = lists(forest.nearest(df, F.col("vec_id") % 50 == 0).collect())
    assert recall(np.arange(len(v)), v.astype(float), got) >= 0.9
