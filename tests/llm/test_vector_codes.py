import math
import random

import numpy as np
import pytest

from codequarry.llm import vector_codes


def brute(rows, parts, size, rounds):
    """Plain integer k-means of each part; rows are (vec_id, vector, label) of one length."""
    kept = [(k, [math.floor(256 * v) for v in x], label) for k, x, label in rows
            if x is not None and all(v is not None and math.isfinite(v) for v in x)]
    if not kept:
        return [], None
    bounds = vector_codes.cuts(len(kept[0][1]), parts)
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:size]
    books = [[r[1][a:b] for r in first] for a, b in bounds]

    def nearest(part, p):
        return min((sum((u - v) ** 2 for u, v in zip(part, e)), i) for i, e in enumerate(books[p]))

    def assigned():
        return [[nearest(x[a:b], p) for p, (a, b) in enumerate(bounds)] for _, x, _ in kept]

    for _ in range(rounds):
        at = assigned()
        for p, (a, b) in enumerate(bounds):
            for e in range(len(books[p])):
                mine = [x[a:b] for (_, x, _), t in zip(kept, at) if t[p][1] == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    at = assigned()
    total = {}
    for (_, _, label), t in zip(kept, at):
        total[label] = total.get(label, 0) + sum(d for d, _ in t)
    return [(k, label, bytes(e for _, e in t), sum(d for d, _ in t), total[label]) for (k, _, label), t in zip(kept, at)], books


def check(spark, rows, parts=16, size=64, rounds=2):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").selectExpr("*", "1 AS code", "'x' AS n", "2 AS length").repartition(3)
    got, books = vector_codes.compress(df, parts=parts, size=size, rounds=rounds)
    want, entries = brute([(k, None if x is None else [None if v is None else float(np.float32(v)) for v in x], c) for k, x, c in rows], parts, size, rounds)
    assert sorted(((r.vec_id, r.label, bytes(r.code), r.error, r.label_error) for r in got.collect()), key=str) == sorted(want, key=str)
    if entries:
        assert [b.tolist() for b in next(iter(books.values()))] == entries


def test_edges(spark):
    check(spark, [])
    check(spark, [(1, None, 1), (2, [float("nan")] * 16, 1), (3, [float("inf")] * 16, 2), (4, [None] * 16, 3)])
    same = [0.5, -0.25] * 8
    check(spark, [(7, same, None), (7, same, None), (None, [0.1] * 16, 1), (5, [-0.001] * 16, 1), (6, None, 1)])
    check(spark, [(1, [0.0, 1.0, 2.0], 1), (2, [0.5, 1.0, 2.0], 1)])  # fewer components than parts


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random(spark, seed):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.3) for _ in range(32)] for _ in range(5)]
    rows = [(rng.randrange(500), [v + rng.gauss(0, 0.05) for v in rng.choice(centres)], rng.choice([None, 1, 2])) for _ in range(400)]
    rows += [(600 + i, [round(rng.uniform(-1, 1) * 4) / 256 for _ in range(32)], 3) for i in range(200)]  # many ties
    check(spark, rows, parts=8, size=[7, 64, 1][seed - 1], rounds=seed + 1)


def test_large_components(spark):
    rng = random.Random(4)
    check(spark, [(i, [rng.uniform(-2e5, 2e5) for _ in range(4)], 0) for i in range(100)], parts=2, size=5, rounds=3)
    df = spark.createDataFrame([(1, [1e30], 1)], "vec_id bigint, embedding array<float>, label int")
    with pytest.raises(ValueError):
        vector_codes.compress(df)


def test_lengths_have_their_own_codebooks(spark):
    rng = random.Random(6)
    rows = [(i, [rng.random() for _ in range(8 if i % 3 else 4)], None) for i in range(90)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    got, books = vector_codes.compress(df, parts=4, size=6)
    assert sorted(books) == [4, 8]
    for n in (4, 8):
        want, _ = brute([(k, [float(np.float32(v)) for v in x], c) for k, x, c in rows if len(x) == n], 4, 6, 2)
        assert sorted((r.vec_id, bytes(r.code), r.error) for r in got.filter(f"length = {n}").collect()) == sorted((k, c, e) for k, _, c, e, _ in want)


def test_net_displacement_skips_scans():
    """Entries that move there and back leave the bounds of the first round whole."""
    rng = np.random.default_rng(1)
    first = rng.integers(-100, 100, (16, 4)).astype(np.float64) * 10
    x = (first[rng.integers(0, 16, 2000)] + rng.integers(-20, 20, (2000, 4))).astype(np.float64)
    code, own, low = vector_codes._scan(x, first)
    history, stamp = [first, first + 300, first + 1], np.zeros(2000, np.uint8)
    tally = []
    found = vector_codes.reassign(x, code, low, stamp, history, tally)
    assert (found[0] == vector_codes._scan(x, history[-1])[0]).all()
    assert tally[0][0] < 400  # the accumulated drift of about 1,200 would leave none
