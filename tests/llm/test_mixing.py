import random
from fractions import Fraction

import pytest

from codequarry.llm import mixing


def brute_targets(sizes):
    """sizes: {source: words}"""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    share = Fraction(3, 2) * sum(sizes.values())
    fixed = {}
    while True:
        rest = share - sum(fixed.values())
        w = sum(weight[s] for s in order if s not in fixed)
        level = {s: fixed.get(s, rest * weight[s] / w if w else 0) for s in order}
        above = [s for s in order if s not in fixed and level[s] > 2 * sizes[s]]
        if not above:
            return level
        for s in above:
            fixed[s] = Fraction(2 * sizes[s])


def rows_of(seed, n=400):
    rng = random.Random(seed)
    names = ["b", "B", "é", "\U0001F600", "￮", "a", None, ""]
    pick = lambda: names[0] if rng.random() < 0.4 else rng.choice(names)
    return [(rng.randint(0, 10**6) if rng.random() > 0.05 else None, pick(), " ".join(["w"] * rng.choice([0, 1, 5, 30, 200]))) for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_targets_and_takes(spark, seed):
    rows = rows_of(seed)
    rows += rows[:30] + [(7, "b", None), (8, "only blank", " \t"), (9, "huge", "x " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string").selectExpr("*", "1 AS size", "2 AS h", "3 AS target").repartition(5)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(df.repartition(3)).collect()), key=str)
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = brute_targets(sizes)
    by_target = {(r.source_size, round(r.target, 6)) for r in got}
    assert by_target == {(sizes[s], round(float(want[s]), 6)) for s in sizes}
    for s in sizes:
        part = [r for r in got if (r.source_size, round(r.target, 6)) == (sizes[s], round(float(want[s]), 6))]
        if len([x for x in sizes if sizes[x] == sizes[s]]) == 1:
            short = want[s] - sum(r.taken for r in part)
            assert 0 <= short + 1e-6 and short <= sum(sorted(r.size for r in part)[-30:])
    assert all(r.taken in (0, r.size, 2 * r.size) for r in got)


def test_empty(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id bigint, source string, text string")).count() == 0
    assert [r.taken for r in mixing.mix(spark.createDataFrame([(1, "a", None)], "doc_id bigint, source string, text string")).collect()] == [0]
