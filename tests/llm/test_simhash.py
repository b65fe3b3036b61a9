import random
import re

import numpy as np
import pytest
import xxhash

from codequarry.llm import simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_print(text):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return 0
    grams = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64(g.encode(), 42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, bits=4):
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(prints))]


def check(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS fp", "'x' AS component_id", "2 AS label").repartition(4)
    prints = [brute_print(t) for _, t in rows]
    label, least = brute_components(prints), {}
    for (k, _), r in zip(rows, label):
        if k is not None:
            least[r] = min(k, least.get(r, k))
    want = sorted(((k, f"{p:016x}", least.get(r)) for (k, _), p, r in zip(rows, prints, label)), key=str)
    got = simhash.groups(df, **kw)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_edges(spark):
    check(spark, [(1, None), (2, ""), (3, " \t\n"), (4, "a b c"), (5, "A B  C"), (6, "a b c d"), (7, "a b c d e"), (7, "a b c d e"), (None, "a b c"),
                  (None, "only null keys are here"), (8, "É b c d e"), (9, "é b c d e"), (10, "x" * 100_000), (11, "w " * 200_000), (12, "a b c d")])
    check(spark, [])


@pytest.mark.parametrize("most", [1 << 16, 5])
def test_near_copies(spark, most):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(200)]
    rows = []
    for c in range(8):
        base = [rng.choice(vocabulary) for _ in range(150)]
        for i in range(25):
            words = list(base)
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((rng.randrange(10_000), " ".join(words)))
    check(spark, rows, most=most)


@pytest.mark.parametrize("bits", [0, 1, 2, 3, 4, 5, 6])
def test_every_link_has_an_anchor(bits):
    rng = np.random.default_rng(bits)
    for _ in range(300):
        x = int(rng.integers(0, 1 << 63)) * 2 + int(rng.integers(2))
        y = x
        for p in rng.choice(64, bits, replace=False):
            y ^= 1 << int(p)
        keys = [set(simhash.anchors(np.array([v], np.uint64), bits)[0].tolist()) for v in (x, y)]
        assert keys[0] & keys[1]


def test_links_of_planted_fingerprints(spark):
    rng = random.Random(5)
    prints = {rng.getrandbits(64) for _ in range(300)}
    for p in list(prints)[:100]:  # chains of three and four changed bits
        for n in (3, 4, 4):
            for b in rng.sample(range(64), n):
                p ^= 1 << b
            prints.add(p)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp bigint").repartition(4)
    found = simhash.links(df, 4).collect()
    assert all(((r.x ^ r.y) & (1 << 64) - 1).bit_count() <= 4 for r in found)
    label = brute_components(prints)
    at = {p: i for i, p in enumerate(signed)}
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for r in found:
        parent[root(at[r.x])] = root(at[r.y])
    mine = [root(i) for i in range(len(prints))]
    assert len(set(mine)) == len(set(label)) == len(set(zip(mine, label)))
