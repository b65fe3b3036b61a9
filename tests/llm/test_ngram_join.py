import random
import re

import duckdb
import pytest

from codequarry.llm import ngram_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i:i + 5]) for i in range(len(words) - 4))


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = {}
    for i, s in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(i)
    seen = set()
    for members in holders.values():
        for a in range(len(members)):
            for b in range(a + 1, len(members)):
                i, j = members[a], members[b]
                if (i, j) not in seen:
                    seen.add((i, j))
                    both = len(sets[i] & sets[j])
                    if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                        parent[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[root(i)] = min(k, least.get(root(i), k))
    return sorted(((k, len(sets[i]), least.get(root(i))) for i, (k, _) in enumerate(rows)), key=str)


def check(spark, rows, extra=""):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS n", "2 AS cls", "'x' AS component_id").repartition(4)
    got = ngram_join.groups(df)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_edges(spark):
    check(spark, [(1, None), (2, ""), (3, " \t\n"), (4, "a b c"), (5, "A B  C"), (6, "a b c d e"), (7, "b c d e f"), (7, "a b c d e"),
                  (8, "É b c d e"), (9, "é b c d e"), (None, "lone words of a null key here"), (None, "a b C"), (10, "x" * 5000)])
    check(spark, [])


@pytest.mark.parametrize("seed", [1, 2])
def test_chains_of_near_copies(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    base = [rng.choice(vocabulary) for _ in range(120)]
    common = [rng.choice(vocabulary) for _ in range(60)]
    for i in range(150):  # copies with up to eight words changed: some link only through others
        words = list(base)
        for _ in range(rng.randint(0, 8)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((i * 7 % 1000, " ".join(words)))
    drift = list(base)
    for i in range(40):
        drift[rng.randrange(len(drift))] = rng.choice(vocabulary)
        rows.append((2000 - i, " ".join(drift)))
    for i in range(60):
        rows.append((3000 + i, " ".join(common + [rng.choice(vocabulary) for _ in range(rng.randint(0, 90))])))
    rows += rows[:20]
    check(spark, rows)


def thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word


def test_words_that_polynomials_confuse(spark):
    one = thue_morse(1024)
    two = one.translate(str.maketrans("ab", "ba"))
    check(spark, [(1, one), (2, two), (3, one + " x"), (4, two + " x"), (5, one + " b c d e f"), (6, two + " b c d e f")])


def test_small_sets(spark):
    """Sets of three n-grams link with equal ones only, one of four with one of five."""
    words = [f"u{i}" for i in range(12)]
    rows = [(10 * n + k, " ".join(words[k:k + n])) for n in range(3, 11) for k in range(3)]
    check(spark, rows)


def test_driver_documents(spark):
    rows = duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()
    check(spark, rows)


def test_large_groups_of_near_copies(spark, monkeypatch):
    """Copies that link with their original only are one group before any column is multiplied out, and copies of one text, dealt in several
    batches, bring each of their columns once."""
    rng = random.Random(3)
    base = [f"b{i}" for i in range(120)]
    rows = [(i, " ".join(base)) for i in range(40)]
    for i in range(60):
        words = list(base)
        for k in rng.sample(range(10, 110, 10), 2):
            words[k] = f"x{i}-{k}"
        rows.append((5000 + i, " ".join(words)))
    held, products = [], ngram_join._products

    def watched(entries, label, *rest):
        held.append((label.select("label").distinct().count(), entries.count() - entries.distinct().count()))
        return products(entries, label, *rest)

    monkeypatch.setattr(ngram_join, "_products", watched)
    check(spark, rows)
    assert held == [(1, 0)]


def test_class_beside_a_whole_group(spark):
    """A class that shares enough columns with a group as a whole only, and one that links with a member that is not the group's centre."""
    rng = random.Random(4)
    base = [f"b{i}" for i in range(200)]
    rows = [(1, " ".join(base))]
    for i in range(30):
        words = list(base)
        for k in range(3):
            words[rng.randrange(200)] = f"x{i}-{k}"
        rows.append((10 + i, " ".join(words)))
    rows += [(100 + i, " ".join(base[:200 - 6 * i] + [f"y{i}-{k}" for k in range(4 * i)])) for i in range(1, 10)]
    check(spark, rows)


def _join_rows(plan):
    """Rows that each join of an executed plan made."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return _join_rows(plan.finalPhysicalPlan())
    if name.endswith("QueryStageExec"):
        return _join_rows(plan.plan())
    own = [plan.metrics().apply("numOutputRows").value()] if "Join" in name else []
    children = plan.children()
    return own + [r for i in range(children.size()) for r in _join_rows(children.apply(i))]


def test_products_with_a_large_group_are_counted_without_its_pairs(spark, monkeypatch):
    """400 near copies in one group, each without some of 40 columns, and others with a part of them: pairs as by brute force, no join of
    every other class with every copy."""
    rng, n = random.Random(5), 200
    sets = {f"c{i:03d}": set(range(40)) - set(rng.sample(range(40), rng.randint(0, 3))) for i in range(400)}
    sets |= {f"s{i:02d}": set(rng.sample(range(40), rng.choice([14, 17, 18, 18, 18, 18, 19]))) | {1000 + i % 7, 2000 + i // 5} for i in range(60)}
    label = {k: "c000" for k in sets if k[0] == "c"} | {"s00": "s00", "s01": "s00", "s02": "s00"}
    sizes = {k: n + rng.randint(0, 1) for k in sets}
    entries = spark.createDataFrame([(g, k.encode(), sizes[k]) for k, grams in sets.items() for g in grams], "gram bigint, cls binary, n bigint")
    labels = spark.createDataFrame([(k.encode(), v.encode()) for k, v in label.items()], "node binary, label binary")
    monkeypatch.setattr(ngram_join, "stored", lambda df, name="": df)  # one plan, to read its joins' rows
    got = ngram_join._products(entries, labels, "100 * least(nx, ny) >= 80 * greatest(nx, ny)", 80, 100)
    pairs = {(bytes(r.x).decode(), bytes(r.y).decode()): r.share for r in got.collect()}

    def need(a, b):
        return -(-80 * (a + b) // 180) - -(-80 * max(a, b) // 100) + 1

    expected = {(x, y): len(sets[x] & sets[y]) / max(sizes[x], sizes[y]) for x in sets for y in sets if x < y and label.get(x, x) != label.get(y, y)
                and len(sets[x] & sets[y]) >= need(sizes[x], sizes[y])}
    assert pairs == expected and 100 < len(expected) < 10_000
    assert max(_join_rows(got._jdf.queryExecution().executedPlan())) < 100_000  # 400 times the others times their columns would be 400,000
