import hashlib
import random
import re

import duckdb
import pytest

from codequarry.llm import queries, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, width=50):
    texts = [WORD.findall(t or "") for _, t in rows]
    first = {}
    for (k, _), words in zip(rows, texts):
        if k is not None:
            for i in range(len(words) - width + 1):
                w = tuple(words[i:i + width])
                first[w] = min(k, first.get(w, k))
    out = []
    for (k, _), words in zip(rows, texts):
        gone = set()
        for i in range(len(words) - width + 1):
            if k is not None and first.get(tuple(words[i:i + width]), k) < k:
                gone.update(range(i, i + width))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((k, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows, width=50):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS tag", "2 AS n_words", "'k' AS kept", "3 AS at").repartition(5)
    done = substring_dedup.remove(df, width=width)
    assert {"tag", "at", "text"} <= set(done.columns)
    got = done.selectExpr("doc_id", "n_words", "n_removed", "sha2(encode(kept, 'UTF-8'), 256)").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, width)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_passages(spark, seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(400)}"
    shared = [[word() for _ in range(n)] for n in (49, 50, 51, 60, 120, 300)]
    rows = []
    for i in range(150):
        words = [word() for _ in range(rng.randint(0, 80))]
        for _ in range(rng.randint(0, 3)):
            passage = rng.choice(shared)
            a = rng.randint(0, 20)
            words += passage[a:] if rng.random() < 0.5 else passage
            words += [word() for _ in range(rng.randint(0, 40))]
        rows.append((rng.randint(0, 5000), " ".join(words)))
    rows += rows[:20] + [(k + 1, t) for k, t in rows[20:40]]  # repeated rows and copies
    rows += [(9000, "a " * 500), (9001, "a " * 300), (9002, "a " * 49), (9003, "a b " * 400), (9001, "b a " * 200)]
    check(spark, rows)


def test_edges(spark):
    long = " ".join(f"x{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (None, long), (5, long), (6, "pre " + long), (None, long), (7, long.replace("x100 ", "y ")), (6, long[:2000])]
    check(spark, rows)
    check(spark, [])
    check(spark, [(2, "a b c d e f g"), (1, "x b c d e"), (3, "c d e f\tz")], width=4)


def test_query(spark):
    rows = duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()
    got = queries.QUERIES["op9_substring_dedup"](spark, "/root/testdata/sf0.01").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_words_that_polynomials_confuse(spark):
    one = "a"
    while len(one) < 1024:
        one += one.translate(str.maketrans("ab", "ba"))
    two, rest = one.translate(str.maketrans("ab", "ba")), " ".join(f"y{i}" for i in range(60))
    check(spark, [(1, f"{one} {rest}"), (2, f"{two} {rest}"), (3, f"{one} {rest}")])


def test_phrases_without_variants_are_not_opened(spark, monkeypatch):
    """Of whole copies no window is moved; with one changed word, only those of phrases around it."""
    copied = " ".join(f"c{i}" for i in range(3000))
    changed = " ".join(f"d{i}" for i in range(3000))
    rows = [(1, copied), (2, copied), (3, changed), (4, changed.replace("d1500 ", "other "))]
    tables, stored = {}, substring_dedup.stored
    monkeypatch.setattr(substring_dedup, "stored", lambda df, name: tables.setdefault(name, stored(df, name)))
    check(spark, rows)
    assert "windows" not in tables["phrases"].columns + tables["reference"].columns
    windows = tables["opened"].selectExpr("sum(octet_length(windows)) / 8").first()[0]
    assert 100 <= windows < 600 < tables["reference"].selectExpr("sum(size)").first()[0]
