import hashlib
import random
import re

import duckdb

from codequarry.llm import pii, queries

CONTRACT = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base(text):
    out = []
    for kind, pattern in CONTRACT.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)) or (
                    kind == "phone" and not 8 <= len(digits) <= 15):
                continue
            out.append((kind, m.start(), m.end()))
    return out


def expected(doc_id, text):
    found = base(text)
    joined = ",".join(f"{k}:{a}:{b}" for k, a, b in found)
    return (doc_id, *(sum(f[0] == k for f in found) for k in CONTRACT), hashlib.sha256(joined.encode()).hexdigest()), joined


def check(rows, got):
    want = [expected(*r) for r in rows]
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted((w[0] for w in want), key=str)
    by = {(k[0], k[5]): joined for k, joined in want}
    for r in got:
        assert ",".join(s for s in r.spans.split(",") if s and not s.startswith("term")) == by[r.doc_id, r.base_sha256]


def run(spark, rows, tmp_path):
    spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS tag", "'x' AS spans", "2 AS kind").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    return queries.QUERIES["op8_pii"](spark, str(tmp_path)).collect()


def test_random_marks(spark, tmp_path):
    rng = random.Random(3)
    pieces = ["a@b.c", "@", ".", "..", "x_%+-", "1.2.3.4", "255", "256", "4111 1111 1111 1111", "4111111111111111", "-", " ", "+1 (555) 123-4567", "+", "(", ")", "é", "\U0001F600",
              "\n", "0", "00", "é@b.co", "A.b-c@d-e.f.g", "999.1.1.1", "_", "5500-0000-0000-0004", "+49", "7", "word"]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 25)))) for i in range(3000)]
    rows += rows[:10] + [(None, "null key a@b.cd"), (None, None), (5000, None), (5001, ""), (5002, "1" * 4_000), (5003, "a" * 100_000 + "@b.c"), (5004, "1.2.3.4 " * 10_000),
                         (5005, "+1" + " " * 50_000 + "2"), (5, "same id 10.0.0.1"), (5006, "a" * 4_000)]
    check(rows, run(spark, rows, tmp_path))


def test_driver_documents(spark):
    rows = duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()
    check(rows, queries.QUERIES["op8_pii"](spark, "/root/testdata/sf0.01").collect())


def test_words_that_disclose(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(300)]
    text = lambda n=40: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, f"{text()} Quixotica {text()} zed.42@mail.example.com {text()}") for i in range(6)]  # the word comes with the address only
    rows += [(10 + i, f"{text()} common {text()} ann.{i % 2}@mail.example.com") for i in range(6)]
    rows += [(100 + i, f"{text()} common") for i in range(200)]
    copied = f"{text()} uniqueword here 10.1.2.3 {text()}"
    rows += [(400 + i, copied) for i in range(8)]  # copies are one witness
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.spans for r in pii.find(df).collect()}
    for i in range(6):
        term = [s for s in got[i] if s.kind == "term"]
        assert len(term) == 1 and rows[i][1][term[0].start:term[0].end] == "Quixotica"
    assert all(s.kind != "term" for k, v in got.items() if k >= 6 for s in v)
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert "Quixotica" not in clean[0] and "<email>" in clean[0] and "@" not in clean[0] and clean[100] == rows[12][1] and "<ip>" in clean[400]


def test_words_that_disclose_rare_entities(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(300)]
    text = lambda n=40: " ".join(rng.choice(words) for _ in range(n))
    rows = [(0, f"{text()} Quixotica {text()} quixotica.7@mail.example.com")]  # one document, and the address names the word
    rows += [(10 + i, f"{text()} Zanzibar {text()} u{i}@hidden.example.org {text()} odd{'klmnopqr'[i] * 4}") for i in range(8)]  # one domain, eight addresses
    rows += [(20, f"{text()} common {text()} common.3@mail.example.com"), (21, f"only.me.onlyname@x.example.com {text()}")]
    rows += [(100 + i, f"{text()} common") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    of = dict(rows)
    got = {r.doc_id: {of[r.doc_id][s.start:s.end] for s in r.spans if s.kind == "term"} for r in pii.find(df).collect()}
    assert got[0] == {"Quixotica"} and all(got[10 + i] == {"Zanzibar"} for i in range(8))
    assert not any(v for k, v in got.items() if k >= 20)
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert "Quixotica" not in clean[0] and all(clean[k] == of[k] for k in of if k >= 100)


def test_driver_documents_have_disclosing_words(spark):
    of = dict(duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.1/documents.parquet'").fetchall())
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r.spans for r in pii.find(docs).collect()}
    terms = {k: [of[k][s.start:s.end] for s in v if s.kind == "term"] for k, v in got.items()}
    # names that stand outside their addresses in at most two documents, counted on their own
    assert {w.lower() for v in terms.values() for w in v} >= {"desleleenpa", "reenorin", "isthhend", "anesntes", "leouanoiier"}
    assert all(base(of[k]) for k, v in terms.items() if v)
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert all(clean[k] == of[k] for k in of if not base(of[k]))


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert pii.find(df).count() == 0 and pii.sanitise(df).count() == 0
    odd = spark.createDataFrame([(None, None, 1), (1, "x 1.2.3.4 ü", 2), (1, "x 1.2.3.4 ü", 2)], "doc_id bigint, text string, kind int")
    assert sorted((r.text or "" for r in pii.sanitise(odd).collect())) == ["", "x <ip> ü", "x <ip> ü"]
