"""Content functions against plain Python on every document and on awkward strings."""

import hashlib
import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from codequarry import rules
from codequarry.functions import text
from codequarry.functions.regex import jvm

AKIA = "AK" + "IA" + "ABCDEFGHIJKLMNOP"
AWKWARD = [
    "", "\n", "\n\n", "a", "a\n", "a\r\nb", "a\rb\r", "x\x0by\x0cz", "p\x1cq\x1dr\x1es\x1ft", "n\x85m k j", "no end\r\n\r\n",
    "pass word", "password = '0123456789abcdef0'", "token\u001f: \"ABCDEFGHIJKLMNOPQRST\"", "éfor if(x) while", "áif b",
    "debug then Todo", "TODOs and TODO", "token = AbCdEfGh12345678", "='aaaaaaaaaaaaaaaa'", "k:aaaaaaaaaaaaaaaa=bbbbbbbbbbbbbbbbbb;",
    "x aaaaaaaaaaaaaaaaa ", "(aaaaaaaaaaaaaaaaaaa)", "else if elif case||&&", "else  if", AKIA + " " + AKIA, "  padded  ",
    "https://u:p@h https://u:p@", "-----BEGIN RSA" + " PRIVATE KEY-----", "SECRET='" + "z" * 16 + "'", "paſſword='" + "z" * 16 + "'",
]
SIGNATURES = [(n, re.compile(p, re.I if i else 0)) for n, p, i in rules.SECRET_SIGNATURES]


@pytest.fixture(scope="module")
def samples(spark):
    docs = [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    texts = AWKWARD + docs
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(5)

    def check(column, expected):
        got = {r[0]: r[1] for r in df.select("i", column.alias("v")).collect()}
        for i, t in enumerate(texts):
            want = expected(t)
            assert got[i] == want, (t[:200], got[i], want)

    return check


T = F.col("t")


def test_lines(samples):
    samples(text.lines(T), lambda t: t.splitlines())
    samples(text.lines_kept(T), lambda t: t.splitlines(keepends=True))
    samples(text.line_count(T), lambda t: t.count("\n") + (not t.endswith("\n")) if t else 0)


def redact(t):
    for name, pattern in SIGNATURES:
        t = pattern.sub(f"[REDACTED:{name}]", t)
    return t


def first(t):
    return next((n for n, p in SIGNATURES if p.search(t)), None)


def test_signatures(samples):
    samples(text.redact(T), redact)
    samples(text.first_rule(T), first)
    samples(text.strip(T), str.strip)


def test_every_signature_implies_its_literals(spark):
    examples = {
        "private-key": "-----BEGIN EC" + " PRIVATE KEY-----", "github-token": "gh" + "o_" + "a" * 20, "openai-key": "s" + "k-" + "a" * 20,
        "aws-access-key": AKIA, "slack-token": "xo" + "xp-" + "a" * 10, "jwt": "ey" + "J" + "a" * 8 + "." + "b" * 8 + "." + "c" * 8,
        "url-basic-auth": "ftp://a:b@"}
    cases = [(n, t) for n, t in examples.items()]
    cases += [("generic-secret-assignment", f"{w}: '" + "q" * 16 + "'") for w in
              ("apikey", "api-key", "API_KEY", "Secret", "\u017fecret", "password", "PASSWD", "token", "TO\u212aEN", "ap\u0131key")]
    df = spark.createDataFrame(cases, "n string, t string")
    for r in df.select("n", "t", text.first_rule(T).alias("f"), text.has_secret_hint(T).alias("h"), text.redact(T).alias("r")).collect():
        assert (r.f, r.h, r.r) == (r.n, True, redact(r.t)), r.t


def test_counts(samples):
    todo, branch = re.compile(rules.TODO_PATTERN, re.I), re.compile(rules.BRANCH_PATTERN)
    samples(text.todo_kind(T), lambda t: m.group(1).upper() if (m := todo.search(t)) else "")
    samples(text.branch_count(T), lambda t: len(branch.findall(t)))


def entropy(token):
    return -sum(n / len(token) * math.log2(n / len(token)) for n in Counter(token).values()) if token else 0.0


def test_tokens(samples, spark):
    pattern = re.compile(rules.TOKEN_PATTERN)
    samples(F.flatten(F.transform(text.lines(T), text.tokens)),
            lambda t: [m.group(1) for line in t.splitlines() for m in pattern.finditer(line)])
    words = ["", "a", "ab", "aabb", "0123456789abcdef", "abcdefgh" * 2, "x" * 40 + "y", "Zm9vYmFyYmF6cXV4Cg==/+", "q" * 9]
    df = spark.createDataFrame([(w,) for w in words], "t string")
    for r in df.select("t", text.shannon_entropy(T).alias("h"), text.token_hash(T).alias("s"), text.token_preview(T).alias("p")).collect():
        assert r.h == pytest.approx(entropy(r.t), abs=1e-12)
        assert r.s == hashlib.sha256(r.t.encode()).hexdigest()[:16]
        n = 2 if len(r.t) <= 8 else 3 if len(r.t) <= 20 else 4
        assert r.p == f"{r.t[:n]}...{r.t[-n:]}"


def test_rounding_is_pythons(spark):
    pairs = [(k, n) for n in (3, 7, 8, 16, 160, 800, 1600, 20000) for k in range(1, n, max(1, n // 50))]
    df = spark.createDataFrame(pairs, "a long, b long")
    for r in df.select("a", "b", text.percent(F.col("a"), F.col("b")).alias("p")).collect():
        assert r.p == round(100 * r.a / r.b, 2)
    assert df.select(text.percent(F.lit(0), F.lit(0))).first()[0] == 0.0


@pytest.mark.parametrize("raw", [b"", b"plain", b"a\x00b", b"\x01" * 31 + b"x" * 69, b"\x01" * 30 + b"x" * 70, b"\x0b\x0c\r\n\t" * 9,
                                 b"x" * 8192 + b"\x00", b"x" * 8191 + b"\x00", bytes(range(128, 256)) * 40, b"\x7f\x1b\x1b"])
def test_binary(spark, raw):
    def expected(sample):
        if not sample:
            return False
        return b"\0" in sample or sum(b < 9 or 14 <= b < 32 for b in sample) / len(sample) > 0.30

    df = spark.createDataFrame([(bytearray(raw),)], "c binary")
    assert df.select(text.is_binary(F.col("c"))).first()[0] == expected(raw)


@pytest.mark.parametrize("raw", [b"ok", b"\xff", b"a\xe2\x82", b"\xf0\x9f\x98", b"\xc0\xaf", b"\xed\xa0\x80", "é".encode()[:1] + b"x"])
def test_decoding(spark, raw):
    df = spark.createDataFrame([(bytearray(raw),)], "c binary").select(text.text_of(F.col("c")).alias("t"))
    got = df.select("t", text.replaced_count(F.col("t")).alias("n")).first()
    assert got.t == raw.decode("utf-8", "replace") and got.n == got.t.count("�")


def test_translation():
    assert jvm(r"[^\s:]\s(?P<x>a)\Z") == r"(?Ud)[^\s\x1c-\x1f:][\s\x1c-\x1f](?<x>a)\z"
