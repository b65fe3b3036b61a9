import hashlib
import random

import duckdb
import public_tokenizers
import pytest
import tiktoken

from codequarry.llm import bpe, queries

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RAW = open(PATH, "rb").read()
RANKS = bpe.read_ranks(RAW)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def ids_of(packed):
    return [int.from_bytes(packed[i:i + 4], "little") for i in range(0, len(packed), 4)]


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(RANKS, public_tokenizers.PATTERN)


def test_hard_texts(encoder):
    texts = ["", " ", "  ", "\n", " \n x", "a  b", "a\n\n b \t", "don't it's 'LL we'll", "x" * 3000, " " * 500 + "y", "ab" * 700, "ẞß été naïve x　",
             "日本語テキスト", "🙂👩‍👩‍👧", "12345 67", "a\x1cb \x85 c", "<|endoftext|> x", "́á", "0x1F_$%&&&### !!", "﻿bom", "١٢٣ Ⅷ ²", "a_b _c"]
    rng = random.Random(5)
    alphabet = "abeinrst ABÉéß日🙂\n\t 019.,'!_- "
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    for text in texts:
        assert ids_of(encoder.encode(text)) == LIBRARY.encode_ordinary(text), text


def test_random_bytes_pieces():
    transducer, rng = bpe.Transducer(RANKS), random.Random(6)
    tokens = list(RANKS)
    for _ in range(2000):
        piece = b"".join(rng.choice(tokens) for _ in range(rng.randint(1, 6)))
        if piece not in RANKS:
            assert transducer.encode(piece) == bpe.merged(RANKS, piece)


def test_tables_are_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "MOST_STATES", 50)
    monkeypatch.setattr(bpe, "MOST_CHUNKS", 20)
    encoder, rng = bpe.Encoder(RANKS, public_tokenizers.PATTERN), random.Random(7)
    for _ in range(300):
        text = " ".join("".join(rng.choice("aehinrst") for _ in range(rng.randint(3, 12))) for _ in range(5))
        assert ids_of(encoder.encode(text)) == LIBRARY.encode_ordinary(text)
    assert len(encoder.chunks) <= 20


def test_output_is_certain_before_the_end():
    transducer = bpe.Transducer(RANKS)
    fed = []

    def letters():
        for b in b"internationalisation" * 50:
            fed.append(b)
            yield b

    first = next(transducer.stream(letters()))
    assert first == transducer.encode(b"internationalisation" * 50)[0] and len(fed) <= bpe.LOOKAHEAD


def test_decoder_in_any_portions():
    tokens = bpe._token_list(RAW)
    text = "naïve 日本語 🙂 Straße"
    ids = LIBRARY.encode_ordinary(text)
    for step in (1, 2, 3, 7):
        decoder = bpe.Decoder(tokens)
        assert "".join([decoder.feed(ids[i:i + step]) for i in range(0, len(ids), step)] + [decoder.finish()]) == text
    broken = [RANKS[bytes([b])] for b in (0xE2, 0x82, 0x41, 0xFF, 0xF0, 0x9F)]
    decoder = bpe.Decoder(tokens)
    out = "".join([decoder.feed([i]) for i in broken] + [decoder.finish()])
    assert "A" in out and out.count("�") >= 3


def test_columns_and_nulls(spark):
    df = spark.createDataFrame([(1, None, "k", "old"), (2, "", None, "old"), (3, "Hi there", "k", None), (3, "Hi there", "k", None)], "doc_id int, text string, decoded string, ids string")
    rows = bpe.decode(bpe.encode(df, PATH, public_tokenizers.PATTERN), PATH).orderBy("doc_id").collect()
    assert [r.decoded for r in rows] == ["", "", "Hi there", "Hi there"] and ids_of(rows[2].ids) == LIBRARY.encode_ordinary("Hi there")
    both = bpe.round_trip(df, PATH, public_tokenizers.PATTERN).orderBy("doc_id").collect()
    assert [(r.doc_id, r.decoded, r.ids) for r in both] == [(r.doc_id, r.decoded, r.ids) for r in rows]
    assert bpe.encode(df.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_long_texts(spark, monkeypatch):
    """Texts far longer than a portion, in one chunk and in many."""
    monkeypatch.setattr(bpe, "PART", 1000)
    rng = random.Random(9)
    texts = ["".join(rng.choice("aeinrst é") for _ in range(60_000)), "word " * 40_000, "x" * 30_000, "🙂" * 20_000]
    rows = bpe.round_trip(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), PATH, public_tokenizers.PATTERN).collect()
    for r in rows:
        assert r.decoded == texts[r.doc_id] and ids_of(r.ids) == LIBRARY.encode_ordinary(texts[r.doc_id])


def test_query(spark):
    rows = duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()
    want = set()
    for doc_id, text in rows:
        ids = LIBRARY.encode_ordinary(text or "")
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        want.add((doc_id, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert set(map(tuple, queries.QUERIES["op1_bpe"](spark, "/root/testdata/sf0.01").collect())) == want
