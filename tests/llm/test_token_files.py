import json
import random
import struct
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from codequarry.llm import queries, token_files

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("values", [[7], [0, 0, 0], list(range(4096)), [5] * 4000 + [2**63], [2**64 - 1, 0], [3, 9, 2**40] * 1000])
def test_block_round_trip(values):
    values = np.array(values, np.uint64)
    packed = b"xx" + token_files.pack(values)
    assert (token_files.unpack(packed, 2) == values).all()


def test_outliers_do_not_widen_a_block():
    small = np.arange(4096, dtype=np.uint64) % 16
    wide = small.copy()
    wide[::200] = 2**50
    assert len(token_files.pack(wide)) < len(token_files.pack(small)) + 21 * 10 + 1


def test_shard_reads_single_documents():
    rng = np.random.default_rng(1)
    counts = [1, 5000, 1, 9000, 3]
    ids = rng.integers(0, 49408, sum(counts)).astype("<u4")
    shard = token_files.Shard(token_files.shard_bytes([None, -5, 2, 2, 10**12], counts, ids))
    assert shard.doc_ids[1:].tolist() == [-5, 2, 2, 10**12] and shard.nulls == 1
    assert (shard.ids(5001, 5002) == ids[5001:5002]).all() and (shard.ids(0, len(ids)) == ids).all()
    with pytest.raises(ValueError):
        token_files.Shard(b"x" * 200)


def expected(rows):
    tokenizer, out, start = Tokenizer.from_file(PATH), [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        out.append((doc_id, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return out


def test_edges(spark, tmp_path):
    rows = [(3, None), (1, ""), (None, "Null id"), (2, "It's DON'T naïve É. x<|endoftext|> y_z 12a b  \t c\x1cd"), (2, "It's DON'T"), (5, "long " * 9000),
            (5, "long " * 9000), (9, "İstanbul ǅ café. ́x straße*** a.b,c!! «quote» 日本。")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS start", "2 AS ids").repartition(3)
    manifest = token_files.write(df, str(tmp_path / "a"), PATH, shard_ids=1000)
    got = token_files.read(manifest, str(tmp_path / "a")).selectExpr("doc_id", "start", "octet_length(ids) div 4", "crc32(ids)").collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == expected(rows)
    assert manifest.count() >= 3
    empty = token_files.write(df.limit(0), str(tmp_path / "b"), PATH)
    assert empty.count() == 0 and token_files.read(empty, str(tmp_path / "b")).count() == 0


LIBRARY = Tokenizer.from_file(PATH)
with open(PATH, encoding="utf-8") as handle:
    DEFINITION = handle.read()


def ids_of(packed):
    return np.frombuffer(packed, "<u4").tolist()


def test_random_texts_with_marks():
    """Letters that compose, decompose or lower-case into marks, before and after marks."""
    rng = random.Random(11)
    alphabet = "abZİıßẞÅǅé́̇क़निΣςѮѯ0²Ⅷ½!.,'-_()<>|«»日本🙂\u0870\uA7C0\u0344\u0149 \n\t\x1c\u00a0"
    words = token_files.Words(DEFINITION)
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 12))) for _ in range(40_000)] + ["İ)", "İ*** x", "\u0958!!", "<|endoftext|>", "a<|b|>c <|startoftext|>!"]
    for got, text in zip(map(words.encode, texts), texts):
        assert ids_of(got) == LIBRARY.encode(text, add_special_tokens=False).ids, ascii(text)


def test_tables_are_bounded_and_long_texts_are_cut_at_spaces(monkeypatch):
    monkeypatch.setattr(token_files, "MOST_WORDS", 60)
    monkeypatch.setattr(token_files, "GROUP", 100)
    rng = random.Random(12)
    words = token_files.Words(DEFINITION)
    texts = [" ".join("".join(rng.choice("abcé.,") for _ in range(rng.randint(1, 60))) for _ in range(rng.randint(0, 80))) for _ in range(60)]
    for got, text in zip(map(words.encode, texts), texts):
        assert ids_of(got) == LIBRARY.encode(text, add_special_tokens=False).ids


def test_other_vocabularies_are_encoded_whole():
    d = json.loads(DEFINITION)
    assert token_files.by_words(DEFINITION)
    d["normalizer"] = {"type": "Sequence", "normalizers": [{"type": "Replace", "pattern": {"String": " "}, "content": "_"}]}
    other = json.dumps(d)
    assert not token_files.by_words(other)
    texts = ["a b  c", "It's \n x", "", "İ) y"]
    got = map(token_files.Words(other).encode, texts)
    assert [ids_of(g) for g in got] == [Tokenizer.from_str(other).encode(t, add_special_tokens=False).ids for t in texts]


def test_query(spark):
    rows = duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()
    got = queries.QUERIES["op6_token_files"](spark, "/root/testdata/sf0.01").collect()
    assert sorted(map(tuple, got)) == expected(rows)


def test_frequent_words_stay_in_one_small_table(monkeypatch):
    words = token_files.Words(DEFINITION)
    tables = [t for t in (words, *vars(words).values()) if isinstance(t, dict) and t is not words.signs]
    assert len(tables) * token_files.MOST_WORDS <= 600_000  # entries that a Python worker holds
    monkeypatch.setattr(token_files, "MOST_WORDS", 60)
    rare = ["".join("abcdefghij"[int(d)] for d in str(i)) for i in range(100, 700)]
    text, met, model = " ".join(f"{w} {w}! the" for w in rare), [], words.model

    class Counted:
        def tokenize(self, signs):
            met.append(signs)
            return model.tokenize(signs)

    words.model = Counted()
    assert ids_of(words.encode(text)) == LIBRARY.encode(text, add_special_tokens=False).ids
    assert met.count("the") == 1 and len(met) == len(set(met)) == len(rare) + 2
    assert len(words) + len(words.elder) <= 120
