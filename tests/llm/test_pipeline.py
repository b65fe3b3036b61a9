import hashlib
import re

import duckdb
import public_tokenizers
import tiktoken

import corpus_pipeline
from codequarry.llm import bpe, mixing, queries

from test_mixing import brute_targets
from test_ngram_join import brute as brute_groups
from test_pii import base

DATA = "/root/testdata/sf0.01"


def test_stages_on_driver_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    rows = {r.doc_id: r for r in docs.collect()}
    predicted = {r.doc_id: r.predicted for r in queries.QUERIES["op10_quality"](spark, DATA).collect()}

    good = corpus_pipeline.stored(stages["quality"](spark, docs, DATA))
    assert good.columns == docs.columns
    kept = {r.doc_id for r in good.collect()}
    assert kept == {i for i in rows if predicted[i] == 1}
    bad = {i for i, q in duckdb.sql(f"SELECT doc_id, quality FROM '{DATA}/labels.parquet'").fetchall() if q == 0}
    labelled = {i for i, q in duckdb.sql(f"SELECT doc_id, quality FROM '{DATA}/labels.parquet'").fetchall() if q == 1}
    assert len(labelled & kept) > 0.97 * len(labelled) and len(bad & kept) < 0.3 * len(bad)

    single = corpus_pipeline.stored(stages["near_duplicates"](spark, good, DATA))
    assert single.columns == docs.columns
    leaders = {r[2] for r in brute_groups([(i, rows[i].text) for i in kept])}
    assert sorted(r.doc_id for r in single.collect()) == sorted(leaders)

    clean = corpus_pipeline.stored(stages["personal_data"](spark, single, DATA))
    assert clean.columns == docs.columns
    for r in clean.collect():
        found = base(rows[r.doc_id].text)
        assert r.n_chars == len(r.text)
        if not found:
            assert r.text == rows[r.doc_id].text
        else:
            assert not base(r.text) and all(re.search(f"<{k}>", r.text) for k in {found[0][0]})

    mixed = corpus_pipeline.stored(stages["mixing"](spark, clean, DATA))
    assert mixed.columns == docs.columns
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, taken = {}, {}
    for r in clean.collect():
        sizes[r.source] = sizes.get(r.source, 0) + words(r.text)
    for r in mixed.collect():
        taken[r.source] = taken.get(r.source, 0) + words(r.text)
    for source, want in brute_targets(sizes).items():
        assert abs(want - taken.get(source, 0)) < 0.25 * float(want) + 400

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(open(public_tokenizers.path(corpus_pipeline.VOCABULARY), "rb").read()), special_tokens={})
    want = []
    for r in mixed.collect():
        ids = library.encode_ordinary(r.text)
        want.append((r.doc_id, len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), True))
    assert sorted(map(tuple, stages["tokens"](spark, mixed, DATA).collect())) == sorted(want)
    assert mixing.MOST == 2


def test_odd_rows(spark, tmp_path):
    long = "the quiet river runs past old stone houses and green fields today " * 3
    rows = [(1, long, "en", "a", 5), (1, long, "en", "a", 5), (1, "another text under the same id here", "en", None, 1), (2, None, None, None, None), (3, "", "en", "b", 0),
            (None, long, "en", "a", 1), (None, "null id and words of its own", "en", "c", 1), (4, "write to ann@example.org now please", "en", "a", 9)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame(rows, schema).withColumn("tag", corpus_pipeline.F.lit(1)).withColumn("size", corpus_pipeline.F.lit("x")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    single = corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.text) for r in single if r.text) == sorted(
        [("1", long), ("1", rows[2][1]), ("None", rows[6][1]), ("4", rows[7][1])]) and sum(not r.text for r in single) == 2
    assert corpus_pipeline.run(spark, str(tmp_path)).filter("NOT round_trip").count() == 0
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
