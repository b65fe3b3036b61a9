"""The corpus pipeline: quality, near duplicates, personal data, mixing, tokens.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a DataFrame; the rows are written as Parquet
in the shared folder and read again as the next stage's docs. All but the last return the columns of ``documents``. Null and empty
texts, repeated rows and null keys go through as each stage's docstring says; an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.llm import bpe, mixing, ngram_join, pii, quality
from codequarry.llm.common import prepared, stored

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents whose score is below 0.5 go, null and empty texts by the score that those have."""
    return quality.keep_good(prepared(spark), docs, sf_dir)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: of each group of linked documents the row with the smallest doc_id stays, of equal rows one. Texts without words link
    with nothing and stay."""
    return ngram_join.keep_one(docs)


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: matches are replaced by their kind, disclosing words removed; n_chars follows the text. Every row stays."""
    return pii.sanitise(docs).withColumn("n_chars", F.length("text").cast("bigint")).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: each document is there as often as the mix takes it, zero to two times. Texts without words, which weigh nothing, stay
    once."""
    return mixing.resample(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: doc_id, n_tokens, ids_sha256 and round_trip, whether decoding the ids gives the text back."""
    path = public_tokenizers.path(VOCABULARY)
    both = bpe.round_trip(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), path, public_tokenizers.PATTERN)
    return both.select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                       (F.col("decoded") == F.col("text")).alias("round_trip"))


STAGES = [
    ("quality", classify_quality),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", remove_personal_data),
    ("mixing", mix_sources),
    ("tokens", tokenise),
]

ORACLE_SQL = None  # the classifier, the disclosure of words and the tokens are beyond SQL; see tests/llm/test_pipeline.py


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = prepared(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
