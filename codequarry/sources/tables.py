"""Tables already ingested."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths


def files(spark: SparkSession, path: str) -> DataFrame:
    """The files table; columns an operator does not use are never read."""
    df = spark.read.parquet(path)
    missing = {"repo", "path", "content"} - set(df.columns)
    if missing:
        raise ValueError(f"files table lacks {sorted(missing)}")
    return df if "size_bytes" in df.columns else df.withColumn("size_bytes", F.octet_length("content").cast("bigint"))


def skill_documents(files_df: DataFrame) -> DataFrame:
    """Skill, contract and plugin-manifest documents only."""
    name = paths.base_name(F.col("path"))
    return files_df.filter(name.isin("SKILL.md", "contract.json", "plugin.json"))
