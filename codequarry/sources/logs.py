"""Line logs: audit and session logs (JSON Lines), commit and change logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import params
from ..functions import audit as fa
from ..functions import text
from . import lines

def _named(lines_df: DataFrame, repo_pattern: str) -> DataFrame:
    return lines_df.select(F.regexp_extract("file", repo_pattern, 1).alias("repo"), "file", "pos", "next", "raw")


def read_lines(spark: SparkSession, path, repo_pattern: str, split_bytes: int = 64 << 20) -> DataFrame:
    """repo, file, pos, next, raw: the lines of text files. ``pos`` is the byte at which a line starts and ``next`` the one after its
    end, whatever the splits. ``repo_pattern`` takes the repo from the file path (group 1)."""
    return _named(lines.read(spark, path, split_bytes), repo_pattern)


def stream_lines(spark: SparkSession, path, repo_pattern: str, split_bytes: int = 64 << 20) -> DataFrame:
    """The same as a stream of what is added to the files; a last line waits for its end."""
    return _named(lines.stream(spark, path, split_bytes), repo_pattern)


def audit_log(spark: SparkSession, path, repo_pattern: str, split_bytes: int = 64 << 20) -> DataFrame:
    """log(repo, pos, raw) for the audit operators; nothing is dropped here, so corrupt lines count."""
    return read_lines(spark, path, repo_pattern, split_bytes).select("repo", "pos", "raw")


def session_records(lines: DataFrame) -> DataFrame:
    """sessions(repo, session_id, pos, status, created_at); lines that do not parse are dropped."""
    v = F.col("v")
    parsed = lines.filter(F.trim("raw") != "").select("repo", "pos", F.try_parse_json("raw").alias("v")).filter(v.isNotNull())
    return parsed.select("repo", fa.string_field(v, "sessionId").alias("session_id"), "pos",
                         fa.string_field(v, "status").alias("status"), fa.string_field(v, "createdAtUtc").alias("created_at")
                         ).filter("session_id IS NOT NULL")


def commit_records(lines: DataFrame, subject_chars: int | None = None) -> DataFrame:
    """commits(repo, hash, author, email, ts, subject) from fields parted by U+001F; lines with fewer
    than five fields are dropped. ``subject_chars`` cuts subjects; None leaves them whole."""
    params.int_in(subject_chars, 1, params.NO_LIMIT, "subject_chars")
    f = F.split("raw", "\u001f")
    return lines.withColumn("f", f).filter(F.size("f") >= 5).select(
        "repo", F.col("f")[0].alias("hash"), F.col("f")[1].alias("author"), F.col("f")[2].alias("email"),
        F.try_to_timestamp(F.col("f")[3]).alias("ts"), (F.col("f")[4] if subject_chars is None else F.left(F.col("f")[4], F.lit(subject_chars))).alias("subject"))


def change_records(lines: DataFrame) -> DataFrame:
    """changes(repo, pos, file): one row per changed file name, blank lines dropped."""
    name = text.strip(F.col("raw"))
    return lines.filter(name != "").select("repo", "pos", name.alias("file"))
