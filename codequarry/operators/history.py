"""Commit summaries and churn over ``commits`` and ``commit_files``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import params
from ..plans.topn import top_n


def recent_commits(commits: DataFrame, max_commits: int = 20) -> DataFrame:
    """The newest commits of each repo with their rank."""
    params.int_in(max_commits, 1, params.NO_LIMIT, "max_commits", optional=False)
    return top_n(commits, ["repo"], [F.desc("ts"), F.col("hash")], max_commits, ["hash"])


def commit_summary(commits: DataFrame, max_commits: int | None = None) -> DataFrame:
    """Per repo: commits and distinct authors (lower-cased mail)."""
    if max_commits is not None:
        commits = recent_commits(commits, max_commits)
    return commits.groupBy("repo").agg(F.count("*").alias("commit_count"),
                                       F.count_distinct(F.lower("email")).alias("distinct_authors"))


def churn(commits: DataFrame, commit_files: DataFrame, max_commits: int | None = None, top: int = 20) -> DataFrame:
    """Per repo, the files changed most often; ties go to the file seen first, newest commit first.
    ``commit_files.pos`` is the place of the file inside its commit."""
    params.int_in(top, 1, params.NO_LIMIT, "top", optional=False)
    chosen = commits if max_commits is None else recent_commits(commits, max_commits)
    named = commit_files.filter(F.trim("file") != "").select("repo", "hash", F.trim("file").alias("file"), "pos")
    changes = named.join(chosen.select("repo", "hash", "ts"), ["repo", "hash"])
    seen_at = F.struct((-F.unix_micros(F.col("ts").cast("timestamp"))).alias("newest"), "hash", "pos")
    counts = changes.groupBy("repo", "file").agg(F.count("*").alias("changes"), F.min(seen_at).alias("seen_at"))
    best = top_n(counts, ["repo"], [F.desc("changes"), F.col("seen_at"), F.col("file")], top, ["file"])
    return best.select("repo", "file", "changes", "pos")


def churn_from_names(changes: DataFrame, top: int = 20) -> DataFrame:
    """The same ranking from a plain list of changed names (repo, pos, file), newest first."""
    params.int_in(top, 1, params.NO_LIMIT, "top", optional=False)
    counts = changes.groupBy("repo", "file").agg(F.count("*").alias("changes"), F.min("pos").alias("seen_at"))
    best = top_n(counts, ["repo"], [F.desc("changes"), F.col("seen_at"), F.col("file")], top, ["file"])
    return best.select("repo", "file", "changes", "pos")
