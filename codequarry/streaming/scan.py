"""Scans of files as they arrive: the batch expressions on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import params
from ..functions import text
from ..operators import scan


def secret_findings(files: DataFrame, max_file_bytes: int | None = None) -> DataFrame:
    """Streaming files(repo, path, content, size_bytes): findings, with no state at all."""
    return scan.secret_findings(files, max_file_bytes=max_file_bytes)


def entropy_findings(files: DataFrame, entropy_threshold: float = 4.5, memory: str = "1 day",
                     max_file_bytes: int | None = None) -> DataFrame:
    """Streaming files with an ``arrived`` timestamp: each distinct token of a repo once, as long as
    it reappears within ``memory`` of its first sighting."""
    threshold = params.number_in(entropy_threshold, 2.0, 8.0, "entropy_threshold")
    found = scan.token_occurrences(files.withWatermark("arrived", memory), max_file_bytes=max_file_bytes, keep=["arrived"])
    high = found.filter(F.col("entropy_bits") >= threshold).dropDuplicatesWithinWatermark(["repo", "token_hash"])
    return high.select("repo", F.col("path").alias("file"), "line", "token_preview",
                       text.round_to(F.col("entropy_bits"), 3).alias("entropy"), "length", "token_hash")
