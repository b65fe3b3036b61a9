"""Starting points shared by the scanning operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import params
from ..functions import paths, text
from .topn import top_n


def inventory(files: DataFrame, max_files: int | None = None) -> DataFrame:
    """Files no ignored name hides, with their walk key; with a number, only the first files of
    each repo in walk order."""
    params.max_files(max_files)
    seen = files.filter(paths.not_ignored(F.col("path"))).withColumn("walk_key", paths.walk_key(F.col("path")))
    if max_files is None:
        return seen
    if "content" not in files.columns:
        return _first(seen, max_files)
    # rank the narrow keys only; the contents of the chosen files come back by a join
    chosen = _first(seen.select("repo", "path", "walk_key"), max_files).select("repo", "path")
    return seen.join(chosen, ["repo", "path"], "left_semi")


def _first(seen: DataFrame, n: int) -> DataFrame:
    return top_n(seen, ["repo"], walk_order(), n, ["path"], rank="_pos").drop("_pos")


def walk_order() -> list[Column]:
    return [F.col("walk_key"), F.col("path")]


def walk_position() -> Column:
    return F.struct("walk_key", "path")


def readable(max_file_bytes: int | None = None) -> Column:
    """Present, not larger than a given limit and not binary. The size test comes first, as the scan can use it."""
    ok = F.col("content").isNotNull() & ~text.is_binary(F.col("content"))
    return ok if max_file_bytes is None else (F.col("size_bytes") <= max_file_bytes) & ok


def too_large(max_file_bytes: int | None = None) -> Column:
    return F.lit(False) if max_file_bytes is None else F.col("size_bytes") > max_file_bytes


def exploded(df: DataFrame, keep: list[str], items: Column) -> DataFrame:
    """One row per array element, as ``item``. The outer form keeps Spark from adding a size filter
    that would compute the array a second time."""
    return df.select(*keep, F.explode_outer(items).alias("item")).filter(F.col("item").isNotNull())
