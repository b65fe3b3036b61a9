"""Three-way merge of whole repositories: base, main and shadow tables of (repo, path, content).

Comparisons shuffle digests, not contents; contents move only for the paths that change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text

KEY = ["repo", "path"]


def _digests(files: DataFrame, name: str) -> DataFrame:
    return files.select(*KEY, text.sha256(F.col("content")).alias(name))


def changed_paths(base: DataFrame, shadow: DataFrame) -> DataFrame:
    """repo, path, change: M, A or D of the shadow against the base."""
    both = _digests(base, "b").join(_digests(shadow, "s"), KEY, "full_outer")
    change = F.when(F.col("b").isNull(), "A").when(F.col("s").isNull(), "D").when(F.col("b") != F.col("s"), "M")
    return both.select(*KEY, change.alias("change"), F.col("b"), F.col("s")).filter(F.col("change").isNotNull())


def three_way(base: DataFrame, main: DataFrame, shadow: DataFrame) -> DataFrame:
    """repo, path, change, conflict, in_main for each changed path. A conflict is a file that both
    sides changed, even to the same text; a file the shadow deleted never conflicts. A missing
    file counts as empty text."""
    changed = changed_paths(base, shadow)
    m = _digests(main, "m").withColumn("in_main", F.lit(True))
    empty = F.sha2(F.lit("").cast("binary"), 256)
    joined = changed.join(m, KEY, "left")
    b, mm, s = F.coalesce("b", empty), F.coalesce("m", empty), F.col("s")
    return joined.select(*KEY, "change", ((F.col("change") != "D") & (mm != b) & (s != b)).alias("conflict"),
                         F.coalesce("in_main", F.lit(False)).alias("in_main"))


def merge_summary(changes: DataFrame) -> DataFrame:
    """Per repo: conflicts and clean files (deletions are neither)."""
    live = F.col("change") != "D"
    return changes.groupBy("repo").agg(
        F.count("*").alias("changed_count"), F.count_if("conflict").alias("conflict_count"),
        F.count_if(live & ~F.col("conflict")).alias("clean_count"), F.max("conflict").alias("has_conflicts"))


def promote_plan(changes: DataFrame, force: bool = False) -> DataFrame:
    """Adds ``action`` (copied, deleted, none or held) and the repo's promote status. One conflict
    holds the whole repo back unless forced; forcing still reports it."""
    verdict = changes.groupBy("repo").agg(F.max("conflict").alias("has_conflicts"))
    held = F.lit(False) if force else F.col("has_conflicts")
    action = (F.when(held, "held").when(F.col("change") != "D", "copied").when(F.col("in_main"), "deleted").otherwise("none"))
    return changes.join(verdict, "repo").select(
        *KEY, "change", "conflict", action.alias("action"),
        F.when(F.col("has_conflicts"), "conflicts-detected").otherwise("promoted").alias("status"))


def promote(main: DataFrame, shadow: DataFrame, plan: DataFrame) -> DataFrame:
    """Main after the promotion."""
    acted = plan.filter(F.col("action").isin("copied", "deleted"))
    kept = main.select(*KEY, "content").join(acted.select(*KEY), KEY, "left_anti")
    copied = shadow.select(*KEY, "content").join(acted.filter(F.col("action") == "copied").select(*KEY), KEY, "left_semi")
    return kept.unionByName(copied)


def only_in(left: DataFrame, right: DataFrame) -> DataFrame:
    """Paths of one snapshot that the other lacks."""
    return left.select(*KEY).join(right.select(*KEY), KEY, "left_anti")
