"""Snapshot, languages, tree, metrics: one narrow pass per file, one partial aggregate per repo."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import params, rules
from ..functions import grades, paths, text
from ..functions.regex import let
from ..plans.corpus import inventory, readable, too_large, walk_order
from ..plans.topn import top_n

CATEGORIES = {
    "manifests": paths.is_manifest, "lockfiles": paths.is_lockfile, "ci": paths.is_ci, "tests": paths.is_test,
    "infrastructure": paths.is_infrastructure, "sensitive": paths.is_sensitive_path,
}


def path_flags(files: DataFrame) -> DataFrame:
    """Every path rule as a column; reads no content."""
    p = F.col("path")
    return files.select(
        "repo", "path", paths.base_name(p).alias("name"), paths.suffix(p).alias("suffix"),
        paths.not_ignored(p).alias("not_ignored"), *[rule(p).alias(f"is_{name}") for name, rule in CATEGORIES.items()],
        paths.is_sensitive_file(p).alias("is_sensitive_file"), paths.is_write_sensitive(p).alias("is_write_sensitive"),
        paths.is_protected(p).alias("is_protected"), paths.entropy_skipped(p).alias("entropy_skipped"))


def sample(files: DataFrame, max_files: int) -> DataFrame:
    """The first files of each repo in walk order, with their rank."""
    params.max_files(max_files)
    seen = inventory(files.select("repo", "path"))
    return top_n(seen, ["repo"], walk_order(), max_files, ["path"]).select("repo", "path", "pos")


def listing_counters(listing: DataFrame) -> DataFrame:
    """Per repo: links skipped and directories that could not be read."""
    return listing.groupBy("repo").agg(
        F.count_if(F.col("entry_type") == "symlink").alias("skipped_symlinks"),
        F.count_if(F.col("entry_type") == "unreadable_dir").alias("inaccessible_directories"),
        F.count_if((F.col("entry_type") == "file") & ~F.is_valid_utf8("path")).alias("non_utf8_paths"))


def sanitize_paths(files: DataFrame) -> DataFrame:
    """Broken bytes in a path become U+FFFD; ``was_non_utf8`` keeps the count possible."""
    return (files.withColumn("was_non_utf8", ~F.is_valid_utf8("path"))
            .withColumn("path", F.make_valid_utf8("path")))


def snapshot_members(files: DataFrame, max_files: int | None = None, caps: dict[str, int] | None = None) -> DataFrame:
    """repo, category, path in long form. ``caps`` may bound single categories, in walk order."""
    caps = caps or {}
    p = F.col("path")
    seen = inventory(files.select("repo", "path"), max_files)
    found = F.array_compact(F.array(*[F.when(rule(p), F.lit(name)) for name, rule in CATEGORIES.items()]))
    rows = seen.select("repo", "path", "walk_key", F.explode(found).alias("category"))
    if not caps:
        return rows.select("repo", "category", "path")
    capped = F.col("category").isin(list(caps))
    cap_of = F.lit(0)
    for name, cap in caps.items():
        cap_of = F.when(F.col("category") == name, F.lit(cap)).otherwise(cap_of)
    firsts = top_n(rows.filter(capped), ["repo", "category"], walk_order(), max(caps.values()), ["path"])
    kept = firsts.filter(F.col("pos") <= cap_of).drop("pos")
    return rows.filter(~capped).unionByName(kept).select("repo", "category", "path")


def snapshot_counts(files: DataFrame, max_files: int | None = None) -> DataFrame:
    """Per repo: files, files per category and the limit flag."""
    p = F.col("path")
    seen = inventory(files.select("repo", "path"), max_files)

    out = seen.groupBy("repo").agg(
        F.count("*").alias("file_count"), F.count_if(p.contains("�")).alias("non_utf8_paths"),
        *[F.count_if(rule(p)).alias(f"{name}_count") for name, rule in CATEGORIES.items()])
    reached = F.lit(False) if max_files is None else F.col("file_count") >= max_files
    return out.withColumn("sample_limit_reached", reached)


def repo_snapshot(files: DataFrame, max_files: int = 250, listing: DataFrame | None = None,
                  caps: dict[str, int] | None = None) -> DataFrame:
    """One row per repo with the category lists. The lists are arrays, so a sample size is
    required and bounds them; ``snapshot_members`` serves the whole corpus."""
    params.int_in(max_files, 1, params.NO_LIMIT, "max_files", optional=False)
    caps = caps or {}
    p = F.col("path")
    seen = inventory(files.select("repo", "path"), max_files)
    place = F.struct("walk_key", "path")

    def members(name, rule):
        rows = F.array_sort(F.collect_list(F.when(rule(p), place)))
        names = F.transform(rows, lambda r: r["path"])
        return (F.slice(names, 1, caps[name]) if name in caps else names).alias(name)

    out = seen.groupBy("repo").agg(F.count("*").alias("file_count"), F.count_if(p.contains("�")).alias("non_utf8_paths"),
                                   *[members(n, r) for n, r in CATEGORIES.items()])
    out = out.withColumn("sample_limit", F.lit(max_files)).withColumn("sample_limit_reached", F.col("file_count") >= max_files)
    if listing is not None:
        out = out.join(listing_counters(listing).drop("non_utf8_paths"), "repo", "left")
    return out


# --- languages --------------------------------------------------------------------------

def language_table(spark) -> DataFrame:
    """The fixed extension table (64 rows)."""
    rows = ", ".join(f"('{s}', '{lang}')" for s, lang in rules.LANGUAGES.items())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(suffix, language_by_suffix)")


def with_language(files: DataFrame) -> DataFrame:
    dim = F.broadcast(language_table(files.sparkSession))  # a constant of 64 rows
    p = F.col("path")
    return (files.withColumn("suffix", paths.suffix(p)).join(dim, "suffix", "left")
            .withColumn("language", F.coalesce("language_by_suffix", paths.named_language(p), F.lit("Other")))
            .drop("suffix", "language_by_suffix"))


def language_stats(files: DataFrame, max_files: int | None = None, max_file_bytes: int | None = None) -> DataFrame:
    """Per repo and language: files, lines, shares and rank (most lines, then files, then first seen)."""
    params.file_bytes(max_file_bytes)
    counted = (F.col("language") != "Other") & readable(max_file_bytes)
    body = F.make_valid_utf8(F.col("content").cast("string"))
    # a number per file goes into the aggregate, so that no sort ever carries contents
    per_file = (with_language(inventory(files, max_files)).withColumn("counted", counted)
                .withColumn("n_lines", F.when(F.col("counted"), text.line_count(body))).drop("content"))
    stats = per_file.groupBy("repo", "language").agg(
        F.count("*").alias("files"),
        F.coalesce(F.sum("n_lines"), F.lit(0)).alias("lines"),
        F.count_if("counted").alias("counted_files"), F.min(F.struct("walk_key", "path")).alias("seen_at"))
    repo = Window.partitionBy("repo")  # at most one row per known language
    ranked = repo.orderBy(F.desc("lines"), F.desc("files"), "seen_at")
    return (stats.withColumn("rank", F.row_number().over(ranked))
            .withColumn("files_pct", text.percent(F.col("files"), F.sum("files").over(repo)))
            .withColumn("lines_pct", text.percent(F.col("lines"), F.sum("lines").over(repo)))
            .drop("seen_at"))


def language_summary(stats: DataFrame) -> DataFrame:
    """Per repo: totals and the primary language, the best-ranked one that is not Other."""
    named = F.when(F.col("language") != "Other", F.col("rank"))
    return stats.groupBy("repo").agg(
        F.sum("files").alias("total_files"), F.sum("lines").alias("total_lines"),
        F.sum("counted_files").alias("line_counted_files"), F.min_by("language", named).alias("primary_language"))


# --- tree -------------------------------------------------------------------------------

def directory_tree(files: DataFrame, max_depth: int | None = None, max_entries: int | None = None, include_files: bool = True,
                   include_dirs: bool = True, listing: DataFrame | None = None) -> DataFrame:
    """repo, path, type, depth. Directories come from the file paths (distinct prefixes, merged
    before the shuffle); a listing adds empty ones. Without limits the tree is whole; capped output is in
    breadth-first order, and ``tree_limits`` tells what a limit left out."""
    params.int_in(max_depth, 1, params.NO_LIMIT, "max_depth")
    params.int_in(max_entries, 1, params.NO_LIMIT, "max_entries")
    seen = files.select("repo", "path").filter(paths.not_ignored(F.col("path")))
    level = paths.depth(F.col("path"))
    deepest = F.lit(2**31 - 2 if max_depth is None else min(max_depth, 2**31 - 2))
    parts = []
    if include_files:
        parts.append(seen.filter(level <= deepest).select("repo", "path", F.lit("file").alias("type")))
    if include_dirs:
        steps = F.least(level, deepest + 1)
        prefixes = F.when(level > 0, F.transform(
            F.sequence(F.lit(1), steps), lambda i: F.array_join(F.slice(F.split("path", "/"), 1, i), "/")))
        dirs = seen.select("repo", F.explode(prefixes).alias("path"))
        if listing is not None:
            named = listing.filter((F.col("entry_type") == "dir") & paths.not_ignored(F.col("path")) & (level <= deepest))
            dirs = dirs.unionByName(named.select("repo", "path"))
        parts.append(dirs.distinct().select("repo", "path", F.lit("directory").alias("type")))
    if not parts:
        return seen.limit(0).select("repo", "path", F.lit("file").alias("type"), level.alias("depth"))
    tree = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    tree = tree.withColumn("depth", level)
    if max_entries is None:
        return tree
    tree = tree.withColumn("_key", paths.breadth_key(F.col("path")))
    return top_n(tree, ["repo"], [F.col("depth"), F.col("_key"), F.col("path")], max_entries, ["path"]).drop("_key")


def tree_limits(files: DataFrame, max_depth: int | None = None, max_entries: int | None = None) -> DataFrame:
    """Per repo: entries of the whole tree, those below ``max_depth``, and whether ``max_entries`` cuts the rest."""
    whole = directory_tree(files)
    deep = F.lit(False) if max_depth is None else F.col("depth") > max_depth + F.when(F.col("type") == "directory", 1).otherwise(0)
    out = whole.groupBy("repo").agg(F.count("*").alias("entries"), F.count_if(deep).alias("depth_limited_count"))
    left = F.col("entries") - F.col("depth_limited_count")
    return out.withColumn("entry_limit_reached", F.lit(False) if max_entries is None else left > max_entries)


# --- metrics ----------------------------------------------------------------------------

def file_metrics(files: DataFrame, max_files: int | None = None, max_file_bytes: int | None = None,
                 large_bytes: int = rules.SEARCH_FILE_BYTES) -> DataFrame:
    """Per file: state (scanned, empty, large, binary), markers, long lines and branch words. Files above ``large_bytes`` count as
    large and are scanned all the same; above a given ``max_file_bytes`` they are not, and their state says so."""
    params.file_bytes(max_file_bytes)
    size = F.col("size_bytes")
    state = (F.when(size == 0, "empty").when(too_large(max_file_bytes), "large")
             .when(text.is_binary(F.col("content")), "binary").otherwise("scanned"))
    body = F.col("body")

    def measures(all_lines):
        return let(text.todo_kinds(body, all_lines), lambda kinds: F.struct(
            F.size(all_lines).alias("lines"),
            F.size(kinds).alias("marker_lines"),
            F.size(F.filter(kinds, lambda k: k == "TODO")).alias("todo"),
            F.size(F.filter(kinds, lambda k: k.isin("FIXME", "BUG"))).alias("fixme"),
            F.size(F.filter(all_lines, lambda line: F.length(line) > rules.LONG_LINE)).alias("long_lines")))

    return (inventory(files, max_files).withColumn("state", state)
            .withColumn("body", F.when(F.col("state") == "scanned", text.text_of(F.col("content"))))
            .withColumn("m", F.when(body.isNotNull(), let(text.lines(body), measures)))
            .withColumn("branches", text.branch_count(body))
            .select("repo", "path", "walk_key", "size_bytes", "state", (too_large(max_file_bytes) | (size > large_bytes)).alias("large"), "m.*", "branches")
            .withColumn("dense", (F.col("branches") > 30) & (F.col("lines") < 200)))


def code_metrics(per_file: DataFrame) -> DataFrame:
    """Per repo: counts, health score and grade."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    out = per_file.groupBy("repo").agg(
        F.count("*").alias("file_count"), F.count_if(F.col("state") == "scanned").alias("files_scanned"),
        total("todo").alias("todo_count"), total("fixme").alias("fixme_count"),
        F.count_if("large").alias("large_files"), total("long_lines").alias("long_lines"),
        F.count_if(F.col("state") == "empty").alias("empty_files"),
        F.count_if(F.col("state") == "binary").alias("binary_skipped"), F.count_if("dense").alias("dense_files"))
    score = grades.health_score(*[F.col(c) for c in
                                  ("todo_count", "fixme_count", "large_files", "long_lines", "dense_files")])
    return out.withColumn("health_score", score).withColumn("grade", grades.health_grade(F.col("health_score")))


def top_todo_files(per_file: DataFrame, n: int = 20) -> DataFrame:
    """Per repo, the files with most marker lines; ties in walk order."""
    marked = per_file.filter(F.col("marker_lines") > 0).select("repo", "path", "walk_key", "marker_lines")
    top = top_n(marked, ["repo"], [F.desc("marker_lines"), *walk_order()], n, ["path"])
    return top.select("repo", F.col("path").alias("file"), F.col("marker_lines").alias("count"), "pos")


def large_files(per_file: DataFrame) -> DataFrame:
    return per_file.filter("large").select("repo", F.col("path").alias("file"), F.col("size_bytes").alias("bytes"))


def complexity_hints(per_file: DataFrame) -> DataFrame:
    return per_file.filter("dense").select("repo", F.col("path").alias("file"), "branches", "lines")
