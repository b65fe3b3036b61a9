"""Bulk edits of a table of files: plan, apply, change log, rollback.

A plan is a DataFrame with one row per edited path and a ``reject_reason``. Returning it is the
dry run; ``apply_plan`` gives the table after the accepted rows. Contents of files that no edit
names are never shuffled by value: joins run on (repo, path) and Spark broadcasts or sorts the
edit side as its size allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import params
from ..functions import paths, text
from ..plans.topn import top_n

KEY = ["repo", "path"]


def _guard(path: Column, allow_sensitive: Column, root: str) -> Column:
    return (F.when(~paths.is_within_root(path, root), "the path leads out of the repository")
            .when(paths.is_protected(path), "version control and state folders are closed to writes")
            .when(~F.coalesce(allow_sensitive, F.lit(False)) & paths.is_write_sensitive(path),
                  "the name is one of sensitive files; allow_sensitive lets it through"))


def _one_per_path(edits: DataFrame) -> DataFrame:
    """Edits of one batch are applied together, so a path may be named once; more are rejected."""
    return edits.groupBy(*KEY).agg(F.count("*").alias("edits_of_path"), F.min(F.struct(
        *[c for c in edits.columns if c not in KEY])).alias("e")).select(*KEY, "edits_of_path", "e.*")


def _with_current(edits: DataFrame, files: DataFrame) -> DataFrame:
    """Edits beside the current content. The semi join comes first: a small batch is broadcast
    there, so the rest of the files is dropped before any shuffle."""
    named = files.select(*KEY, F.col("content").cast("binary").alias("before")).join(edits.select(*KEY), KEY, "left_semi")
    return _one_per_path(edits).join(named, KEY, "left")


def _over(size: Column, limit: int | None) -> Column:
    return F.lit(False) if limit is None else size > limit


def write_plan(edits: DataFrame, files: DataFrame, root: str, max_bytes: int | None = None) -> DataFrame:
    """edits(repo, path, mode, content, expected_sha256, allow_sensitive) against the current files. ``max_bytes`` refuses larger contents,
    files and results; None takes any size."""
    params.int_in(max_bytes, 1, params.NO_LIMIT, "max_bytes")
    c = F.col
    joined = _with_current(edits, files)
    exists, limit = c("before").isNotNull(), max_bytes
    joined = joined.withColumn("existed_before", exists).withColumn(
        "after", F.when((c("mode") == "append") & exists, F.concat(c("before").cast("string"), c("content"))).otherwise(c("content")))
    reason = F.coalesce(
        _guard(c("path"), c("allow_sensitive"), root),
        F.when(~c("mode").isin("create", "overwrite", "append"), "unknown mode; there are create, overwrite and append"),
        F.when(c("content").isNull(), "no content was given"),
        F.when(_over(F.octet_length("content"), limit), f"the content has more than {limit} bytes"),
        F.when(c("expected_sha256").isNotNull() & ~c("expected_sha256").rlike(r"^[0-9a-f]{64}\z"),
               "the expected digest is no SHA-256 in lower-case hex"),
        F.when(c("edits_of_path") > 1, "the batch names this path more than once"),
        F.when((c("mode") == "create") & exists, "nothing is created: the file is already there"),
        F.when(exists & _over(F.octet_length("before"), limit), f"the file has more than {limit} bytes"),
        F.when(exists & ~F.is_valid_utf8(c("before").cast("string")), "the file is no UTF-8 text and stays as it is"),
        F.when(exists & c("expected_sha256").isNotNull() & (text.sha256(c("before")) != c("expected_sha256")),
               "the file has changed since the expected digest was taken"),
        F.when(_over(F.octet_length("after"), limit), f"the result would have more than {limit} bytes"))
    return _finished(joined.withColumn("reject_reason", reason).withColumn("operation", F.lit("write_file"))
                     .withColumn("occurrences", F.lit(None).cast("int")))


def occurrences(body: Column, find: Column) -> Column:
    """How often ``find`` occurs, left to right without overlap."""
    return ((F.octet_length(body) - F.octet_length(F.replace(body, find, F.lit("")))) / F.octet_length(find)).cast("int")


def replace_plan(edits: DataFrame, files: DataFrame, root: str, max_bytes: int | None = None) -> DataFrame:
    """edits(repo, path, find, replace, expected_occurrences, allow_sensitive): exact replacement, refused
    unless ``find`` occurs exactly as often as stated. ``max_bytes`` as for ``write_plan``."""
    params.int_in(max_bytes, 1, params.NO_LIMIT, "max_bytes")
    c, limit = F.col, max_bytes
    joined = _with_current(edits, files).withColumn("mode", F.lit("replace"))
    body, expected = c("before").cast("string"), F.coalesce("expected_occurrences", F.lit(1))
    found = F.when(F.octet_length("find") > 0, occurrences(body, c("find")))
    joined = (joined.withColumn("existed_before", c("before").isNotNull()).withColumn("occurrences", found)
              .withColumn("after", F.replace(body, c("find"), F.coalesce("replace", F.lit("")))))
    reason = F.coalesce(
        _guard(c("path"), c("allow_sensitive"), root),
        F.when(F.coalesce(F.octet_length("find"), F.lit(0)) == 0, "there is nothing to find"),
        F.when(_over(F.octet_length("find"), limit), f"what to find has more than {limit} bytes"),
        F.when(~expected.between(1, 10_000), "the expected number must lie between 1 and 10,000"),
        F.when(c("edits_of_path") > 1, "the batch names this path more than once"),
        F.when(c("before").isNull(), "there is no such file"),
        F.when(_over(F.octet_length("before"), limit) | ~F.is_valid_utf8(body), "the file is too large or no UTF-8 text"),
        F.when(c("occurrences") != expected, F.concat(
            F.lit("occurs "), c("occurrences").cast("string"), F.lit(" times, not "), expected.cast("string"))),
        F.when(_over(F.octet_length("after"), limit), f"the result would have more than {limit} bytes"))
    return _finished(joined.withColumn("reject_reason", reason).withColumn("operation", F.lit("replace_in_file")))


def _finished(plan: DataFrame) -> DataFrame:
    ok, c = F.col("reject_reason").isNull(), F.col
    return plan.select(
        *KEY, "operation", "mode", "existed_before", "occurrences", "reject_reason",
        F.when(ok, "planned").otherwise("rejected").alias("status"),
        text.sha256(c("before")).alias("sha256_before"), F.octet_length("before").alias("bytes_before"),
        F.when(ok, text.sha256(c("after"))).alias("sha256_after"), F.when(ok, F.octet_length("after")).alias("bytes_after"),
        c("before").cast("string").alias("before"), F.when(ok, c("after")).alias("after"))


def apply_plan(files: DataFrame, plan: DataFrame) -> DataFrame:
    """The files after every accepted row of the plan."""
    accepted = plan.filter(F.col("reject_reason").isNull()).select(*KEY, "after")
    untouched = files.select(*KEY, "content").join(accepted.select(*KEY), KEY, "left_anti")
    written = accepted.withColumnRenamed("after", "content")
    if dict(files.dtypes)["content"] == "binary":
        written = written.withColumn("content", F.col("content").cast("binary"))
    return untouched.unionByName(written).withColumn("size_bytes", F.octet_length("content").cast("bigint"))


# --- change log -------------------------------------------------------------------------

def change_id(created_at: Column, *parts: Column, digits: int = 32) -> Column:
    """UTC stamp and a digest. The digest comes from the batch and the path, so a retried task
    writes the same id; 32 digits keep ids apart in batches of any size."""
    digest = F.left(F.sha2(F.concat_ws("\u0001", *parts), 256), F.lit(digits))
    return F.concat(F.date_format(created_at, "yyyyMMdd'T'HHmmss'Z'"), F.lit("-"), digest)


def change_log(plan: DataFrame, batch: str, created_at: Column, digits: int = 32) -> tuple[DataFrame, DataFrame]:
    """(ops, backups) rows of the accepted edits, one change set per edit."""
    params.int_in(digits, 8, 47, "digits", optional=False)
    accepted = plan.filter(F.col("reject_reason").isNull()).withColumn(
        "change_id", change_id(created_at, F.lit(batch), F.col("repo"), F.col("path"), digits=digits))
    ops = accepted.select(
        "repo", "change_id", created_at.alias("created_at"), F.lit(0).alias("op_idx"), "operation", "path", "existed_before",
        "sha256_before", "bytes_before", "sha256_after", "bytes_after",
        F.when(F.col("existed_before"), F.concat(F.lit("backups/"), "change_id", F.lit("/"), "path")).alias("backup_file"))
    backups = accepted.filter("existed_before").select("repo", "change_id", "path", F.col("before").alias("content"))
    return ops, backups


def audit_records(plan: DataFrame, batch: str, created_at: Column, digits: int = 32) -> DataFrame:
    """records(repo, ord, timestamp_utc, record) of the accepted edits, ready for ``audit.append``."""
    c = F.col
    accepted = plan.filter(c("reject_reason").isNull()).withColumn(
        "change_id", change_id(created_at, F.lit(batch), c("repo"), c("path"), digits=digits))
    head = [c("change_id").alias("changeId"), "operation", "path"]
    sums = [c("sha256_before").alias("sha256Before"), c("sha256_after").alias("sha256After")]
    sizes = [c("bytes_before").alias("bytesBefore"), c("bytes_after").alias("bytesAfter")]
    shape = {"ignoreNullFields": "false"}
    record = F.when(c("operation") == "replace_in_file", F.to_json(F.struct(*head, "occurrences", *sums), shape)).otherwise(
        F.to_json(F.struct(*head, "mode", *sums, *sizes), shape))
    return accepted.select("repo", c("path").alias("ord"), _stamp(created_at).alias("timestamp_utc"), record.alias("record"))


def rollback_records(plan: DataFrame, at: Column) -> DataFrame:
    """Audit records of an applied rollback. One record per path, so that none grows with the
    change set it undoes."""
    done = plan.filter(F.col("reject_reason").isNull())
    item = F.struct("path", F.col("applied").alias("action"), F.when(F.col("applied") == "restored", F.col("sha256_before")).alias("sha256"))
    record = F.to_json(F.struct(F.col("change_id").alias("changeId"), F.lit("rollback").alias("operation"),
                                F.lit(None).cast("string").alias("path"), F.array(item).alias("applied")), {"ignoreNullFields": "false"})
    return done.select("repo", F.col("path").alias("ord"), _stamp(at).alias("timestamp_utc"), record.alias("record"))


def _stamp(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def newest_changes(ops: DataFrame, n: int = 100) -> DataFrame:
    """Per repo, the newest change sets by id, with their operation count."""
    params.int_in(n, 1, params.NO_LIMIT, "n", optional=False)
    sets = ops.groupBy("repo", "change_id").agg(F.min("created_at").alias("created_at"), F.count("*").alias("operation_count"))
    return top_n(sets, ["repo"], [F.desc("change_id")], n, ["change_id"])


def change_paths(ops: DataFrame, changes: DataFrame) -> DataFrame:
    """The operations behind the listed change sets, in long form."""
    return ops.join(changes.select("repo", "change_id"), ["repo", "change_id"], "left_semi").select(
        "repo", "change_id", "op_idx", "path")


# --- rollback ---------------------------------------------------------------------------

def rollback_plan(ops: DataFrame, backups: DataFrame, files: DataFrame, wanted: DataFrame | None = None,
                  *, root: str) -> DataFrame:
    """What undoing the wanted change sets (repo, change_id; all if None) does to each path.
    Undoing runs newest first, so the state before the oldest operation on a path is what remains."""
    chosen = ops if wanted is None else ops.join(wanted.select("repo", "change_id"), ["repo", "change_id"], "left_semi")
    first = chosen.groupBy(*KEY).agg(F.min(F.struct("created_at", "change_id", "op_idx", "existed_before", "sha256_before")).alias("o"))
    first = first.select(*KEY, "o.change_id", "o.existed_before", "o.sha256_before")
    payload = backups.select("repo", "change_id", "path", F.col("content").alias("restored"))
    here = files.select(*KEY, F.lit(True).alias("present"))
    joined = first.join(payload, ["repo", "change_id", "path"], "left").join(here, KEY, "left")
    c = F.col
    reason = F.coalesce(
        F.when(~paths.is_within_root(c("path"), root), "the path leads out of the repository"),
        F.when(paths.is_protected(c("path")), "version control and state folders are closed to writes"),
        F.when(c("existed_before") & c("restored").isNull(), "there is no backup of the file to restore"))
    action = (F.when(c("existed_before"), "restored").when(c("present"), "deleted-created-file").otherwise("already-absent"))
    return joined.select(*KEY, "change_id", F.when(c("existed_before"), "restore-original").otherwise("delete-created-file").alias("plan"),
                         F.when(reason.isNull(), action).alias("applied"), "sha256_before", reason.alias("reject_reason"),
                         "restored")


def apply_rollback(files: DataFrame, plan: DataFrame) -> DataFrame:
    """The files after the rollback: restored originals, without what the changes had created."""
    accepted = plan.filter(F.col("reject_reason").isNull())
    untouched = files.select(*KEY, "content").join(accepted.select(*KEY), KEY, "left_anti")
    back = accepted.filter(F.col("applied") == "restored").select(*KEY, F.col("restored").alias("content"))
    return untouched.unionByName(back).withColumn("size_bytes", F.octet_length("content").cast("bigint"))
