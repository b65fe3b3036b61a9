"""Bounded reads of single files and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import params
from ..functions import paths, text
from ..functions.regex import let


def _read(content: Column, max_bytes: int | None, max_lines: int | None, redact: bool) -> Column:
    """A struct with the decoded, masked and then cut text and what was cut. Without limits the text is whole."""
    raw = content.cast("binary")
    whole = text.text_of(raw)
    shown = text.redact(whole) if redact else whole
    # a character that the cut goes through is shown as U+FFFD
    body = shown if max_bytes is None else text.text_of(F.substring(shown.cast("binary"), 1, max_bytes))
    max_lines = F.lit(2**31 - 1 if max_lines is None else max_lines)

    def shaped(decoded):
        return let(text.lines_kept(decoded), lambda kept: F.struct(
            F.lit(False).alias("is_binary"), text.replaced_count(decoded).alias("replaced_characters"),
            (F.lit(False) if max_bytes is None else F.octet_length(raw) > max_bytes).alias("truncated_bytes"),
            (F.size(kept) > max_lines).alias("truncated_lines"),
            F.least(F.size(kept), max_lines).alias("lines_returned"),
            F.array_join(F.slice(kept, F.lit(1), max_lines), "").alias("content")))

    shape = ("struct<is_binary:boolean,replaced_characters:int,truncated_bytes:boolean,truncated_lines:boolean,"
             "lines_returned:int,content:string>")
    none = F.lit(None)
    hidden = F.struct(F.lit(True).alias("is_binary"), none.alias("replaced_characters"), none.alias("truncated_bytes"),
                      none.alias("truncated_lines"), none.alias("lines_returned"), none.alias("content")).cast(shape)
    return F.when(text.is_binary(content), hidden).otherwise(let(body, shaped).cast(shape))


def read_files(files: DataFrame, max_bytes: int | None = None, max_lines: int | None = None, redact_secrets: bool = True) -> DataFrame:
    """repo, path, size_bytes and the content within the limits (None: whole); binary files keep a null content."""
    params.int_in(max_bytes, 1, params.NO_LIMIT, "max_bytes")
    params.int_in(max_lines, 1, 2**31 - 1, "max_lines")
    params.flag(redact_secrets, "redact_secrets")
    got = _read(F.col("content"), max_bytes, max_lines, redact_secrets)
    return files.select("repo", "path", "size_bytes", got.alias("r")).select("repo", "path", "size_bytes", "r.*")


def batch_read(requests: DataFrame, files: DataFrame, root: str, **limits) -> DataFrame:
    """One row per requested path: ``ok`` with the content, or ``error`` with the reason. The file
    side is reduced to the requested paths before it is read."""
    asked = requests.select("repo", F.col("path").alias("requested")).withColumn(
        "error", F.when(F.trim("requested") == "", "no path was given")
        .when(F.length("requested") > 4096, "the path is too long")
        .when(~paths.is_within_root(F.col("requested"), root), "the path leads out of the repository"))
    relative = F.when(F.col("requested").startswith(root + "/"), F.substring("requested", len(root) + 2, 2**31 - 1)).otherwise(F.col("requested"))
    asked = asked.withColumn("path", F.when(F.col("error").isNull(), paths.resolved_path(relative)))
    wanted = files.join(asked.select("repo", "path").filter("path IS NOT NULL").distinct(), ["repo", "path"], "left_semi")
    read = read_files(wanted, **limits).withColumn("found", F.lit(True))
    return (asked.join(read, ["repo", "path"], "left")
            .withColumn("error", F.when(F.col("error").isNotNull(), F.col("error"))
                        .when(F.col("found").isNull(), "no such file"))
            .withColumn("status", F.when(F.col("error").isNull(), "ok").otherwise("error")).drop("found"))


def batch_status(results: DataFrame) -> DataFrame:
    """Per repo: ok, partial or error."""
    ok, bad = F.count_if(F.col("status") == "ok"), F.count_if(F.col("status") == "error")
    return results.groupBy("repo").agg(
        F.count("*").alias("file_count"), ok.alias("succeeded"), bad.alias("errored"),
        F.when(bad == 0, "ok").when(ok == 0, "error").otherwise("partial").alias("status"))
