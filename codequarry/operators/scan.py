"""Secret signatures, entropy tokens and code search.

All three stay narrow until something is found: lines are an array inside the file's row, only
hits are exploded, and only per-repo or per-token partial results are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import params, rules
from ..functions import paths, text
from ..functions.regex import let, matches
from ..plans.corpus import exploded, inventory, readable, walk_order, walk_position
from ..plans.topn import top_n, until_nth
from ..session import materialize

SENSITIVE_NOTE = "Reported by its path alone: a name that usually holds secrets is never opened."
_HIT = "array<struct<line:int,signature:string,preview:string>>"


def _line_hits(content: Column) -> Column:
    """One hit per matching line: the first signature, previewed redacted and then cut."""
    body = text.text_of(content)
    marked = F.transform(text.lines(body), lambda line, i: F.struct(
        (i + 1).alias("line"), text.first_rule(line).alias("signature"), line.alias("raw")))
    hits = F.transform(F.filter(marked, lambda m: m["signature"].isNotNull()), lambda m: F.struct(
        m["line"].alias("line"), m["signature"].alias("signature"),
        text.preview(text.redact(text.strip(m["raw"]))).alias("preview")))
    return F.when(text.has_secret_hint(body), hits).otherwise(F.array().cast(_HIT))


def with_secret_hits(seen: DataFrame, max_file_bytes: int | None = None) -> DataFrame:
    """Adds ``opened`` and ``hits``. Files with a sensitive name yield one finding without a line
    and are never opened."""
    named = paths.is_sensitive_file(F.col("path"))
    path_hit = F.array(F.struct(F.lit(None).cast("int").alias("line"), F.lit("sensitive-file").alias("signature"),
                                F.lit(SENSITIVE_NOTE).alias("preview"))).cast(_HIT)
    opened = ~named & readable(max_file_bytes)
    return (seen.withColumn("opened", opened)
            .withColumn("hits", F.when(named, path_hit).when(F.col("opened"), _line_hits(F.col("content")))
                        .otherwise(F.array().cast(_HIT))))


def secret_findings(files: DataFrame, max_files: int | None = None, max_file_bytes: int | None = None,
                    max_findings: int | None = None) -> DataFrame:
    """repo, file, line, signature, preview (plus ``pos`` when capped)."""
    params.file_bytes(max_file_bytes)
    params.int_in(max_findings, 1, params.NO_LIMIT, "max_findings")
    scanned = with_secret_hits(inventory(files, max_files), max_file_bytes)
    found = exploded(scanned, ["repo", "path", "walk_key"], F.col("hits")).select("repo", "path", "walk_key", "item.*")
    if max_findings is not None:
        found = top_n(found, ["repo"], [*walk_order(), F.col("line")], max_findings, ["path", "line"])
    return found.drop("walk_key").withColumnRenamed("path", "file")


def secret_scan(files: DataFrame, max_files: int | None = None, max_file_bytes: int | None = None,
                max_findings: int | None = None) -> DataFrame:
    """Per repo: status, files_scanned, finding_count, findings_limit_reached. With a cap, files
    after the one in which the cap is reached do not count as scanned."""
    params.file_bytes(max_file_bytes)
    params.int_in(max_findings, 1, params.NO_LIMIT, "max_findings")
    per_file = (with_secret_hits(inventory(files, max_files), max_file_bytes)
                .select("repo", "path", "walk_key", F.col("opened").cast("int").alias("opened"),
                        F.size("hits").alias("n_hits")))
    return _rollup(per_file, max_findings)


def _rollup(per_file: DataFrame, cap: int | None) -> DataFrame:
    if cap is not None:
        per_file = materialize(per_file)  # a few numbers per file, used twice; contents are scanned once
        stop = until_nth(per_file, "repo", walk_position(), F.col("n_hits"), cap, ["path"])
        per_file = (per_file.join(stop, "repo", "left")
                    .filter(F.col("stop_at").isNull() | (walk_position() <= F.col("stop_at"))))
    found = F.sum("n_hits").cast("bigint")
    total = found if cap is None else F.least(found, F.lit(cap).cast("bigint"))
    out = per_file.groupBy("repo").agg(F.sum("opened").cast("bigint").alias("files_scanned"),
                                       total.alias("finding_count"))
    limit = F.lit(False) if cap is None else F.col("finding_count") >= cap
    return (out.withColumn("findings_limit_reached", limit)
            .withColumn("status", F.when(F.col("finding_count") > 0, "warning").otherwise("pass")))


# --- entropy ----------------------------------------------------------------------------

def _entropy_files(files: DataFrame, max_files: int | None, max_file_bytes: int | None) -> DataFrame:
    ok = ~paths.entropy_skipped(F.col("path")) & (F.col("size_bytes") > 0) & readable(max_file_bytes)
    return inventory(files, max_files).withColumn("opened", ok)


def token_occurrences(files: DataFrame, max_files: int | None = None, max_file_bytes: int | None = None,
                      min_token_length: int = 16, keep: list[str] | None = None) -> DataFrame:
    """Every candidate token with its place and measures; the token itself is dropped at once."""
    params.file_bytes(max_file_bytes)
    params.int_in(min_token_length, 8, 128, "min_token_length", optional=False)
    body = text.text_of(F.col("content"))
    seen = _entropy_files(files, max_files, max_file_bytes)
    per_line = F.filter(
        F.transform(text.lines(body), lambda line, i: F.struct((i + 1).alias("line"), text.tokens(line).alias("tokens"))),
        lambda m: F.size(m["tokens"]) > 0)
    token = F.col("token")
    base = ["repo", "path", "walk_key", *(keep or [])]
    return (exploded(seen, base, F.when(F.col("opened") & text.has_token_hint(body), per_line))
            .select(*base, F.col("item.line").alias("line"),
                    F.posexplode("item.tokens").alias("token_pos", "token"))
            .filter(F.length(token) >= min_token_length)
            .select(*base, "line", "token_pos",
                    text.token_hash(token).alias("token_hash"), text.token_preview(token).alias("token_preview"),
                    text.shannon_entropy(token).alias("entropy_bits"), F.length(token).alias("length")))


def entropy_findings(files: DataFrame, max_files: int | None = None, max_file_bytes: int | None = None,
                     entropy_threshold: float = 4.5, min_token_length: int = 16,
                     max_findings: int | None = None) -> DataFrame:
    """First occurrence of each distinct token per repo at or above the threshold. Entropy depends
    on the token alone, so filtering first keeps the same rows and shuffles far fewer."""
    threshold = params.number_in(entropy_threshold, 2.0, 8.0, "entropy_threshold")
    params.int_in(max_findings, 1, params.NO_LIMIT, "max_findings")
    high = token_occurrences(files, max_files, max_file_bytes, min_token_length).filter(F.col("entropy_bits") >= threshold)
    first = high.groupBy("repo", "token_hash").agg(F.min(F.struct(
        "walk_key", "path", "line", "token_pos", "token_preview", "entropy_bits", "length")).alias("f"))
    found = first.select("repo", "token_hash", "f.*")
    if max_findings is not None:
        # the cap is only tested between lines, so the line that reaches it is kept whole
        place = F.struct("walk_key", "path", "line")
        stop = until_nth(found, "repo", F.struct("walk_key", "path", "line", "token_pos"), F.lit(1), max_findings,
                         ["token_hash"])
        stop = stop.select("repo", F.struct("stop_at.walk_key", "stop_at.path", "stop_at.line").alias("stop_line"))
        found = found.join(stop, "repo", "left").filter(F.col("stop_line").isNull() | (place <= F.col("stop_line")))
    return found.select("repo", F.col("path").alias("file"), "line", "token_preview",
                        text.round_to(F.col("entropy_bits"), 3).alias("entropy"), "length", "token_hash")


def entropy_scan(files: DataFrame, max_files: int | None = None, max_file_bytes: int | None = None,
                 entropy_threshold: float = 4.5, min_token_length: int = 16,
                 max_findings: int | None = None) -> DataFrame:
    """Per repo: status, files_scanned, finding_count, findings_limit_reached."""
    params.file_bytes(max_file_bytes)
    found = entropy_findings(files, max_files, max_file_bytes, entropy_threshold, min_token_length, max_findings)
    opened = _entropy_files(files, max_files, max_file_bytes).select("repo", "path", "walk_key", "opened")
    counts = found.groupBy("repo").agg(F.count("*").alias("n"))
    if max_findings is not None:
        last = found.withColumn("walk_key", paths.walk_key(F.col("file"))).groupBy("repo").agg(
            F.count("*").alias("n"), F.max(F.struct("walk_key", F.col("file").alias("path"))).alias("last"))
        stop = last.filter(F.col("n") >= max_findings).select("repo", "last")
        opened = (opened.join(stop, "repo", "left")
                  .filter(F.col("last").isNull() | (walk_position() <= F.col("last"))))
    scanned = opened.groupBy("repo").agg(F.count_if("opened").alias("files_scanned"))
    total = F.coalesce(F.col("n"), F.lit(0).cast("bigint"))
    limit = F.lit(False) if max_findings is None else total >= max_findings
    return scanned.join(counts, "repo", "left").select(
        "repo", "files_scanned", total.alias("finding_count"), limit.alias("findings_limit_reached"),
        F.when(total > 0, "warning").otherwise("pass").alias("status"))


# --- search -----------------------------------------------------------------------------

def _searched(files: DataFrame, pattern: str, file_pattern: str | None, max_files: int | None,
              max_file_bytes: int | None, context_lines: int) -> DataFrame:
    params.pattern(files.sparkSession, pattern, "pattern")
    params.file_bytes(max_file_bytes)
    params.int_in(context_lines, 0, 10, "context_lines", optional=False)
    seen = inventory(files, max_files)
    if file_pattern is not None:
        params.pattern(files.sparkSession, file_pattern, "file_pattern")
        seen = seen.filter(matches(F.col("path"), file_pattern))
    k = context_lines

    def hits(all_lines):
        numbered = F.transform(all_lines, lambda line, i: F.struct(i.alias("i"), line.alias("text")))
        return F.transform(F.filter(numbered, lambda m: matches(m["text"], pattern)), lambda m: F.struct(
            (m["i"] + 1).alias("line"), m["text"].alias("text"),
            F.slice(all_lines, F.greatest(m["i"] - k, F.lit(0)) + 1, F.least(m["i"], F.lit(k))).alias("before"),
            F.slice(all_lines, m["i"] + 2, F.lit(k)).alias("after")))

    found = let(text.lines(text.text_of(F.col("content"))), hits)
    return seen.withColumn("opened", readable(max_file_bytes)).withColumn("hits", F.when(F.col("opened"), found))


def search_code(files: DataFrame, pattern: str, file_pattern: str | None = None, max_results: int | None = None,
                context_lines: int = 1, max_files: int | None = None,
                max_file_bytes: int | None = None, redact_secrets: bool = True, line_chars: int | None = None) -> DataFrame:
    """repo, file, line, text, before, after: matching lines with context, masked, and whole unless ``line_chars`` cuts them;
    ``text_truncated``, ``before_truncated`` and ``after_truncated`` tell which lines were longer than what is shown."""
    params.int_in(max_results, 1, params.NO_LIMIT, "max_results")
    params.flag(redact_secrets, "redact_secrets")
    params.int_in(line_chars, 1, params.NO_LIMIT, "line_chars")
    masked = (lambda c: text.redact(c)) if redact_secrets else (lambda c: c)
    cut = lambda c: c if line_chars is None else F.left(c, F.lit(line_chars))
    longer = lambda c: F.lit(False) if line_chars is None else F.length(c) > line_chars
    base = ["repo", "path", "walk_key"]
    found = exploded(_searched(files, pattern, file_pattern, max_files, max_file_bytes, context_lines), base,
                     F.col("hits")).select(*base, "item.*")
    if max_results is not None:
        found = top_n(found, ["repo"], [*walk_order(), F.col("line")], max_results, ["path", "line"])
    rank = ["pos"] if max_results is not None else []
    # every line of a hit is masked once; what is shown of it and whether it is whole come from the masked line
    lines = F.transform(F.concat(F.array("text"), "before", "after"), masked)
    place = lambda a, n: F.slice("_lines", a, n)
    before, after = place(F.lit(2), F.size("before")), place(F.size("before") + 2, F.size("after"))
    found = found.withColumn("_lines", lines)
    return found.select("repo", F.col("path").alias("file"), "line", cut(F.col("_lines")[0]).alias("text"),
                        F.transform(before, cut).alias("before"), F.transform(after, cut).alias("after"),
                        longer(F.col("_lines")[0]).alias("text_truncated"), F.transform(before, longer).alias("before_truncated"),
                        F.transform(after, longer).alias("after_truncated"), *rank)


def search_summary(files: DataFrame, pattern: str, file_pattern: str | None = None, max_results: int | None = None,
                   max_files: int | None = None, max_file_bytes: int | None = None) -> DataFrame:
    """Per repo: files_searched, match_count, results_limit_reached."""
    params.int_in(max_results, 1, params.NO_LIMIT, "max_results")
    per_file = (_searched(files, pattern, file_pattern, max_files, max_file_bytes, 0)
                .select("repo", "path", "walk_key", F.col("opened").cast("int").alias("opened"),
                        F.coalesce(F.size("hits"), F.lit(0)).alias("n_hits")))
    return _rollup(per_file, max_results).select(
        "repo", F.col("files_scanned").alias("files_searched"), F.col("finding_count").alias("match_count"),
        F.col("findings_limit_reached").alias("results_limit_reached"))


def redacted(files: DataFrame) -> DataFrame:
    """Every file with its secrets masked over the whole text."""
    body = text.text_of(F.col("content"))
    return files.select("repo", "path", text.redact(body).alias("content"))


def dangerous_commands(files: DataFrame) -> DataFrame:
    """repo, file and the id of every dangerous-command rule that its text matches."""
    named = files.select("repo", F.col("path").alias("file"), text.text_of(F.col("content")).alias("body"))
    return exploded(named, ["repo", "file"], text.all_rules(F.col("body"), rules.DANGEROUS_COMMANDS)).withColumnRenamed("item", "signature")
