"""Plans, change logs, rollback and three-way merges over the derived files."""

from pyspark.sql import functions as F

from codequarry.operators import changes, merge
from codequarry.session import materialize

from .registry import query
from .views import FILES, TEMPLATES, files, sql_matches
from .inventory import _WRITE_SENSITIVE

STAMP = "2024-05-01 10:00:00"


def _edits(df):
    """One edit per file and one new path per file; the kind of edit goes by ``doc_id``."""
    k, p = F.col("doc_id"), F.col("path")
    mode = F.when(k % 4 == 0, "create").when(k % 4 == 1, "append").when(k % 9 == 8, "patch").otherwise("overwrite")
    sha = F.when(k % 6 == 0, F.sha2("content", 256)).when(k % 6 == 1, F.repeat(F.lit("0"), F.lit(64))).when(k % 6 == 2, "xyz")
    on_file = df.select("repo", p.alias("path"), mode.alias("mode"), F.concat(F.lit("edit "), k.cast("string"), F.lit("\n")).alias("content"),
                        sha.alias("expected_sha256"), (k % 2 == 0).alias("allow_sensitive"))
    fresh = F.when(k % 5 == 0, F.concat(F.lit(".git/"), p)).when(k % 5 == 1, F.concat(F.lit("../"), p)).otherwise(F.concat(F.lit("new/"), p))
    on_new = df.select("repo", fresh.alias("path"), F.lit("create").alias("mode"), F.col("content"),
                       F.lit(None).cast("string").alias("expected_sha256"), F.lit(False).alias("allow_sensitive"))
    return on_file.unionByName(on_new)


ROOT = "/srv/code"
_SENS = f"({sql_matches(chr(34) + 'name' + chr(34), _WRITE_SENSITIVE)} AND name NOT IN {TEMPLATES})"
_EDITS = """edits AS (SELECT repo, path, doc_id, CASE WHEN doc_id % 4 = 0 THEN 'create' WHEN doc_id % 4 = 1 THEN 'append' WHEN doc_id % 9 = 8 THEN 'patch' ELSE 'overwrite' END AS mode,
  concat('edit ', doc_id, chr(10)) AS content, CASE doc_id % 6 WHEN 0 THEN sha256(content) WHEN 1 THEN repeat('0', 64) WHEN 2 THEN 'xyz' END AS expected_sha256, doc_id % 2 = 0 AS allow_sensitive, content AS before FROM files
 UNION ALL SELECT repo, CASE doc_id % 5 WHEN 0 THEN '.git/' WHEN 1 THEN '../' ELSE 'new/' END || path, doc_id, 'create', content, NULL, false, NULL FROM files)"""
_PLAN = _EDITS + f""", named AS (SELECT *, string_split(path, '/')[-1] AS name, CASE WHEN mode = 'append' THEN before || content ELSE content END AS after FROM edits),
 plan AS (SELECT repo, path, mode, before IS NOT NULL AS existed_before, before, after, CASE
   WHEN path LIKE '../%' THEN 'the path leads out of the repository'
   WHEN path LIKE '.git/%' THEN 'version control and state folders are closed to writes'
   WHEN NOT allow_sensitive AND {_SENS} THEN 'the name is one of sensitive files; allow_sensitive lets it through'
   WHEN mode = 'patch' THEN 'unknown mode; there are create, overwrite and append'
   WHEN expected_sha256 = 'xyz' THEN 'the expected digest is no SHA-256 in lower-case hex'
   WHEN mode = 'create' AND before IS NOT NULL THEN 'nothing is created: the file is already there'
   WHEN before IS NOT NULL AND expected_sha256 <> sha256(before) THEN 'the file has changed since the expected digest was taken' END AS reject_reason FROM named)"""


def _plan(spark, sf_dir, reuse=False):
    """``reuse``: the plan is needed more than once, so it is stored instead of joined again."""
    df = files(spark, sf_dir)
    plan = changes.write_plan(_edits(df), df, ROOT)
    return df, materialize(plan) if reuse else plan


@query(f"""WITH {FILES}, {_PLAN} SELECT repo, path, mode, existed_before, reject_reason, CASE WHEN reject_reason IS NULL THEN 'planned' ELSE 'rejected' END AS status,
 sha256(before) AS sha256_before, strlen(before) AS bytes_before, CASE WHEN reject_reason IS NULL THEN sha256(after) END AS sha256_after,
 CASE WHEN reject_reason IS NULL THEN strlen(after) END AS bytes_after FROM plan""")
def write_plan(spark, sf_dir):
    return _plan(spark, sf_dir)[1].select("repo", "path", "mode", "existed_before", "reject_reason", "status", "sha256_before",
                                          "bytes_before", "sha256_after", "bytes_after")


@query(f"""WITH {FILES}, {_PLAN} SELECT f.repo, f.path, sha256(coalesce(p.after, f.content)) AS content_sha256 FROM files f
  LEFT JOIN plan p ON p.repo = f.repo AND p.path = f.path AND p.reject_reason IS NULL
 UNION ALL SELECT repo, path, sha256(after) FROM plan WHERE reject_reason IS NULL AND NOT existed_before""")
def write_apply(spark, sf_dir):
    df, plan = _plan(spark, sf_dir, reuse=True)
    return changes.apply_plan(df, plan).select("repo", "path", F.sha2("content", 256).alias("content_sha256"))


_REPLACE = """counted AS (SELECT *, (length(content) - length(replace(content, ' the ', ''))) // 5 AS n FROM files),
 plan AS (SELECT repo, path, n AS occurrences, CASE WHEN n <> 1 THEN concat('occurs ', n, ' times, not 1') END AS reject_reason,
   replace(content, ' the ', ' THE ') AS after FROM counted)"""


@query(f"""WITH {FILES}, {_REPLACE} SELECT repo, path, occurrences, reject_reason, CASE WHEN reject_reason IS NULL THEN sha256(after) END AS sha256_after FROM plan""")
def bulk_replace(spark, sf_dir):
    df = files(spark, sf_dir)
    edits = df.select("repo", "path", F.lit(" the ").alias("find"), F.lit(" THE ").alias("replace"),
                      F.lit(1).alias("expected_occurrences"), F.lit(True).alias("allow_sensitive"))
    return changes.replace_plan(edits, df, ROOT).select("repo", "path", "occurrences", "reject_reason", "sha256_after")


_LOG = f"""ops AS (SELECT repo, concat('20240501T100000Z-', left(sha256(concat_ws(chr(1), 'batch-1', repo, path)), 32)) AS change_id, 0 AS op_idx, 'write_file' AS operation, path,
  existed_before, sha256(before) AS sha256_before, strlen(before) AS bytes_before, sha256(after) AS sha256_after, strlen(after) AS bytes_after, before FROM plan WHERE reject_reason IS NULL)"""


def _log(spark, sf_dir, reuse=False):
    df, plan = _plan(spark, sf_dir, reuse)
    return df, plan, *changes.change_log(plan, "batch-1", F.lit(STAMP).cast("timestamp"))


@query(f"""WITH {FILES}, {_PLAN}, {_LOG} SELECT repo, change_id, op_idx, operation, path, existed_before, sha256_before, bytes_before, sha256_after, bytes_after,
 CASE WHEN existed_before THEN concat('backups/', change_id, '/', path) END AS backup_file FROM ops""")
def change_log(spark, sf_dir):
    return _log(spark, sf_dir)[2].drop("created_at")


@query(f"WITH {FILES}, {_PLAN}, {_LOG} SELECT repo, change_id, path, sha256(before) AS content_sha256 FROM ops WHERE existed_before")
def change_backups(spark, sf_dir):
    return _log(spark, sf_dir)[3].select("repo", "change_id", "path", F.sha2("content", 256).alias("content_sha256"))


@query(f"""WITH {FILES}, {_PLAN}, {_LOG}, sets AS (SELECT repo, change_id, count(*) AS operation_count FROM ops GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY change_id DESC) AS pos FROM sets) SELECT * FROM r WHERE pos <= 10""")
def list_changes(spark, sf_dir):
    return changes.newest_changes(_log(spark, sf_dir)[2], 10).drop("created_at")


@query(f"""WITH {FILES}, {_PLAN}, {_LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY change_id DESC) AS pos FROM ops)
SELECT repo, change_id, op_idx, path FROM r WHERE pos <= 10""")
def listed_change_paths(spark, sf_dir):
    ops = _log(spark, sf_dir)[2]
    return changes.change_paths(ops, changes.newest_changes(ops, 10))


def _rollback(spark, sf_dir):
    df, plan, ops, backups = _log(spark, sf_dir, reuse=True)
    after = changes.apply_plan(df, plan)
    # as if created files had meanwhile been removed again in one top-level folder
    after = after.filter(~F.col("path").startswith("new/docs/"))
    return after, changes.rollback_plan(ops, backups, after, root=ROOT)


@query(f"""WITH {FILES}, {_PLAN}, {_LOG} SELECT repo, path, change_id, CASE WHEN existed_before THEN 'restore-original' ELSE 'delete-created-file' END AS plan,
 CASE WHEN existed_before THEN 'restored' WHEN path LIKE 'new/docs/%' THEN 'already-absent' ELSE 'deleted-created-file' END AS applied, sha256_before, CAST(NULL AS varchar) AS reject_reason FROM ops""")
def rollback_plan(spark, sf_dir):
    return _rollback(spark, sf_dir)[1].drop("restored")


@query(f"WITH {FILES} SELECT repo, path, sha256(content) AS content_sha256 FROM files")
def rollback_apply(spark, sf_dir):
    after, plan = _rollback(spark, sf_dir)
    return changes.apply_rollback(after, plan).select("repo", "path", F.sha2("content", 256).alias("content_sha256"))


# main and shadow: every file, changed or dropped by doc_id
_SIDES = """base AS (SELECT repo, path, content FROM files),
 main AS (SELECT repo, path, CASE WHEN doc_id % 7 = 0 OR doc_id % 12 = 1 THEN content || 'main' ELSE content END AS content FROM files WHERE doc_id % 13 <> 0),
 shadow AS (SELECT repo, CASE WHEN doc_id % 17 = 0 THEN path || '.new' ELSE path END AS path, CASE WHEN doc_id % 12 = 1 THEN content || 'main' WHEN doc_id % 5 = 0 THEN content || 'shadow' ELSE content END AS content
   FROM files WHERE doc_id % 11 <> 0),
 allp AS (SELECT coalesce(b.repo, s.repo) AS repo, coalesce(b.path, s.path) AS path, b.content AS b, s.content AS s FROM base b FULL JOIN shadow s ON b.repo = s.repo AND b.path = s.path),
 changed AS (SELECT *, CASE WHEN b IS NULL THEN 'A' WHEN s IS NULL THEN 'D' ELSE 'M' END AS change FROM allp WHERE b IS DISTINCT FROM s),
 checked AS (SELECT c.repo, c.path, change, s, m.repo IS NOT NULL AS in_main,
   change <> 'D' AND coalesce(m.content, '') <> coalesce(b, '') AND s <> coalesce(b, '') AS conflict FROM changed c LEFT JOIN main m ON m.repo = c.repo AND m.path = c.path)"""


def _sides(spark, sf_dir):
    df, k, t = files(spark, sf_dir), F.col("doc_id"), F.col("content")
    main = df.filter(k % 13 != 0).select("repo", "path", F.when((k % 7 == 0) | (k % 12 == 1), F.concat(t, F.lit("main"))).otherwise(t).alias("content"))
    shadow = df.filter(k % 11 != 0).select(
        "repo", F.when(k % 17 == 0, F.concat("path", F.lit(".new"))).otherwise(F.col("path")).alias("path"),
        F.when(k % 12 == 1, F.concat(t, F.lit("main"))).when(k % 5 == 0, F.concat(t, F.lit("shadow"))).otherwise(t).alias("content"))
    return df.select("repo", "path", "content"), main, shadow


@query(f"WITH {FILES}, {_SIDES} SELECT repo, path, change FROM changed")
def changed_paths(spark, sf_dir):
    base, _, shadow = _sides(spark, sf_dir)
    return merge.changed_paths(base, shadow).select("repo", "path", "change")


@query(f"WITH {FILES}, {_SIDES} SELECT repo, path, change, conflict, in_main FROM checked")
def three_way_conflicts(spark, sf_dir):
    return merge.three_way(*_sides(spark, sf_dir))


@query(f"""WITH {FILES}, {_SIDES} SELECT repo, count(*) AS changed_count, count(*) FILTER (WHERE conflict) AS conflict_count,
 count(*) FILTER (WHERE change <> 'D' AND NOT conflict) AS clean_count, bool_or(conflict) AS has_conflicts FROM checked GROUP BY repo""")
def merge_summary(spark, sf_dir):
    return merge.merge_summary(merge.three_way(*_sides(spark, sf_dir)))


@query(f"""WITH {FILES}, {_SIDES} SELECT repo, path, change, conflict, CASE WHEN bool_or(conflict) OVER (PARTITION BY repo) THEN 'held' WHEN change <> 'D' THEN 'copied' WHEN in_main THEN 'deleted' ELSE 'none' END AS action,
 CASE WHEN bool_or(conflict) OVER (PARTITION BY repo) THEN 'conflicts-detected' ELSE 'promoted' END AS status FROM checked""")
def promote_plan(spark, sf_dir):
    return merge.promote_plan(merge.three_way(*_sides(spark, sf_dir)))


@query(f"""WITH {FILES}, {_SIDES} SELECT m.repo, m.path, sha256(m.content) AS content_sha256 FROM main m LEFT JOIN checked c ON c.repo = m.repo AND c.path = m.path WHERE c.path IS NULL
 UNION ALL SELECT repo, path, sha256(s) FROM checked WHERE change <> 'D'""")
def promote_forced(spark, sf_dir):
    base, main, shadow = _sides(spark, sf_dir)
    plan = merge.promote_plan(merge.three_way(base, main, shadow), force=True)
    return merge.promote(main, shadow, plan).select("repo", "path", F.sha2("content", 256).alias("content_sha256"))


@query(f"WITH {FILES}, {_SIDES} SELECT repo, path, 'deleted' AS side FROM base ANTI JOIN shadow USING (repo, path) UNION ALL SELECT repo, path, 'created' FROM shadow ANTI JOIN base USING (repo, path)")
def created_deleted(spark, sf_dir):
    base, _, shadow = _sides(spark, sf_dir)
    gone, new = merge.only_in(base, shadow), merge.only_in(shadow, base)
    return gone.withColumn("side", F.lit("deleted")).unionByName(new.withColumn("side", F.lit("created")))
