"""Readiness, risk and the portfolio scorecard."""

from pyspark.sql import functions as F

from codequarry.operators import audit, inventory, readiness

from .audit import _SESSIONS, records, sessions
from .inventory import _RULES, _STATS
from .registry import query, table
from .scan import _FINDINGS
from .views import files

_TREE = """worktree AS (SELECT concat('src', s_suppkey % 20) AS repo, true AS available, min(s_suppkey) % 4 <> 3 AS repository,
  count(*) FILTER (WHERE s_acctbal < 0 AND s_suppkey % 3 = 0) AS changed_file_count, min(s_acctbal) > -700 AS diff_check_ok FROM supplier GROUP BY s_suppkey % 20)"""


def worktree(spark, sf_dir):
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    return s.groupBy((k % 20).alias("r")).agg(
        (F.min("s_suppkey") % 4 != 3).alias("repository"), F.count_if((F.col("s_acctbal") < 0) & (k % 3 == 0)).alias("changed_file_count"),
        (F.min("s_acctbal") > -700).alias("diff_check_ok")).select(
        F.concat(F.lit("src"), F.col("r").cast("string")).alias("repo"), F.lit(True).alias("available"), "repository",
        "changed_file_count", "diff_check_ok")


def _signal_sql(cap=None):
    src = "seen" if cap is None else "picked"
    picked = "" if cap is None else f", picked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY wk, path) AS rn FROM seen) WHERE rn <= {cap})"
    return f"""{_FINDINGS}{picked}, {_TREE}, found AS (SELECT repo, count(*) AS n FROM findings f WHERE EXISTS (SELECT 1 FROM {src} p WHERE p.repo = f.repo AND p.path = f.file) GROUP BY repo),
 docs AS (SELECT repo, bool_or(path = 'README.md') AS has_readme, bool_or(path = 'CHANGELOG.md') AS has_changelog FROM files GROUP BY repo),
 sig AS (SELECT s.repo, count(*) AS file_count, {', '.join(f'count(*) FILTER (WHERE {sql}) AS {n}' for n, sql in _RULES.items())} FROM {src} s GROUP BY s.repo),
 full_sig AS (SELECT sig.*, has_readme, has_changelog, coalesce(found.n, 0) AS secret_findings, coalesce(w.available, false) AS available, coalesce(w.repository, false) AS repository,
   w.changed_file_count, coalesce(w.diff_check_ok, false) AS diff_ok, {'false' if cap is None else f'file_count >= {cap}'} AS reached FROM sig JOIN docs USING (repo) LEFT JOIN found USING (repo) LEFT JOIN worktree w USING (repo)),
 checks AS (SELECT repo, 0 AS pos, 'inventory-completeness' AS id, CASE WHEN reached THEN 'warning' ELSE 'pass' END AS status FROM full_sig
  UNION ALL SELECT repo, 1, 'build-manifests', CASE WHEN manifests > 0 THEN 'pass' ELSE 'warning' END FROM full_sig
  UNION ALL SELECT repo, 2, 'dependency-lockfiles', CASE WHEN lockfiles > 0 THEN 'pass' WHEN manifests > 0 THEN 'warning' ELSE 'unknown' END FROM full_sig
  UNION ALL SELECT repo, 3, 'test-evidence', CASE WHEN tests > 0 THEN 'pass' ELSE 'warning' END FROM full_sig
  UNION ALL SELECT repo, 4, 'ci-evidence', CASE WHEN ci > 0 THEN 'pass' ELSE 'warning' END FROM full_sig
  UNION ALL SELECT repo, 5, 'documentation', CASE WHEN has_readme THEN 'pass' ELSE 'warning' END FROM full_sig
  UNION ALL SELECT repo, 6, 'changelog', CASE WHEN has_changelog THEN 'pass' ELSE 'warning' END FROM full_sig
  UNION ALL SELECT repo, 7, 'working-tree', CASE WHEN available AND repository THEN CASE WHEN changed_file_count = 0 THEN 'pass' ELSE 'warning' END ELSE 'unknown' END FROM full_sig
  UNION ALL SELECT repo, 8, 'diff-whitespace', CASE WHEN diff_ok THEN 'pass' ELSE 'fail' END FROM full_sig WHERE available AND repository),
 ready AS (SELECT repo, count(*) FILTER (WHERE status = 'pass') AS passed, count(*) FILTER (WHERE status = 'warning') AS warnings, count(*) FILTER (WHERE status = 'fail') AS failed,
   count(*) FILTER (WHERE status = 'unknown') AS unknown FROM checks GROUP BY repo),
 labelled AS (SELECT *, CASE WHEN failed > 0 THEN 'blocked' WHEN warnings > 0 THEN 'needs-review' ELSE 'ready-for-verification' END AS readiness_status FROM ready),
 factors AS (SELECT repo, unnest([CASE WHEN secret_findings > 0 THEN 40 END, CASE WHEN manifests > 0 AND lockfiles = 0 THEN 15 END, CASE WHEN tests = 0 THEN 15 END, CASE WHEN ci = 0 THEN 10 END,
   CASE WHEN repository AND changed_file_count > 0 THEN 10 END, CASE WHEN reached THEN 5 END, CASE WHEN failed > 0 THEN 20 END, CASE WHEN NOT has_readme THEN 5 END]) AS w,
   unnest(['secret-findings', 'missing-lockfile', 'no-test-evidence', 'no-ci-evidence', 'dirty-working-tree', 'sample-limit-reached', 'readiness-failures', 'no-readme']) AS id, unnest(range(8)) AS i
  FROM full_sig JOIN labelled USING (repo)),
 scores AS (SELECT repo, least(100, CAST(coalesce(sum(w), 0) AS int)) AS score, string_agg(id || ':' || w, ',' ORDER BY w DESC, i) FILTER (WHERE w IS NOT NULL) AS factors FROM factors GROUP BY repo),
 risk AS (SELECT s.repo, score, CASE WHEN score < 10 THEN 'A' WHEN score < 25 THEN 'B' WHEN score < 45 THEN 'C' WHEN score < 70 THEN 'D' ELSE 'F' END AS grade,
   CASE WHEN score < 25 THEN 'low' WHEN score < 45 THEN 'moderate' WHEN score < 70 THEN 'elevated' ELSE 'high' END AS risk_level, coalesce(factors, '') AS factors, readiness_status, secret_findings AS secret_finding_count, file_count
  FROM scores s JOIN labelled USING (repo) JOIN full_sig USING (repo))"""


@query(f"WITH {_signal_sql()} SELECT * FROM checks")
def release_checks(spark, sf_dir):
    rows = readiness.signals(files(spark, sf_dir), worktree=worktree(spark, sf_dir))
    return readiness.readiness_checks(rows).select("repo", "pos", "id", "status")


@query(f"WITH {_signal_sql()} SELECT repo, readiness_status AS status, passed, warnings, failed, unknown, CASE WHEN readiness_status IN ('blocked', 'needs-review') THEN 1 ELSE 0 END AS gate_exit FROM labelled")
def release_readiness(spark, sf_dir):
    rows = readiness.signals(files(spark, sf_dir), worktree=worktree(spark, sf_dir))
    return readiness.release_readiness(rows, strict=True)


def _risk(spark, sf_dir, max_files=None):
    rows = readiness.signals(files(spark, sf_dir), max_files, worktree(spark, sf_dir), with_secrets=True)
    return readiness.risk_score(rows)


def _flat(risk):
    return risk.withColumn("factors", F.array_join(F.transform("factors", lambda f: F.concat(f["id"], F.lit(":"), f["weight"].cast("string"))), ","))


@query(f"WITH {_signal_sql()} SELECT * FROM risk")
def risk_score(spark, sf_dir):
    return _flat(_risk(spark, sf_dir))


@query(f"WITH {_signal_sql(30)} SELECT * FROM risk")
def risk_score_sampled(spark, sf_dir):
    return _flat(_risk(spark, sf_dir, 30))


@query(f"""WITH {_signal_sql()}, {_STATS[_STATS.index('lang AS ('):]}, {_SESSIONS},
 prim AS (SELECT repo, arg_min(language, rank) FILTER (WHERE language <> 'Other') AS primary_language, CAST(sum(lines) AS bigint) AS total_lines FROM ranked GROUP BY repo),
 aud AS (SELECT concat('src', user_id % 20) AS repo, count(*) AS n FROM events GROUP BY 1),
 act AS (SELECT repo, count(*) FILTER (WHERE status = 'active') AS n FROM (SELECT repo, session_id, arg_max(status, pos) AS status FROM sessions GROUP BY repo, session_id) GROUP BY repo)
SELECT r.repo, score, grade, risk_level, readiness_status, secret_finding_count, CASE readiness_status WHEN 'blocked' THEN 'BLOCKED' WHEN 'needs-review' THEN 'WARN' ELSE 'READY' END AS readiness_label,
 primary_language, total_lines, coalesce(aud.n, 0) AS audit_entries, true AS chain_valid, coalesce(act.n, 0) AS active_sessions
FROM risk r LEFT JOIN prim USING (repo) LEFT JOIN aud USING (repo) LEFT JOIN act USING (repo)""")
def portfolio_scorecard(spark, sf_dir):
    df = files(spark, sf_dir)
    e = table(spark, sf_dir, "events").select("event_id", "user_id")
    logs = records(spark, sf_dir).drop("repo").join(e, F.col("ord") == F.col("event_id")).withColumn(
        "repo", F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")))
    log = audit.append(logs.select("repo", "ord", "timestamp_utc", "record"))
    return readiness.portfolio_scorecard(
        _risk(spark, sf_dir), inventory.language_summary(inventory.language_stats(df)), audit.verify(log),
        audit.latest_sessions(sessions(spark, sf_dir)))
