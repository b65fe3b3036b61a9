"""Path rules, snapshots, languages, trees and metrics."""

from pyspark.sql import functions as F

from codequarry.functions import paths, text
from codequarry.operators import inventory

from .registry import query, table
from .views import (CI, FILES, IGNORED, INFRA, LOCKFILES, MANIFESTS, PIECES, SEEN, SENSITIVE_FILE,
                    SENSITIVE_PATH, TEMPLATES, TEST, files, sql_matches)

_NAME = "string_split(path, '/')[-1]"
_RULES = {
    "manifests": f"{_NAME} IN {MANIFESTS}", "lockfiles": f"{_NAME} IN {LOCKFILES}", "ci": sql_matches("path", CI),
    "tests": sql_matches("path", TEST), "infrastructure": sql_matches("path", INFRA),
    "sensitive": f"({sql_matches('path', SENSITIVE_PATH)} AND {_NAME} NOT IN {TEMPLATES})",
}
_WRITE_SENSITIVE = (r"^(?:\.env(?:\..+)?|.*\.(?:pem|key|pfx|p12|jks|keystore)|id_(?:rsa|dsa|ecdsa|ed25519)(?:\..+)?|"
                    r"(?:.*[_.-])?(?:credentials?|secrets?)(?:[_.-].*)?)$")
_EXT = r"'^.+(\.[^.]+)$'"
_SKIPPED = r"\.(png|jpg|jpeg|gif|bmp|ico|svg|webp|woff|woff2|ttf|eot|pyc|pyo|class|o|so|dll|lock|map|zip|tar|gz|bz2|xz|7z)$"


@query(f"""WITH {FILES} SELECT repo, path, {_NAME} AS name, lower(regexp_extract({_NAME}, {_EXT}, 1)) AS suffix,
 NOT regexp_matches(path, '{IGNORED}') AS not_ignored, {', '.join(f'{sql} AS is_{n}' for n, sql in _RULES.items())},
 {sql_matches('path', SENSITIVE_FILE)} AND lower({_NAME}) NOT IN {TEMPLATES} AS is_sensitive_file,
 {sql_matches(_NAME, _WRITE_SENSITIVE)} AND {_NAME} NOT IN {TEMPLATES} AS is_write_sensitive,
 regexp_matches(path, '(^|/)(\\.git|\\.sdlc)(/|$)') AS is_protected,
 regexp_matches(lower({_NAME}), '.{_SKIPPED}') AS entropy_skipped FROM files""")
def path_flags(spark, sf_dir):
    return inventory.path_flags(files(spark, sf_dir))


@query(f"""WITH {SEEN}, r AS (SELECT repo, path, row_number() OVER (PARTITION BY repo ORDER BY wk, path) AS pos FROM seen)
SELECT * FROM r WHERE pos <= 25""")
def sample_walk_order(spark, sf_dir):
    return inventory.sample(files(spark, sf_dir), 25)


_MEMBERS = SEEN + ", tagged AS (" + " UNION ALL ".join(
    f"SELECT repo, '{n}' AS category, path, wk FROM seen WHERE {sql}" for n, sql in _RULES.items()) + """), members AS (SELECT * FROM tagged)"""


@query(f"WITH {_MEMBERS} SELECT repo, category, path FROM members")
def snapshot_members(spark, sf_dir):
    return inventory.snapshot_members(files(spark, sf_dir))


@query(f"""WITH {SEEN} SELECT repo, count(*) AS file_count, count(*) FILTER (WHERE contains(path, chr(65533))) AS non_utf8_paths,
 {', '.join(f"count(*) FILTER (WHERE {sql}) AS {n}_count" for n, sql in _RULES.items())},
 false AS sample_limit_reached FROM seen GROUP BY repo""")
def repo_snapshot(spark, sf_dir):
    return inventory.snapshot_counts(files(spark, sf_dir))


@query(f"""WITH {SEEN}, r AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY wk, path) AS pos FROM seen),
 s AS (SELECT * FROM r WHERE pos <= 40)
SELECT repo, count(*) AS file_count, {', '.join(f"coalesce(string_agg(path, '|' ORDER BY wk, path) FILTER (WHERE {sql}), '') AS {n}" for n, sql in _RULES.items())},
 count(*) >= 40 AS sample_limit_reached FROM s GROUP BY repo""")
def repo_snapshot_sampled(spark, sf_dir):
    snap = inventory.repo_snapshot(files(spark, sf_dir), max_files=40)
    return snap.select("repo", "file_count", *[F.array_join(n, "|").alias(n) for n in inventory.CATEGORIES],
                       "sample_limit_reached")


_LANG = """CASE WHEN lower(regexp_extract(name, '^.+(\\.[^.]+)$', 1)) IN ('.py') THEN 'Python'
 WHEN lower(regexp_extract(name, '^.+(\\.[^.]+)$', 1)) = '.ts' THEN 'TypeScript' WHEN lower(regexp_extract(name, '^.+(\\.[^.]+)$', 1)) = '.go' THEN 'Go'
 WHEN lower(regexp_extract(name, '^.+(\\.[^.]+)$', 1)) IN ('.json', '.jsonc') THEN 'JSON'
 WHEN lower(regexp_extract(name, '^.+(\\.[^.]+)$', 1)) IN ('.yaml', '.yml') THEN 'YAML'
 WHEN lower(regexp_extract(name, '^.+(\\.[^.]+)$', 1)) = '.md' THEN 'Markdown' ELSE 'Other' END"""
_STATS = SEEN + f""", lang AS (SELECT *, {_LANG} AS language FROM seen),
 sized AS (SELECT *, language <> 'Other' AS counted,
   CASE WHEN content = '' THEN 0 ELSE length(content) - length(replace(content, chr(10), '')) + CASE WHEN right(content, 1) = chr(10) THEN 0 ELSE 1 END END AS n FROM lang),
 grouped AS (SELECT repo, language, count(*) AS files, CAST(coalesce(sum(n) FILTER (WHERE counted), 0) AS bigint) AS lines,
   count(*) FILTER (WHERE counted) AS counted_files, min((wk, path)) AS seen_at FROM sized GROUP BY repo, language),
 ranked AS (SELECT repo, language, files, lines, counted_files, row_number() OVER (PARTITION BY repo ORDER BY lines DESC, files DESC, seen_at) AS rank,
   CAST(format('{{:.2f}}', 100 * files / sum(files) OVER (PARTITION BY repo)) AS double) AS files_pct,
   CASE WHEN sum(lines) OVER (PARTITION BY repo) > 0 THEN CAST(format('{{:.2f}}', 100 * lines / sum(lines) OVER (PARTITION BY repo)) AS double) ELSE 0.0 END AS lines_pct FROM grouped)"""


@query(f"WITH {_STATS} SELECT * FROM ranked")
def language_stats(spark, sf_dir):
    return inventory.language_stats(files(spark, sf_dir))


@query(f"""WITH {_STATS} SELECT repo, CAST(sum(files) AS bigint) AS total_files, CAST(sum(lines) AS bigint) AS total_lines,
 CAST(sum(counted_files) AS bigint) AS line_counted_files, arg_min(language, rank) FILTER (WHERE language <> 'Other') AS primary_language FROM ranked GROUP BY repo""")
def language_summary(spark, sf_dir):
    return inventory.language_summary(inventory.language_stats(files(spark, sf_dir)))


_TREE = SEEN + """, parts AS (SELECT repo, path, string_split(path, '/') AS ps FROM seen),
 tree AS (SELECT repo, path, 'file' AS type, len(ps) - 1 AS depth FROM parts WHERE len(ps) - 1 <= {d}
  UNION ALL SELECT DISTINCT repo, array_to_string(list_slice(ps, 1, i), '/') AS path, 'directory', i - 1 FROM
   (SELECT repo, ps, unnest(range(1, least(len(ps) - 1, {d} + 1) + 1)) AS i FROM parts))"""


@query(f"WITH {_TREE.format(d=1000000)} SELECT * FROM tree")
def directory_tree(spark, sf_dir):
    return inventory.directory_tree(files(spark, sf_dir))


@query(f"""WITH {_TREE.format(d=1)}, r AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY depth, replace(lower(path), '/', chr(1)), path) AS pos FROM tree)
SELECT * FROM r WHERE pos <= 30""")
def directory_tree_capped(spark, sf_dir):
    return inventory.directory_tree(files(spark, sf_dir), max_depth=1, max_entries=30)


@query(f"""WITH {PIECES}, kept AS (SELECT repo, path, content, ls FROM arrays)
SELECT repo, path, len(ls) AS lines, CASE WHEN content = '' THEN 0 ELSE length(content) - length(replace(content, chr(10), '')) + CASE WHEN right(content, 1) = chr(10) THEN 0 ELSE 1 END END AS line_count,
 sha256(content) AS content_sha256, strlen(content) AS n_bytes, left(content, 300) AS preview FROM kept""")
def line_counts(spark, sf_dir):
    body = F.col("content")
    return files(spark, sf_dir).filter(paths.not_ignored(F.col("path"))).select(
        "repo", "path", F.size(text.lines(body)).alias("lines"), text.line_count(body).alias("line_count"),
        text.sha256(body).alias("content_sha256"), F.octet_length(body).alias("n_bytes"), text.preview(body).alias("preview"))


# Unicode word edges for RE2: every character that is not a letter, digit or _ is doubled.
_W = r"\p{L}\p{N}_"
_METRICS = PIECES + rf""", base AS (SELECT *, CASE WHEN size_bytes = 0 THEN 'empty' ELSE 'scanned' END AS state FROM arrays),
 marks AS (SELECT *, list_transform(ls, lambda x: upper(regexp_extract(x, '(?i)(TODO|FIXME|HACK|XXX|BUG)([^{_W}]|$)', 1))) AS ks,
   len(regexp_extract_all(regexp_replace(' ' || content || ' ', '([^{_W}])', '\1\1', 'g'), '[^{_W}](if|for|while|case|elif|else  if)[^{_W}]'))
   + len(regexp_extract_all(content, '&&|\|\|')) AS branches FROM base),
 fm AS (SELECT repo, path, wk, size_bytes, state, len(ls) AS lines, len(list_filter(ks, lambda k: k <> '')) AS marker_lines, len(list_filter(ks, lambda k: k = 'TODO')) AS todo,
   len(list_filter(ks, lambda k: k IN ('FIXME', 'BUG'))) AS fixme, len(list_filter(ls, lambda x: length(x) > 200)) AS long_lines, branches FROM marks WHERE state = 'scanned'
   UNION ALL SELECT repo, path, wk, size_bytes, state, NULL, NULL, NULL, NULL, NULL, NULL FROM base WHERE state <> 'scanned'),
 agg AS (SELECT repo, count(*) AS file_count, count(*) FILTER (WHERE state = 'scanned') AS files_scanned, CAST(coalesce(sum(todo), 0) AS bigint) AS todo_count,
   CAST(coalesce(sum(fixme), 0) AS bigint) AS fixme_count, count(*) FILTER (WHERE size_bytes > 262144) AS large_files, CAST(coalesce(sum(long_lines), 0) AS bigint) AS long_lines,
   count(*) FILTER (WHERE state = 'empty') AS empty_files, 0 AS binary_skipped, count(*) FILTER (WHERE branches > 30 AND lines < 200) AS dense_files FROM fm GROUP BY repo),
 scored AS (SELECT *, greatest(0, 100 - least(20, todo_count // 2) - least(20, fixme_count * 3) - least(15, large_files * 2)
   - least(10, long_lines // 20) - least(15, dense_files * 2)) AS health_score FROM agg)"""


@query(f"WITH {_METRICS} SELECT repo, path, lines, marker_lines, todo, fixme, long_lines, branches FROM fm")
def file_metrics(spark, sf_dir):
    return inventory.file_metrics(files(spark, sf_dir)).select(
        "repo", "path", "lines", "marker_lines", "todo", "fixme", "long_lines", "branches")


@query(f"""WITH {_METRICS} SELECT *, CASE WHEN health_score >= 90 THEN 'A' WHEN health_score >= 75 THEN 'B' WHEN health_score >= 60 THEN 'C'
 WHEN health_score >= 40 THEN 'D' ELSE 'F' END AS grade FROM scored""")
def code_metrics(spark, sf_dir):
    return inventory.code_metrics(inventory.file_metrics(files(spark, sf_dir)))


@query(f"""WITH {_METRICS}, r AS (SELECT repo, path AS file, marker_lines AS count, row_number() OVER (PARTITION BY repo ORDER BY marker_lines DESC, wk, path) AS pos
 FROM fm WHERE marker_lines > 0) SELECT * FROM r WHERE pos <= 20""")
def top_todo_files(spark, sf_dir):
    return inventory.top_todo_files(inventory.file_metrics(files(spark, sf_dir)))


@query(f"WITH {_METRICS} SELECT repo, path AS file, branches, lines FROM fm WHERE branches > 30 AND lines < 200")
def complexity_hints(spark, sf_dir):
    return inventory.complexity_hints(inventory.file_metrics(files(spark, sf_dir)))


@query("""WITH raw AS (SELECT page_id, url, regexp_replace(regexp_replace(url, '^https?://[^/]*/', ''), '[?#].*$', '') AS tail FROM pages),
 c AS (SELECT page_id, concat(CASE page_id % 4 WHEN 0 THEN '' WHEN 1 THEN '../' WHEN 2 THEN 'a/b/../' ELSE './x/../../' END, tail, CASE page_id % 3 WHEN 0 THEN '/../..' ELSE '' END) AS p FROM raw),
 d AS (SELECT page_id, p, list_transform(list_filter(string_split(p, '/'), lambda x: x NOT IN ('', '.')), lambda x: CASE WHEN x = '..' THEN -1 ELSE 1 END) AS ds FROM c)
SELECT page_id, p, regexp_matches(p, '\\S') AND coalesce(list_min(list_transform(range(1, len(ds) + 1), lambda i: list_sum(list_slice(ds, 1, i)))), 0) >= 0 AS inside FROM d""")
def path_containment(spark, sf_dir):
    tail = F.regexp_replace(F.regexp_replace("url", "^https?://[^/]*/", ""), "[?#].*$", "")
    k = F.col("page_id")
    p = F.concat(F.when(k % 4 == 0, "").when(k % 4 == 1, "../").when(k % 4 == 2, "a/b/../").otherwise("./x/../../"), tail,
                 F.when(k % 3 == 0, "/../..").otherwise(""))
    return table(spark, sf_dir, "pages").select("page_id", p.alias("p"), paths.is_within_root(p, "/srv/code").alias("inside"))


@query("""WITH v AS (SELECT p_partkey, concat(p_size, '.', p_partkey % 100, CASE p_partkey % 5 WHEN 0 THEN '' ELSE concat('.', p_partkey % 7) END,
  CASE p_partkey % 6 WHEN 0 THEN '-rc.1' WHEN 1 THEN '+b.2' WHEN 2 THEN '-a+b' WHEN 3 THEN '_x' ELSE '' END) AS version FROM part)
SELECT p_partkey, version, regexp_matches(version, '^[0-9]+\\.[0-9]+\\.[0-9]+(-[0-9A-Za-z.-]+)?(\\+[0-9A-Za-z.-]+)?$') AS valid FROM v""")
def semantic_versions(spark, sf_dir):
    k = F.col("p_partkey")
    version = F.concat(F.col("p_size").cast("string"), F.lit("."), (k % 100).cast("string"),
                       F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("."), (k % 7).cast("string"))),
                       F.when(k % 6 == 0, "-rc.1").when(k % 6 == 1, "+b.2").when(k % 6 == 2, "-a+b").when(k % 6 == 3, "_x").otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", version.alias("version"), paths.is_semver(version).alias("valid"))
