"""Secret, entropy and search queries."""

from pyspark.sql import functions as F

from codequarry.operators import scan
from codequarry.sinks import documents

from .registry import query
from .views import LINES, PIECES, SEEN, SENSITIVE_FILE, TEMPLATES, files, sql_first_rule, sql_matches, sql_redact

NOTE = scan.SENSITIVE_NOTE
_NAMED = f"({sql_matches('path', SENSITIVE_FILE)} AND lower(name) NOT IN {TEMPLATES})"
_FINDINGS = LINES + f""", hits AS (
  SELECT repo, path, wk, line, l, {sql_first_rule('l')} AS signature FROM lines WHERE NOT {_NAMED}),
 findings AS (
  SELECT repo, path AS file, wk, line, signature, left({sql_redact("trim(l, ' ' || chr(9))")}, 300) AS preview
  FROM hits WHERE signature IS NOT NULL
  UNION ALL SELECT repo, path, wk, NULL, 'sensitive-file', '{NOTE}' FROM seen WHERE {_NAMED})"""


@query(f"WITH {_FINDINGS} SELECT repo, file, line, signature, preview FROM findings")
def secret_findings(spark, sf_dir):
    return scan.secret_findings(files(spark, sf_dir))


@query(f"""WITH {_FINDINGS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY wk, file, line) AS pos FROM findings)
SELECT repo, file, line, signature, preview, pos FROM ranked WHERE pos <= 5""")
def secret_findings_capped(spark, sf_dir):
    return scan.secret_findings(files(spark, sf_dir), max_findings=5)


@query(f"""WITH {_FINDINGS}, n AS (SELECT repo, count(*) AS c FROM findings GROUP BY repo)
SELECT s.repo, count(*) FILTER (WHERE NOT {_NAMED}) AS files_scanned, coalesce(max(n.c), 0) AS finding_count,
 false AS findings_limit_reached, CASE WHEN coalesce(max(n.c), 0) > 0 THEN 'warning' ELSE 'pass' END AS status
FROM seen s LEFT JOIN n USING (repo) GROUP BY s.repo""")
def secret_scan_summary(spark, sf_dir):
    return scan.secret_scan(files(spark, sf_dir))


@query(f"""WITH {_FINDINGS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY wk, file, line) AS pos FROM findings),
 stop AS (SELECT repo, wk, file FROM ranked WHERE pos = 5), n AS (SELECT repo, least(count(*), 5) AS c FROM findings GROUP BY repo)
SELECT s.repo, count(*) FILTER (WHERE NOT {_NAMED}
   AND (stop.wk IS NULL OR (s.wk, s.path) <= (stop.wk, stop.file))) AS files_scanned,
 coalesce(max(n.c), 0) AS finding_count, coalesce(max(n.c), 0) >= 5 AS findings_limit_reached,
 CASE WHEN coalesce(max(n.c), 0) > 0 THEN 'warning' ELSE 'pass' END AS status
FROM seen s LEFT JOIN n USING (repo) LEFT JOIN stop ON stop.repo = s.repo GROUP BY s.repo""")
def secret_scan_capped(spark, sf_dir):
    return scan.secret_scan(files(spark, sf_dir), max_findings=5)


@query(f"WITH {SEEN} SELECT repo, path, md5({sql_redact('content')}) AS content_md5 FROM files")
def redacted_files(spark, sf_dir):
    return scan.redacted(files(spark, sf_dir)).select("repo", "path", F.md5("content").alias("content_md5"))


@query(f"WITH {_FINDINGS} SELECT repo, file, line, signature, preview FROM findings")
def sarif_documents(spark, sf_dir):
    """The documents are written and read back, so that their content is what is compared."""
    docs = documents.sarif(scan.secret_findings(files(spark, sf_dir)), per_document=20)
    place = "artifactLocation STRUCT<uri: STRING>, region STRUCT<startLine: INT>"
    result = f"ruleId STRING, message STRUCT<text: STRING>, locations ARRAY<STRUCT<physicalLocation: STRUCT<{place}>>>"
    back = F.from_json("document", f"runs ARRAY<STRUCT<results: ARRAY<STRUCT<{result}>>>>")
    rows = docs.select("repo", F.explode(back["runs"][0]["results"]).alias("r"))
    at = F.col("r.locations")[0]["physicalLocation"]
    return rows.select("repo", at["artifactLocation"]["uri"].alias("file"), at["region"]["startLine"].alias("line"),
                       F.col("r.ruleId").alias("signature"), F.col("r.message.text").alias("preview"))


# Tokens without lookaround: every character that is not a token character is doubled, so that
# neighbouring tokens do not share a delimiter; a leading space stands for the start of a line.
_C = r"A-Za-z0-9+/=_\-.~"
_IGNORED_EXT = r"\.(png|jpe?g|gif|bmp|ico|svg|webp|woff2?|ttf|eot|pyc|pyo|class|o|so|dll|lock|map|zip|tar|gz|bz2|xz|7z)$"
_TOKENS = LINES + rf""", kept AS (SELECT * FROM lines WHERE size_bytes > 0
   AND NOT regexp_matches(lower(name), '.{_IGNORED_EXT}')),
 runs AS (SELECT repo, path, wk, line, unnest(rs) AS r, unnest(range(0, len(rs))) AS tpos FROM (
   SELECT *, regexp_extract_all(regexp_replace(' ' || l || ' ', '([^{_C}])', '\1\1', 'g'), '[^{_C}][{_C}]+[^{_C}]') AS rs FROM kept)),
 ended AS (SELECT *, left(r, 1) AS d, r[2:-2] AS body FROM runs WHERE regexp_matches(right(r, 1), '[''"\s;,)}}]')),
 tokens AS (SELECT repo, path, wk, line, tpos, CASE WHEN regexp_matches(d, '[''":\s]') THEN body
   WHEN position('=' IN body) > 0 THEN substr(body, position('=' IN body) + 1) ELSE '' END AS token FROM ended),
 good AS (SELECT *, left(sha256(token), 16) AS token_hash, length(token) AS length FROM tokens WHERE length(token) >= 16),
 uniq AS (SELECT DISTINCT token FROM good), chars AS (SELECT token, unnest(string_split(token, '')) AS ch FROM uniq),
 cc AS (SELECT token, ch, count(*) AS c FROM chars GROUP BY token, ch),
 ent AS (SELECT token, -sum(c / length(token) * log2(c / length(token))) AS h FROM cc GROUP BY token),
 occ AS (SELECT g.*, e.h FROM good g JOIN ent e USING (token))"""
_PREVIEW = """CASE WHEN length <= 8 THEN left(token, 2) || '...' || right(token, 2)
 WHEN length <= 20 THEN left(token, 3) || '...' || right(token, 3) ELSE left(token, 4) || '...' || right(token, 4) END"""
_FIRST = _TOKENS + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY repo, token_hash ORDER BY wk, path, line, tpos) AS rn FROM occ),
 firsts AS (SELECT * FROM ranked WHERE rn = 1)"""


@query(f"""WITH {_TOKENS} SELECT repo, path, line, token_hash, {_PREVIEW} AS token_preview, length,
 CAST(format('{{:.3f}}', h) AS double) AS entropy FROM occ""")
def token_candidates(spark, sf_dir):
    found = scan.token_occurrences(files(spark, sf_dir))
    return found.select("repo", "path", "line", "token_hash", "token_preview", "length",
                        scan.text.round_to(F.col("entropy_bits"), 3).alias("entropy"))


@query(f"""WITH {_FIRST} SELECT repo, path AS file, line, {_PREVIEW} AS token_preview,
 CAST(format('{{:.3f}}', h) AS double) AS entropy, length, token_hash FROM firsts WHERE h >= 3.0""")
def entropy_findings(spark, sf_dir):
    return scan.entropy_findings(files(spark, sf_dir), entropy_threshold=3.0)


@query(f"""WITH {_FIRST}, n AS (SELECT repo, count(*) AS c FROM firsts WHERE h >= 3.0 GROUP BY repo)
SELECT s.repo, count(*) FILTER (WHERE size_bytes > 0 AND NOT regexp_matches(lower(name), '.{_IGNORED_EXT}')) AS files_scanned,
 coalesce(max(n.c), 0) AS finding_count, false AS findings_limit_reached,
 CASE WHEN coalesce(max(n.c), 0) > 0 THEN 'warning' ELSE 'pass' END AS status
FROM seen s LEFT JOIN n USING (repo) GROUP BY s.repo""")
def entropy_summary(spark, sf_dir):
    return scan.entropy_scan(files(spark, sf_dir), entropy_threshold=3.0)


_PAT = r"(?i)password|https?://|\bthe (?:of|on)\b"
_HITS = PIECES + rf""", hits AS (SELECT repo, path, wk, ls, unnest(list_filter(range(1, len(ls) + 1),
  lambda i: regexp_matches(ls[i], '{_PAT}'))) AS line FROM arrays)"""


def _shown(col: str) -> str:
    return f"left({sql_redact(col)}, 300)"


_CONTEXT = f"""SELECT repo, path AS file, line, {_shown('ls[line]')} AS text,
 coalesce(CASE WHEN line > 2 THEN {_shown('ls[line - 2]')} || chr(10) ELSE '' END || CASE WHEN line > 1 THEN {_shown('ls[line - 1]')} ELSE '' END, '') AS before,
 length({sql_redact('ls[line]')}) > 300 AS text_truncated, coalesce(CASE WHEN line + 1 <= len(ls) THEN {_shown('ls[line + 1]')} ELSE '' END || CASE WHEN line + 2 <= len(ls) THEN chr(10) || {_shown('ls[line + 2]')} ELSE '' END, '') AS after"""


def _joined(found):
    return found.drop("before_truncated", "after_truncated").withColumn("before", F.array_join("before", "\n")).withColumn("after", F.array_join("after", "\n"))


@query(f"WITH {_HITS} {_CONTEXT} FROM hits")
def search_context(spark, sf_dir):
    return _joined(scan.search_code(files(spark, sf_dir), _PAT, context_lines=2, line_chars=300))


@query(f"""WITH {_HITS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY wk, path, line) AS pos FROM hits
  WHERE regexp_matches(path, '\\.(py|go|md)$')) {_CONTEXT}, pos FROM ranked WHERE pos <= 10""")
def search_top_matches(spark, sf_dir):
    return _joined(scan.search_code(files(spark, sf_dir), _PAT, file_pattern=r"\.(py|go|md)$", max_results=10, context_lines=2, line_chars=300))


@query(f"""WITH {_HITS}, n AS (SELECT repo, count(*) AS c FROM hits GROUP BY repo)
SELECT s.repo, count(*) AS files_searched, coalesce(max(n.c), 0) AS match_count, false AS results_limit_reached
FROM seen s LEFT JOIN n USING (repo) GROUP BY s.repo""")
def search_summary(spark, sf_dir):
    return scan.search_summary(files(spark, sf_dir), _PAT)
