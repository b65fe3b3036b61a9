"""Views that turn the driver tables into the operators' input tables.

``files`` is built from every document and its whole text. The path comes from ``doc_id`` so
that (repo, path) is unique, and a last line is added by ``doc_id`` so that every content rule
has something to find. The Spark and the SQL form share one template.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codequarry.session import new_path

from .registry import table

_NAME = """CASE doc_id % 11 WHEN 0 THEN 'package.json' WHEN 1 THEN 'requirements.txt' WHEN 2 THEN 'yarn.lock'
  WHEN 3 THEN 'secrets.yaml' WHEN 4 THEN '.env.example' WHEN 5 THEN 'README.md'
  ELSE concat('f', CAST(doc_id AS {text}), CASE doc_id % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.ts'
                                                         WHEN 2 THEN '.go' ELSE '.bin' END) END"""
_PATH = """concat(CASE WHEN doc_id < 220 THEN '' ELSE concat('m', CAST(doc_id {div} 220 AS {text}), '/') END,
  CASE doc_id % 5 WHEN 0 THEN 'src/' WHEN 1 THEN 'tests/unit/' WHEN 2 THEN 'docs/'
                  WHEN 3 THEN '.github/workflows/' ELSE '' END, """ + _NAME + ")"
_HASH = "md5(CAST(doc_id AS {text}))"
_LAST_LINE = f"""CASE doc_id % 13
  WHEN 0 THEN concat(chr(10), '// TODO check ', CAST(doc_id AS {{text}}), chr(10), 'see debug, then todo', chr(10))
  WHEN 1 THEN concat(chr(10), '# FIXME or XXX', chr(10), 'hack')
  WHEN 2 THEN concat(chr(10), 'id = AK', 'IA', upper(left({_HASH}, 16)), ' end')
  WHEN 3 THEN concat(chr(10), 'auth gh', 'p_', {_HASH})
  WHEN 4 THEN concat(chr(10), repeat('if (a && b || c) while elif for case ', 8))
  WHEN 5 THEN concat(chr(10), 's', 'k-', {_HASH}, ' and xo', 'xb-', {_HASH})
  WHEN 6 THEN concat(chr(10), 'fetch https://user:', left({_HASH}, 8), '@example.com/x')
  WHEN 7 THEN concat(chr(10), 'ey', 'J', {_HASH}, '.', {_HASH}, '.', {_HASH})
  WHEN 8 THEN concat(chr(10), '-----BEGIN RSA', ' PRIVATE KEY-----')
  WHEN 9 THEN concat(chr(10), 'Pass', 'word: "', {_HASH}, '"', chr(10), chr(10))
  ELSE '' END"""

_DIALECT = {"spark": {"text": "string", "div": "div", "bytes": "octet_length"},
            "duck": {"text": "varchar", "div": "//", "bytes": "strlen"}}


def _files_select(dialect: str, source: str) -> str:
    d = _DIALECT[dialect]
    path, last = _PATH.format(**d), _LAST_LINE.format(**d)
    return (f"SELECT doc_id, source AS repo, {path} AS path, concat(text, {last}) AS content, "
            f"CAST({d['bytes']}(concat(text, {last})) AS bigint) AS size_bytes FROM {source}")


_STORED: dict[tuple[str, str, str], str] = {}


def ingested(spark: SparkSession, sf_dir: str, name: str, make) -> DataFrame:
    """What ``make`` derives from the driver tables, written once in a session as an operator's input table would be. Row groups are small, so
    that work on contents is spread over tasks however the driver's files are cut."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED:
        path = new_path(spark, name)
        make().write.option("parquet.block.size", 2 << 20).parquet(path)
        _STORED[key] = path
    return spark.read.parquet(_STORED[key])


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a file, ingested."""
    return ingested(spark, sf_dir, "files", lambda: files_from(spark, table(spark, sf_dir, "documents")))


def files_from(spark: SparkSession, documents: DataFrame) -> DataFrame:
    return spark.sql(_files_select("spark", "{docs}"), docs=documents)


FILES = f"files AS ({_files_select('duck', 'documents')})"

IGNORED = r"(^|/)(\.git|\.hg|\.svn|\.venv|venv|node_modules|vendor|dist|build|coverage|target|__pycache__|\.sdlc)(/|$)"
# files that the walk keeps, with their walk key
SEEN = FILES + rf""", seen AS (SELECT *, string_split(path, '/')[-1] AS name,
  regexp_replace(regexp_replace(lower(path), '([^/]+)$', chr(1) || '\1'), '([^/' || chr(1) || ']+)/', chr(2) || '\1', 'g') AS wk
  FROM files WHERE NOT regexp_matches(path, '{IGNORED}'))"""
BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
# arrays of lines per file, and one row per line
PIECES = SEEN + rf""", pieces AS (SELECT *, regexp_split_to_array(content, '{BREAKS}') AS p FROM seen),
 arrays AS (SELECT * EXCLUDE (p), CASE WHEN p[-1] = '' THEN list_slice(p, 1, len(p) - 1) ELSE p END AS ls FROM pieces)"""
LINES = PIECES + """, lines AS (SELECT repo, path, wk, name, doc_id, size_bytes, unnest(ls) AS l,
  unnest(range(1, len(ls) + 1)) AS line FROM arrays)"""

CI = r"(^|/)(?:\.github/workflows/|\.circleci/)|\.gitlab-ci|azure-pipelines|Jenkinsfile|buildkite"
TEST = r"(^|/)(?:test|tests|spec|__tests__)(?:/|$)|\.(?:test|spec)\.[^.]+$"
INFRA = (r"(^|/)(?:terraform|k8s|kubernetes|helm|ansible|\.github/workflows)(?:/|$)"
         r"|(^|/)(?:Dockerfile|docker-compose\.ya?ml|compose\.ya?ml)$")
SENSITIVE_PATH = r"(^|/)\.env(?:$|\.)|(^|/)(?:secrets?|credentials?)(?:/|[_.-]|$)"
SENSITIVE_FILE = r"(^|/)\.env$|(^|/)(?:secrets?|credentials?)(?:/|[_.-]|$)"
TEMPLATES = "('.env.example', '.env.sample', '.env.template', '.env.defaults')"
MANIFESTS = """('package.json', 'pnpm-workspace.yaml', 'pyproject.toml', 'requirements.txt', 'Pipfile', 'poetry.lock',
 'go.mod', 'Cargo.toml', 'pom.xml', 'build.gradle', 'build.gradle.kts', 'Gemfile', 'composer.json', 'Dockerfile',
 'docker-compose.yml', 'compose.yml', 'Makefile')"""
LOCKFILES = """('package-lock.json', 'npm-shrinkwrap.json', 'yarn.lock', 'pnpm-lock.yaml', 'poetry.lock', 'Pipfile.lock',
 'Cargo.lock', 'go.sum', 'Gemfile.lock', 'composer.lock', 'gradle.lockfile')"""
# RE2 patterns: (id, pattern, options)
SIGNATURES = [
    ("private-key", r"-----BEGIN (?:RSA|EC|OPENSSH|DSA|PGP) PRIVATE KEY-----", ""),
    ("github-token", r"\bgh[pousr]_[A-Za-z0-9_]{20,}\b", ""),
    ("openai-key", r"\bsk-[A-Za-z0-9_-]{20,}\b", ""),
    ("aws-access-key", r"\bAKIA[0-9A-Z]{16}\b", ""),
    ("slack-token", r"\bxox[baprs]-[A-Za-z0-9-]{10,}\b", ""),
    ("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\b", ""),
    ("url-basic-auth", r"[a-z][a-z0-9+.-]*://[^\s/:@]+:[^\s/@]+@", "i"),
    ("generic-secret-assignment",
     r"""\b(?:api[_-]?key|secret|password|passwd|token)\b\s*[:=]\s*['"][^'"\s]{16,}['"]""", "i"),
]


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def sql_first_rule(col: str) -> str:
    return "CASE " + " ".join(
        f"WHEN regexp_matches({col}, {_quoted(p)}, '{o or 'c'}') THEN '{n}'" for n, p, o in SIGNATURES) + " END"


def sql_redact(col: str) -> str:
    for n, p, o in SIGNATURES:
        col = f"regexp_replace({col}, {_quoted(p)}, '[REDACTED:{n}]', 'g{o}')"
    return col


def sql_matches(col: str, pattern: str, ignore_case: bool = True) -> str:
    return f"regexp_matches({col}, {_quoted(pattern)}, '{'i' if ignore_case else 'c'}')"
