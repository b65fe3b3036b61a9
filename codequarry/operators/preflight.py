"""Rules over plugins: manifest, skills, contracts and bundled commands.

``files(repo, path, content, size_bytes)`` holds many plugins, one per repo. Each rule family is a
filter on the few files it concerns; findings are unioned and counted per repo.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import paths, text
from ..functions.audit import json_field
from ..functions.regex import extract, matches
from ..plans.corpus import exploded

MANIFEST = ".codex-plugin/plugin.json"
SKILLS, COMMANDS = "skills/", "scripts/commands/"
CONTRACT_FIELDS = ["schemaVersion", "name", "version", "summary"]


def _kind(v: Column, name: str) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant")), F.lit("VOID"))


def _is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def _truthy(v: Column, name: str) -> Column:
    raw = json_field(v, name)
    return raw.isNotNull() & ~raw.isin("false", "0", "0.0", '""', "[]", "{}")


def _string(v: Column, name: str) -> Column:
    return F.when(_kind(v, name) == "STRING", F.try_variant_get(v, f"$.{name}", "string"))


def _finding(condition: Column, severity: str, identifier: str, detail: Column | None = None) -> Column:
    detail = F.lit(None).cast("string") if detail is None else detail
    return F.when(condition, F.struct(F.lit(severity).alias("severity"), F.lit(identifier).alias("id"), detail.alias("detail")))


def _rows(df: DataFrame, findings: list[Column], file: Column) -> DataFrame:
    found = exploded(df.withColumn("file", file), ["repo", "file"], F.array_compact(F.array(*findings)))
    return found.select("repo", "item.severity", "item.id", "file", "item.detail")


def _universal(content: Column) -> Column:
    return F.regexp_replace(text.text_of(content), r"\r\n?", "\n")


def _no(flag: Column) -> Column:
    return ~F.coalesce(flag, F.lit(False))


def plugin_state(files: DataFrame) -> DataFrame:
    """One row per plugin: manifest text and whether skills exist. Every plugin has a row."""
    p = F.col("path")
    skill = p.startswith(SKILLS)
    return files.groupBy("repo").agg(
        F.max(F.when(p == MANIFEST, text.text_of(F.col("content")))).alias("manifest"),
        F.max(skill).alias("has_skills"),
        F.max(skill & (paths.base_name(p) == "SKILL.md") & paths.not_ignored(p)).alias("has_skill_files"))


def _manifest_findings(state: DataFrame) -> DataFrame:
    m = F.col("v")
    interface = F.try_variant_get(m, "$.interface", "variant")
    prompts_kind = _kind(interface, "defaultPrompt")
    prompts = F.when(prompts_kind.startswith("ARRAY"), F.try_variant_get(interface, "$.defaultPrompt", "array<variant>")) \
        .when(F.to_json(F.try_variant_get(interface, "$.defaultPrompt", "variant")).isNotNull(),
              F.array(F.try_variant_get(interface, "$.defaultPrompt", "variant")))
    long_prompt = F.exists(prompts, lambda x: (F.schema_of_variant(x) == "STRING") & (F.length(x.cast("string")) > 128))
    parsed = state.withColumn("v", F.try_parse_json("manifest"))
    ok = _is_object(m)
    version = _string(m, "version")
    complete = _is_object(interface) & _truthy(interface, "displayName") & _truthy(interface, "shortDescription")
    return _rows(parsed, [
        _finding(F.col("manifest").isNull(), "error", "manifest-missing"),
        _finding(F.col("manifest").isNotNull() & ~ok, "error", "manifest-invalid-json"),
        _finding(ok & _no(_string(m, "name") == paths.base_name(F.col("repo"))), "error", "manifest-name"),
        _finding(ok & _no(paths.is_semver(version)), "error", "manifest-version"),
        _finding(ok & _no(complete), "error", "manifest-interface"),
        _finding(ok & (F.size(prompts) > 3), "warning", "prompt-count"),
        _finding(ok & long_prompt, "warning", "prompt-length"),
    ], F.lit(MANIFEST)).unionByName(_rows(state, [
        _finding(_no(F.col("has_skills")), "error", "skills-missing"),
        _finding(F.col("has_skills") & _no(F.col("has_skill_files")), "error", "skills-empty"),
    ], F.lit(SKILLS)))


def skills(files: DataFrame) -> DataFrame:
    """Skill files with their front matter: body, name and description (null where absent)."""
    p = F.col("path")
    found = files.filter(p.startswith(SKILLS) & (paths.base_name(p) == "SKILL.md") & paths.not_ignored(p))
    body = _universal(F.col("content"))
    front = rules.FRONT_MATTER
    listed = found.select("repo", "path", body.alias("body")).withColumn(
        "front", F.when(matches(F.col("body"), front, flags="s"), extract(F.col("body"), front, 1, flags="s")))
    name, description = r"^name:\s*[\"']?(?P<name>[a-z0-9-]+)[\"']?\s*$", r"^description:\s*[\"']?(?P<description>.+?)[\"']?\s*$"
    return listed.select(
        "repo", "path", F.regexp_replace("path", "/[^/]+$", "").alias("dir"), "front",
        matches(F.col("body"), r"\[TODO:\s*").alias("has_todo"),
        F.nullif(extract(F.col("front"), name, 1, flags="m"), F.lit("")).alias("name"),
        F.nullif(extract(F.col("front"), description, 1, flags="m"), F.lit("")).alias("description"))


def _skill_findings(found: DataFrame) -> DataFrame:
    named = F.col("name").isNotNull() & F.col("description").isNotNull()
    place = F.struct(paths.walk_key(F.col("path")).alias("k"), F.col("path").alias("p"))
    first = found.filter(named).groupBy("repo", "name").agg(F.min(place).alias("first"), F.count("*").alias("uses")).filter("uses > 1")
    marked = found.join(first, ["repo", "name"], "left")
    return _rows(marked, [
        _finding(F.col("has_todo"), "error", "skill-todo"),
        _finding(F.col("front").isNull(), "error", "skill-frontmatter"),
        _finding(F.col("front").isNotNull() & ~named, "error", "skill-metadata"),
        _finding(named & F.col("first").isNotNull() & (place > F.col("first")), "error", "skill-duplicate-name", F.col("name")),
        _finding(named & (F.col("name") != paths.base_name(F.col("dir"))), "warning", "skill-directory-name"),
    ], F.col("path"))


def _contract_findings(files: DataFrame, found: DataFrame) -> DataFrame:
    usable = found.filter("name IS NOT NULL AND description IS NOT NULL").select("repo", "dir", "name")
    contract = files.filter(paths.base_name(F.col("path")) == "contract.json").select(
        "repo", F.regexp_replace("path", "/[^/]+$", "").alias("dir"), text.text_of(F.col("content")).alias("text"))
    joined = usable.join(contract, ["repo", "dir"], "left").withColumn("v", F.try_parse_json("text"))
    v, ok, c = F.col("v"), _is_object(F.col("v")), F.col
    present = lambda field: F.to_json(F.try_variant_get(v, f"$.{field}", "variant")).isNotNull()
    c_name = _string(v, "name")

    def strings(field):  # null, or an array of strings only
        items = F.try_variant_get(v, f"$.{field}", "array<variant>")
        good = _kind(v, field).startswith("ARRAY") & F.forall(items, lambda x: F.schema_of_variant(x) == "STRING")
        return json_field(v, field).isNull() | F.coalesce(good, F.lit(False))

    path = F.concat("dir", F.lit("/contract.json"))
    direct = _rows(joined, [
        _finding(c("text").isNull(), "warning", "contract-missing"),
        _finding(c("text").isNotNull() & ~ok, "error", "contract-invalid-json"),
        *[_finding(ok & ~present(f), "error", "contract-field", F.lit(f)) for f in CONTRACT_FIELDS],
        _finding(ok & (c_name != paths.base_name(c("dir"))), "error", "contract-name"),
        _finding(ok & (c_name != c("name")), "error", "contract-name-mismatch"),
        _finding(ok & present("version") & _no(paths.is_semver(_string(v, "version"))), "error", "contract-version"),
        _finding(ok & ~strings("toolsUsed"), "error", "contract-tools"),
        _finding(ok & json_field(v, "safety").isNotNull() & ~_kind(v, "safety").startswith("OBJECT"), "error", "contract-safety"),
        _finding(ok & ~strings("evalPrompts"), "error", "contract-eval"),
    ], path)
    prompts = joined.filter(ok & strings("evalPrompts") & json_field(v, "evalPrompts").isNotNull()).select(
        "repo", path.alias("file"), "dir", F.explode(F.try_variant_get(v, "$.evalPrompts", "array<string>")).alias("relative"))
    prompts = prompts.withColumn("path", paths.resolved_path(F.concat("dir", F.lit("/"), "relative")))
    missing = prompts.join(files.select("repo", "path"), ["repo", "path"], "left_anti").select(
        "repo", F.lit("warning").alias("severity"), F.lit("contract-eval-missing").alias("id"), "file", F.col("relative").alias("detail"))
    return direct.unionByName(missing)


def _command_findings(files: DataFrame) -> DataFrame:
    p = F.col("path")
    code, body = files.filter(p.startswith(COMMANDS)).select("repo", "path", _universal(F.col("content")).alias("body")), F.col("body")
    ids = F.concat(
        F.transform(text.all_rules(body, rules.DANGEROUS_COMMANDS), lambda x: F.struct(x.alias("id"), F.lit(None).cast("string").alias("detail"))),
        F.transform(text.all_rules(body, rules.SECRET_SIGNATURES), lambda x: F.struct(F.lit("potential-secret").alias("id"), x.alias("detail"))))
    return exploded(code.withColumnRenamed("path", "file"), ["repo", "file"], ids).select(
        "repo", F.lit("error").alias("severity"), "item.id", "file", "item.detail")


def preflight_findings(files: DataFrame) -> DataFrame:
    """repo, severity, id, file, detail."""
    found = skills(files)
    return (_manifest_findings(plugin_state(files)).unionByName(_skill_findings(found))
            .unionByName(_contract_findings(files, found)).unionByName(_command_findings(files)))


def plugin_preflight(files: DataFrame) -> DataFrame:
    """Per plugin: errors, warnings, info and pass or fail."""
    n = preflight_findings(files).groupBy("repo").agg(
        F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"),
        F.count_if(F.col("severity") == "info").alias("info"))
    out = files.select("repo").distinct().join(n, "repo", "left").fillna(0, ["errors", "warnings", "info"])
    return out.withColumn("status", F.when(F.col("errors") == 0, "pass").otherwise("fail"))
