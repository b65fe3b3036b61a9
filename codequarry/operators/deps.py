"""Dependencies from manifests. A parser is a Column expression text -> array of
(name, version, scope); one pass over the files picks the parser by file name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import params, rules
from ..functions import paths, text
from ..functions.regex import extract, extract_all, let, matches
from ..plans.corpus import inventory

DEPS = "array<struct<name:string,version:string,scope:string>>"
SECTIONS = ["dependencies", "devDependencies", "peerDependencies", "optionalDependencies"]


def _none_if_empty(col: Column) -> Column:
    return F.nullif(text.strip(col), F.lit(""))


def _entries(line_array: Column, pattern: str, name: int, version: int, clean: Callable[[Column], Column]) -> Column:
    """Lines that match become (name, version)."""
    kept = F.filter(line_array, lambda line: matches(line, pattern))
    return F.transform(kept, lambda line: F.struct(
        extract(line, pattern, name).alias("name"), clean(extract(line, pattern, version)).alias("version"),
        F.lit(None).cast("string").alias("scope"))).cast(DEPS)


def _pairs(section: Column, pattern: str, clean: Callable[[Column], Column]) -> Column:
    names, versions = extract_all(section, pattern, 1, flags="m"), extract_all(section, pattern, 2, flags="m")
    return F.zip_with(names, versions, lambda n, v: F.struct(
        n.alias("name"), clean(v).alias("version"), F.lit(None).cast("string").alias("scope"))).cast(DEPS)


def _one_break(body: Column) -> Column:
    return F.regexp_replace(body, r"\r\n|[" + rules.LINE_BREAKS + "]", "\n")


def package_json(body: Column) -> Column:
    """Null when the text is not a JSON object. Sections keep file order."""
    shape = ", ".join(f"{s} MAP<STRING,STRING>" for s in SECTIONS)
    parsed = F.from_json(body, shape)

    def section(row, name):
        # a repeated key keeps its first place and its last value
        return let(F.map_entries(row[name]), lambda pairs: F.transform(F.array_distinct(F.transform(pairs, lambda e: e["key"])), lambda key: F.struct(
            key.alias("name"), F.coalesce(F.element_at(F.filter(pairs, lambda e: e["key"] == key), -1)["value"], F.lit("None")).alias("version"),
            F.lit(name).alias("scope"))))

    rows = let(parsed, lambda row: F.flatten(F.array(*[
        F.coalesce(section(row, s), F.array().cast(DEPS)) for s in SECTIONS])))
    return F.when(F.from_json(body, "MAP<STRING,STRING>").isNotNull(), rows).cast(DEPS)


def requirements_txt(body: Column) -> Column:
    stripped = F.transform(text.lines(body), text.strip)
    return _entries(F.filter(stripped, lambda x: ~x.startswith("#") & ~x.startswith("-")),
                    r"^([A-Za-z0-9_.-]+)\s*(?:\[[^\]]*\])?\s*(.*)", 1, 2, _none_if_empty)


def pyproject_toml(body: Column) -> Column:
    body = F.regexp_replace(body, r"\r\n?", "\n")
    listed = extract(body, rules.PYPROJECT_DEPENDENCIES, 1, flags="ms")
    poetry = extract(body, rules.POETRY_DEPENDENCIES, 1, flags="ms")
    table = _pairs(poetry, r"^([A-Za-z0-9_.-]+)\s*=\s*[\"']?([^\s\"']+)", lambda v: v)
    return F.concat(_pairs(listed, r"[\"']([A-Za-z0-9_.-]+)([^\"']*)[\"']", _none_if_empty),
                    F.filter(table, lambda d: F.lower(d["name"]) != "python"))


def go_mod(body: Column) -> Column:
    """``require`` blocks and single lines, in file order."""
    pieces = extract_all(_one_break(body), r"^[^\S\n]*require \(.*?(?:^[^\S\n]*\)[^\S\n]*$|\Z)|^[^\S\n]*require [^\n]*", 0, flags="ms")
    candidates = F.flatten(F.transform(pieces, lambda piece: let(
        F.transform(F.split(piece, "\n"), text.strip),
        lambda rows: F.when(rows[0].startswith("require ("), F.slice(rows, F.lit(2), F.size(rows)))
        .otherwise(F.transform(rows, lambda r: F.substring(r, 9, 2147483647))))))
    candidates = F.filter(candidates, lambda c: ~c.startswith("require ("))
    return _entries(candidates, r"^(\S+)\s+(v\S+)", 1, 2, lambda v: v)


def cargo_toml(body: Column) -> Column:
    header = r"^[^\S\n]*\[(?:dependencies|dev-dependencies|build-dependencies)\][^\S\n]*$"
    sections = extract_all(_one_break(body), header + r"(.*?)(?=^[^\S\n]*\[|\Z)", 1, flags="ms")
    rows = F.flatten(F.transform(sections, lambda s: F.transform(F.split(s, "\n"), text.strip)))
    return _entries(rows, r"^([A-Za-z0-9_-]+)\s*=\s*(.+)", 1, 2, lambda v: F.btrim(text.strip(v), F.lit('"')))


# file name -> (ecosystem, parser); callers may add entries
PARSERS: dict[str, tuple[str, Callable[[Column], Column]]] = {
    "package.json": ("npm", package_json),
    "requirements.txt": ("pypi", requirements_txt),
    "pyproject.toml": ("pypi", pyproject_toml),
    "go.mod": ("go", go_mod),
    "Cargo.toml": ("cargo", cargo_toml),
}


def parsed_manifests(files: DataFrame, max_files: int | None = None, parsers=None) -> DataFrame:
    """repo, file, ecosystem, deps (array; null when the manifest cannot be parsed)."""
    parsers = parsers or PARSERS
    name = paths.base_name(F.col("path"))
    body = text.text_of(F.col("content"))
    ecosystem = deps = None
    for key, (eco, parse) in parsers.items():
        ecosystem = F.when(name == key, eco) if ecosystem is None else ecosystem.when(name == key, eco)
        deps = F.when(name == key, parse(body)) if deps is None else deps.when(name == key, parse(body))
    return (inventory(files, max_files).filter(name.isin(list(parsers)))
            .select("repo", F.col("path").alias("file"), "walk_key", ecosystem.alias("ecosystem"), deps.alias("deps")))


def parse_errors(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("deps").isNull()).select("repo", "file", F.lit("ValueError").alias("error"))


def dependencies(parsed: DataFrame, max_per_manifest: int | None = None) -> DataFrame:
    """repo, file, ecosystem, pos, name, version, scope in manifest order."""
    params.int_in(max_per_manifest, 1, params.NO_LIMIT, "max_per_manifest")
    rows = parsed.select("repo", "file", "ecosystem", F.posexplode("deps").alias("pos", "d"))
    if max_per_manifest is not None:
        rows = rows.filter(F.col("pos") < max_per_manifest)
    return rows.select("repo", "file", "ecosystem", "pos", "d.name", "d.version", "d.scope")


def manifest_summary(parsed: DataFrame, max_per_manifest: int | None = None) -> DataFrame:
    """One row per parsed manifest: how many dependencies, and whether the cap cuts some off."""
    n = F.size("deps")
    reached = F.lit(False) if max_per_manifest is None else n > max_per_manifest
    return parsed.filter(F.col("deps").isNotNull()).select(
        "repo", "file", "ecosystem", n.alias("dependency_count"), reached.alias("dependency_limit_reached"))


def dependency_inventory(parsed: DataFrame, max_per_manifest: int | None = None) -> DataFrame:
    """Per repo: manifests, errors, all dependencies, and distinct ecosystem:name of the kept ones."""
    params.int_in(max_per_manifest, 1, params.NO_LIMIT, "max_per_manifest")
    kept = F.col("deps") if max_per_manifest is None else F.slice("deps", 1, max_per_manifest)
    keys = F.transform(kept, lambda d: F.concat(F.col("ecosystem"), F.lit(":"), F.lower(d["name"])))
    rows = parsed.select("repo", F.coalesce(F.size("deps"), F.lit(0)).alias("n"), F.col("deps").isNull().alias("bad"),
                         F.posexplode_outer(F.array_distinct(keys)).alias("i", "key"))
    first = F.coalesce(F.col("i"), F.lit(0)) == 0
    return rows.groupBy("repo").agg(
        F.count_if(first & ~F.col("bad")).alias("manifest_count"), F.count_if(first & F.col("bad")).alias("parse_errors"),
        F.coalesce(F.sum(F.when(first & ~F.col("bad"), F.col("n"))), F.lit(0)).cast("bigint").alias("total_dependencies"),
        F.count_distinct("key").alias("unique_dependencies"))


def sbom_components(parsed: DataFrame, max_per_manifest: int | None = None) -> DataFrame:
    """Component rows of the bill of materials."""
    rows = dependencies(parsed, max_per_manifest)
    return rows.select("repo", F.col("file").alias("manifest"), "pos", F.lit("library").alias("type"), "name", "version",
                       F.coalesce("scope", F.lit("required")).alias("scope"), "ecosystem")
