"""Path predicates and keys, all plain Column expressions (no file content is read)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules
from .regex import extract, let, matches
from .text import fold_case


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(path: Column) -> Column:
    """Last extension, lower-cased; ``.env`` has none."""
    return F.lower(F.regexp_extract(base_name(path), r"(?s)^.+(\.[^.]+)$", 1))


def walk_key(path: Column) -> Column:
    """A string whose plain order is the depth-first order: the files of a directory by folded
    name, then each sub-directory. ``\\x01`` marks a file and ``\\x02`` a directory."""
    marked = F.regexp_replace(fold_case(path), r"([^/]+)$", "\u0001$1")
    return F.regexp_replace(marked, "([^/\u0001]+)/", "\u0002$1")


def breadth_key(path: Column) -> Column:
    """With the depth in front: breadth-first order."""
    return F.replace(fold_case(path), F.lit("/"), F.lit("\u0001"))


def depth(path: Column) -> Column:
    return (F.octet_length(path) - F.octet_length(F.replace(path, F.lit("/"), F.lit("")))).cast("int")


def _any_part(path: Column, names) -> Column:
    return path.rlike("(?:^|/)(?:" + "|".join(re.escape(n) for n in names) + ")(?:/|$)")


def not_ignored(path: Column) -> Column:
    """No component, file names included, is on the ignore list."""
    return ~_any_part(path, rules.IGNORED_NAMES)


def is_protected(path: Column) -> Column:
    return _any_part(path, rules.PROTECTED_NAMES)


def is_manifest(path: Column) -> Column:
    return base_name(path).isin(rules.MANIFEST_NAMES)


def is_lockfile(path: Column) -> Column:
    return base_name(path).isin(rules.LOCKFILE_NAMES)


def is_ci(path: Column) -> Column:
    return matches(path, rules.CI_PATTERN, True)


def is_test(path: Column) -> Column:
    return matches(path, rules.TEST_PATTERN, True)


def is_infrastructure(path: Column) -> Column:
    return matches(path, rules.INFRASTRUCTURE_PATTERN, True)


def is_sensitive_path(path: Column) -> Column:
    """Inventory rule: ``.env`` and ``.env.*``, exact-case template names exempt."""
    return matches(path, rules.SENSITIVE_PATH_PATTERN, True) & ~base_name(path).isin(rules.ENV_TEMPLATE_NAMES)


def is_sensitive_file(path: Column) -> Column:
    """Scan rule: ``.env`` only, template names exempt in any case."""
    return matches(path, rules.SENSITIVE_FILE_PATTERN, True) & ~F.lower(base_name(path)).isin(rules.ENV_TEMPLATE_NAMES)


def is_write_sensitive(path: Column) -> Column:
    name = base_name(path)
    return matches(name, rules.WRITE_SENSITIVE_PATTERN, True) & ~name.isin(rules.ENV_TEMPLATE_NAMES)


def entropy_skipped(path: Column) -> Column:
    return suffix(path).isin(rules.ENTROPY_IGNORED_SUFFIXES)


def is_semver(text: Column) -> Column:
    return matches(text, r"^(?:" + rules.SEMVER_PATTERN + r")\Z")


def root_document(path: Column, name: str) -> Column:
    return path == F.lit(name)


def named_language(path: Column) -> Column:
    """Language of the three extension-less names, else null."""
    name, out = F.lower(base_name(path)), None
    for key, language in rules.LANGUAGE_BY_NAME.items():
        out = F.when(name == key, language) if out is None else out.when(name == key, language)
    return out


def _normal_parts(path: Column) -> Column:
    parts = F.filter(F.split(path, "/"), lambda x: ~x.isin("", "."))
    empty = F.array().cast("array<string>")
    return F.aggregate(
        parts, empty,
        lambda acc, x: F.when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(x))))


def is_within_root(path: Column, root: str) -> Column:
    """Does the path, taken from ``root`` unless absolute, stay inside it once dots are resolved?"""
    base = [p for p in root.split("/") if p]
    full = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(root + "/"), path))
    inside = let(_normal_parts(full), lambda parts: F.slice(parts, 1, len(base)) == F.array(*[F.lit(p) for p in base]))
    sane = matches(path, r"\S") & ~path.contains("\u0000") & (F.length(path) <= 4096)
    return F.coalesce(sane & inside, F.lit(False))


def resolved_path(path: Column) -> Column:
    """The relative path with ``.`` and ``..`` resolved."""
    return F.array_join(_normal_parts(path), "/")


def first_group(text: Column, pattern: str, flags: str = "") -> Column:
    return extract(text, pattern, 1, flags=flags)
