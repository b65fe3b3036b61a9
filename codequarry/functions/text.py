"""Content functions. Lines stay an array inside the row, so nothing is shuffled or exploded
until a rule has hit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules
from .regex import extract, extract_all, jvm, let, matches

# Substrings without which a signature cannot match. A substring test costs a small part of a
# regex pass, so most files and lines never reach the regex. Folded: looked up in folded text.
SECRET_LITERALS = {
    "private-key": ["PRIVATE KEY-----"], "github-token": ["ghp_", "gho_", "ghu_", "ghs_", "ghr_"], "openai-key": ["sk-"],
    "aws-access-key": ["AKIA"], "slack-token": ["xox"], "jwt": ["eyJ"], "url-basic-auth": ["://"],
}
SECRET_FOLDED = {"generic-secret-assignment": ["secret", "passw", "token", "key"]}


def text_of(content: Column) -> Column:
    """Decoded text of a STRING or BINARY column, bad sequences replaced by U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


def replaced_count(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit("�"), F.lit("")))).cast("int")


def is_binary(content: Column, head_bytes: int | None = None) -> Column:
    """NUL, or more than 30 % control bytes, in the file, or in its first ``head_bytes`` if a number is given."""
    raw = content.cast("binary")
    head = F.decode(raw if head_bytes is None else F.substring(raw, 1, head_bytes), "ISO-8859-1")

    def verdict(h):
        control = F.length(F.regexp_replace(h, r"[^\x00-\x08\x0e-\x1f]", ""))
        return h.contains("\u0000") | (control > rules.CONTROL_BYTE_RATIO * F.length(h))

    return F.coalesce(let(head, lambda h: F.when(h.rlike(r"[\x00-\x08\x0e-\x1f]"), verdict(h)).otherwise(False)),
                      F.lit(False))


def lines(text: Column) -> Column:
    """splitlines(): every Unicode line break, no trailing empty piece."""
    parts = F.split(text, r"\r\n|[" + rules.LINE_BREAKS + "]", -1)
    return let(parts, lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, F.lit(1), F.size(p) - 1)).otherwise(p))


def lines_kept(text: Column) -> Column:
    """splitlines() with the line ends kept."""
    other = "[^" + rules.LINE_BREAKS + "]"
    return F.regexp_extract_all(text, F.lit(f"{other}*(?:\\r\\n|[{rules.LINE_BREAKS}])|{other}+\\z"), F.lit(0))


def line_count(text: Column) -> Column:
    """Newlines, plus one for an unfinished last line."""
    newlines = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.when(text == "", 0).otherwise(newlines + F.when(text.endswith("\n"), 0).otherwise(1)).cast("bigint")


def strip(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, jvm(r"^\s+"), ""), jvm(r"\s+\Z"), "")


def preview(text: Column) -> Column:
    return F.left(text, F.lit(rules.LINE_PREVIEW))


def fold_case(text: Column) -> Column:
    """Lower case, plus the letters that only fold: ß, long s and final sigma."""
    for letter, folded in (("ß", "ss"), ("ſ", "s"), ("ς", "σ")):
        text = F.replace(F.lower(text) if letter == "ß" else text, F.lit(letter), F.lit(folded))
    return text


def contains_any(text: Column, words: list[str]) -> Column:
    return reduce(lambda acc, w: acc | w, [text.contains(w) for w in words])


def may_match(text: Column, rule: str) -> Column:
    """A cheap necessary condition for a built-in signature; true for any other rule."""
    if rule in SECRET_LITERALS:
        return contains_any(text, SECRET_LITERALS[rule])
    if rule in SECRET_FOLDED:
        return contains_any(text, ['"', "'"]) & let(fold_case(text), lambda f: contains_any(f, SECRET_FOLDED[rule]))
    return F.lit(True)


def first_rule(text: Column, signatures=rules.SECRET_SIGNATURES) -> Column:
    """Id of the first rule that matches, or null; later rules are not evaluated."""
    return F.coalesce(*[F.when(may_match(text, name) & matches(text, p, i), F.lit(name)) for name, p, i in signatures])


def all_rules(text: Column, signatures) -> Column:
    """Ids of every rule that matches, in rule order."""
    found = F.array(*[F.when(may_match(text, name) & matches(text, p, i), F.lit(name)) for name, p, i in signatures])
    return F.array_compact(found)


def has_secret_hint(text: Column) -> Column:
    return reduce(lambda acc, c: acc | c, [may_match(text, name) for name, _, _ in rules.SECRET_SIGNATURES])


def redact(text: Column, signatures=rules.SECRET_SIGNATURES) -> Column:
    """Replace every signature match by ``[REDACTED:id]``, in rule order."""
    for name, pattern, ignore_case in signatures:
        text = _masked(text, name, pattern, ignore_case)
    return text


def _masked(text: Column, name: str, pattern: str, ignore_case: bool) -> Column:
    return let(text, lambda t: F.when(
        may_match(t, name), F.regexp_replace(t, jvm(pattern, ignore_case), f"[REDACTED:{name}]")).otherwise(t))


def todo_kind(line: Column) -> Column:
    """First marker of the line in capitals, or an empty string."""
    return F.upper(extract(line, rules.TODO_PATTERN, 1, True))


def todo_kinds(text: Column, line_array: Column) -> Column:
    hinted = let(fold_case(text), lambda f: contains_any(f, ["todo", "xme", "hack", "xxx", "bug"]))
    kinds = F.filter(F.transform(line_array, todo_kind), lambda k: k != "")
    return F.when(hinted, kinds).otherwise(F.array().cast("array<string>"))


def branch_count(text: Column) -> Column:
    # the look-ahead skips most characters before the dearer word-edge tests
    return F.regexp_count(text, F.lit(jvm(r"(?=[ifwce&|])(?:" + rules.BRANCH_PATTERN + ")")))


def has_token_hint(text: Column) -> Column:
    """A run of 16 token characters at a line start or after a delimiter."""
    return matches(text, r"(?:\A|['\"=:\s])[A-Za-z0-9+/=_\-.~]{16}")


def tokens(line: Column) -> Column:
    return extract_all(line, rules.TOKEN_PATTERN, 1)


def shannon_entropy(token: Column) -> Column:
    """Bits per character, summed in order of first appearance; 0 for an empty string."""
    size = F.length(token)
    shares = F.transform(
        F.array_distinct(F.split(token, "")),
        lambda c: (size - F.length(F.replace(token, c, F.lit("")))).cast("double") / size)
    total = F.aggregate(shares, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))
    return F.when(size == 0, F.lit(0.0)).otherwise(total)


def token_preview(token: Column) -> Column:
    size = F.length(token)
    keep = F.when(size <= 8, 2).when(size <= 20, 3).otherwise(4)
    return F.concat(F.left(token, keep), F.lit("..."), F.right(token, keep))


def token_hash(token: Column) -> Column:
    return F.left(F.sha2(token, 256), F.lit(16))


def round_to(value: Column, digits: int) -> Column:
    """Correctly rounded from the exact binary value, ties to even (Spark's own ``round`` works on
    the shortest decimal form, which differs at ties). For values below 1,000."""
    return F.format_number(value.cast("double"), digits).cast("double")


def percent(part: Column, total: Column) -> Column:
    return F.when(total > 0, round_to(F.lit(100) * part / total, 2)).otherwise(F.lit(0.0))


def sha256(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)
