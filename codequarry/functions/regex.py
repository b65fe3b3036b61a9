"""Patterns are written in Python syntax; the JVM needs a few marks changed so that the same
text gives the same matches: Unicode classes (U), newline as the only line end (d), the four
separators U+001C-U+001F counted as white space, and Python's group and end-of-text marks."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_EXTRA_SPACE = r"\x1c-\x1f"
_WORD = r"\p{L}\p{N}_"
_EDGE = rf"(?:(?<![{_WORD}])(?=[{_WORD}])|(?<=[{_WORD}])(?![{_WORD}]))"
_OUTSIDE = {r"\s": rf"[\s{_EXTRA_SPACE}]", r"\S": rf"[^\s{_EXTRA_SPACE}]", r"\w": f"[{_WORD}]", r"\W": f"[^{_WORD}]", r"\b": _EDGE}
_INSIDE = {r"\s": rf"\s{_EXTRA_SPACE}", r"\w": _WORD}


def jvm(pattern: str, ignore_case: bool = False, flags: str = "") -> str:
    """Translate a Python regex into the Java dialect with Python's meaning."""
    pattern = re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", pattern).replace("(?P<", "(?<").replace(r"\Z", r"\z")
    out, in_class, i = [], False, 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            pair = pattern[i:i + 2]
            pair = (_INSIDE if in_class else _OUTSIDE).get(pair, pair)
            out.append(pair)
            i += 2
            continue
        if ch == "[" and in_class:
            ch = r"\["  # Java would open a nested class
        elif ch == "[":
            in_class = True
            if pattern[i + 1:i + 2] == "^":
                out.append("[^")
                i += 2
                continue
        elif ch == "]" and in_class:
            in_class = False
        out.append(ch)
        i += 1
    return f"(?Ud{'i' if ignore_case else ''}{flags})" + "".join(out)


def matches(col: Column, pattern: str, ignore_case: bool = False, flags: str = "") -> Column:
    return col.rlike(jvm(pattern, ignore_case, flags))


def extract(col: Column, pattern: str, group: int, ignore_case: bool = False, flags: str = "") -> Column:
    return F.regexp_extract(col, jvm(pattern, ignore_case, flags), group)


def extract_all(col: Column, pattern: str, group: int, ignore_case: bool = False, flags: str = "") -> Column:
    return F.regexp_extract_all(col, F.lit(jvm(pattern, ignore_case, flags)), F.lit(group))


def let(col: Column, body) -> Column:
    """Evaluate ``col`` once and use it several times in ``body``."""
    return F.transform(F.array(col), body)[0]
