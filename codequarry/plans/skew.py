"""Joins whose rows crowd on a few keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARE = 1_000  # a key with a thousandth of all rows is a hot one, so there are at most that many


def matched(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join in which nulls match nulls; the columns of ``on`` come from the left side."""
    other = right.select(*(F.col(c).alias(f"__{c}") for c in on), *(c for c in right.columns if c not in on))
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in on))
    return left.join(other, same, how).drop(*(f"__{c}" for c in on))


def matched_hot(rows: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``matched`` with ``rows`` that may crowd on a few keys, of which ``right`` has a few rows each: what ``right`` has for keys with at least
    a thousandth of all rows goes to every task, and the rest is joined by key. ``rows`` is read three times, so it should be
    stored."""
    sizes = rows.groupBy(*on).agg(F.count("*").alias("__n"))
    total = sizes.agg(F.sum("__n")).first()[0] or 0
    hot = sizes.filter(F.col("__n") >= max(-(-total // SHARE), SHARE)).select(*on)
    if not hot.limit(1).count():
        return matched(rows, right, on, how)
    hot = F.broadcast(hot)
    few = matched(matched(rows, hot, on, "left_semi"), F.broadcast(matched(right, hot, on, "left_semi")), on, how)
    return few.unionByName(matched(matched(rows, hot, on, "left_anti"), right, on, how))
