"""Score-to-label rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules


def health_score(todo: Column, fixme: Column, large: Column, long_lines: Column, dense: Column) -> Column:
    lost = (F.least(F.lit(20), F.floor(todo / 2)) + F.least(F.lit(20), fixme * 3)
            + F.least(F.lit(15), large * 2) + F.least(F.lit(10), F.floor(long_lines / 20))
            + F.least(F.lit(15), dense * 2))
    return F.greatest(F.lit(0), F.lit(100) - lost).cast("int")


def health_grade(score: Column) -> Column:
    out = F.when(score >= rules.GRADE_STEPS[0][0], rules.GRADE_STEPS[0][1])
    for low, grade in rules.GRADE_STEPS[1:]:
        out = out.when(score >= low, grade)
    return out.otherwise("F")


def _risk_step(score: Column, index: int, last: str) -> Column:
    out = F.when(score < rules.RISK_STEPS[0][0], rules.RISK_STEPS[0][index])
    for step in rules.RISK_STEPS[1:]:
        out = out.when(score < step[0], step[index])
    return out.otherwise(last)


def risk_grade(score: Column) -> Column:
    return _risk_step(score, 1, "F")


def risk_level(score: Column) -> Column:
    return _risk_step(score, 2, "high")


def readiness_status(failed: Column, warned: Column) -> Column:
    return F.when(failed > 0, "blocked").when(warned > 0, "needs-review").otherwise("ready-for-verification")


def gate_exit(status: Column, strict: bool = False) -> Column:
    """1 where a quality gate should stop the pipeline."""
    stops = ["fail", "blocked"] + (["warning", "needs-review", "dry-run"] if strict else [])
    return F.when(status.isin(stops), 1).otherwise(0)
