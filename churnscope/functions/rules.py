"""Rule lists rendered as column expressions and as SQL text.

A rule is (condition, value) with the condition as SQL text that Spark and the
oracle's engine read alike, so a decision table is stated once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Rules = list[tuple[str, int]] | list[tuple[str, str]]


def points(rules: Rules) -> Column:
    """Sum of the values whose condition holds (an unknown one counts 0)."""
    return reduce(lambda a, b: a + b, [F.when(F.expr(c), v).otherwise(0) for c, v in rules])


def points_sql(rules: Rules) -> str:
    return "(" + " + ".join(f"{v} * COALESCE(CAST(({c}) AS INTEGER), 0)" for c, v in rules) + ")"


def first_match(rules: Rules) -> Column:
    """The value of the first rule whose condition holds."""
    return F.coalesce(*[F.when(F.expr(c), v) for c, v in rules])


def first_match_sql(rules: Rules) -> str:
    return "COALESCE(" + ", ".join(f"CASE WHEN {c} THEN '{v}' END" for c, v in rules) + ")"


def lookup_sql(name: str, columns: list[str], rows: list[tuple]) -> str:
    """A CTE body ``name(columns) AS (VALUES ...)``."""
    text = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return f"{name}({', '.join(columns)}) AS (VALUES " + ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows) + ")"
