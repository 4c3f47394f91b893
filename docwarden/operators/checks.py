"""Violations as rows, and a strict mode that turns them into an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


class ViolationError(ValueError):
    """At least one row breaks a rule; the message names rules, never values."""


def failed_rules(rules: dict[str, Column]) -> Column:
    """Names of the rules whose condition holds (a null condition counts as not broken)."""
    return F.filter(
        F.array(*[F.when(cond, F.lit(name)) for name, cond in rules.items()]),
        lambda name: name.isNotNull(),
    )


def violations(df: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """One row per broken rule."""
    return df.select(*keys, F.explode(failed_rules(rules)).alias("violation"))


def duplicates(df: DataFrame, keys: list[str | Column], *, count: str = "copies") -> DataFrame:
    """Key values that occur more than once; counted before the shuffle."""
    return df.groupBy(*keys).agg(F.count("*").alias(count)).filter(F.col(count) > 1)


def require_none(found: DataFrame, rule: str = "violation") -> None:
    """Raise if there is any violation. Runs one small action."""
    first = found.select(rule).head(1)
    if first:
        raise ViolationError(f"rejected: {first[0][0]}")
