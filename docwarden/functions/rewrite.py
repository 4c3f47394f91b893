"""Finding and rewriting regular-expression matches with built-in array functions.

A text with n matches splits into n + 1 segments, so ``segments[0] matches[0] segments[1] ...``
is the text again. Separators may span lines, hence no exploding by line."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from docwarden.functions.text import newlines


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def segments(text: Column, pattern: str) -> Column:
    return F.split(text, pattern, -1)


def no_strings() -> Column:
    return F.array().cast("array<string>")


def reassemble(parts: Column, replaced: Column) -> Column:
    """Join segments with the (rewritten) matches between them."""
    return F.array_join(
        F.zip_with(parts, replaced, lambda s, m: F.concat(s, F.coalesce(m, F.lit("")))), ""
    )


def rewrite(text: Column, pattern: str, change: Callable[[Column], Column]) -> Column:
    return reassemble(segments(text, pattern), F.transform(matches(text, pattern), change))


def hit_lines(parts: Column, found: Column, is_hit: Callable[[Column], Column]) -> Column:
    """Line numbers (from 1) at which the matches that satisfy ``is_hit`` start."""
    steps = F.zip_with(
        parts,
        found,
        lambda s, m: F.struct(
            newlines(s).alias("before"),
            F.coalesce(newlines(m), F.lit(0)).alias("inside"),
            F.coalesce(is_hit(m), F.lit(False)).alias("hit"),
        ),
    )
    return hit_lines_of(steps)


def hit_lines_of(steps: Column) -> Column:
    """Lines of the steps marked as hits; a step counts newlines before and inside a match."""
    start = F.struct(F.lit(1).alias("line"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(
        steps,
        start,
        lambda acc, x: F.struct(
            (acc["line"] + x["before"] + x["inside"]).alias("line"),
            F.when(x["hit"], F.array_append(acc["out"], acc["line"] + x["before"]))
            .otherwise(acc["out"])
            .alias("out"),
        ),
        lambda acc: acc["out"],
    )


def first_line(text: Column, pattern: str) -> Column:
    """Line of the first match; the text before it is the first segment."""
    return newlines(F.split(text, pattern, 2)[0]) + 1
