"""Keeping expensive columns computed once."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def fence(df: DataFrame, kept: list[str], computed: list[str]) -> DataFrame:
    """Select ``kept`` and ``computed`` columns so that later filters on computed ones stay above.

    The optimizer pushes a filter through a projection by repeating the projected expression in it;
    through a chain of expensive projections this multiplies. A generated row is opaque to it, so
    the expressions are evaluated once per row, and filters on ``kept`` still reach the scan."""
    packed = F.explode_outer(F.array(F.struct(*computed)))
    return df.select(*kept, packed.alias("_fenced")).select(
        *kept, *[F.col(f"_fenced.{c}").alias(c) for c in computed]
    )
