"""Tamper evidence: row digests folded into one root without an ordered pass over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docwarden.functions.jsontree import canonical_json
from docwarden.operators.entries import ENTRY_COLUMNS


def row_digest(columns: dict[str, Column]) -> Column:
    return F.sha2(canonical_json(columns), 256)


def fold_digests(digests: DataFrame, *, column: str = "digest", depth: int = 2) -> DataFrame:
    """One row with the root of all digests, independent of their order.

    Equal digests are counted first. Leaves are groups that share ``2 * depth`` leading hex digits,
    so with depth d a leaf holds about rows / 256^d digests, and each level above folds at most 256
    children. Raise the depth with the table."""
    level = (
        digests.groupBy(F.col(column).alias("_digest"))
        .agg(F.count("*").alias("_copies"))
        .select(
            F.substring("_digest", 1, 2 * depth).alias("_bucket"),
            F.concat_ws(":", "_digest", "_copies").alias("_token"),
        )
    )
    for size in range(depth - 1, -1, -1):
        level = (
            level.groupBy("_bucket")
            .agg(
                F.sha2(F.array_join(F.array_sort(F.collect_list("_token")), "\n"), 256).alias("_hash")
            )
            .select(
                F.substring("_bucket", 1, 2 * size).alias("_parent"),
                F.concat_ws(":", "_bucket", "_hash").alias("_token"),
            )
            .withColumnRenamed("_parent", "_bucket")
        )
    return level.agg(
        F.sha2(
            F.coalesce(F.array_join(F.array_sort(F.collect_list("_token")), "\n"), F.lit("")), 256
        ).alias("digest")
    )


LEAF_DIGESTS = 4096


def digest_depth(rows: int) -> int:
    """Levels of a fold over so many rows, so that a leaf holds about LEAF_DIGESTS of them at most."""
    depth = 1
    while rows > LEAF_DIGESTS * 256**depth:
        depth += 1
    return depth


def entry_digest_columns() -> dict[str, Column]:
    columns = {name: F.col(name) for name in ENTRY_COLUMNS}
    columns["metadata"] = F.array_sort(F.map_entries("metadata"))
    return columns


def snapshot_digest(compared: DataFrame, *, depth: int = 2) -> DataFrame:
    """Digest over entries and deleted rows; ``section`` is part of each row."""
    columns = entry_digest_columns() | {"section": F.col("section")}
    return fold_digests(compared.select(row_digest(columns).alias("digest")), depth=depth)


def evidence_digest(evidence: Column) -> Column:
    """Order-sensitive hash of an evidence list of (source_path, source_sha256)."""
    return F.sha2(
        F.to_json(
            F.transform(
                evidence,
                lambda e: F.struct(
                    e["source_path"].alias("source_path"), e["source_sha256"].alias("source_sha256")
                ),
            )
        ),
        256,
    )
