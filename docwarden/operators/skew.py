"""Joins and ranks that hold when one key owns a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from docwarden.session import materialize, prefer_hash_joins


def lookup_join(left: DataFrame, right: DataFrame, on: list[str], *, how: str = "left") -> DataFrame:
    """Join rows to a table that is unique on ``on``.

    A plain equi-join: adaptive execution splits the partition of a key that owns many rows of
    ``left`` and reads the one matching row of ``right`` again for each piece, so nothing is repeated
    for keys that are not hot. Callers give a missing key a value of its own, so that missing keys do
    not meet in one task. Where every shuffled partition of ``right`` is small as measured, adaptive
    execution hashes it and the many rows of ``left`` are not sorted."""
    prefer_hash_joins(left.sparkSession)
    return left.join(right, on, how)


HUB_ROWS = 1 << 20
#: About so many rows of one group are ranked by one task; a larger group is cut into slabs.
SAMPLED = 1 / 256


def large_groups(df: DataFrame, group: str, hub_rows: int = HUB_ROWS) -> list:
    """Values of ``group`` (null may be one) that own about ``hub_rows`` rows or more, estimated where that
    is enough rows to count a share of them; so there are at most rows / ``hub_rows`` or a few more."""
    share = SAMPLED if hub_rows * SAMPLED >= 1024 else 1.0
    some = df.select(group) if share == 1.0 else df.select(group).sample(share, seed=1)
    counts = some.groupBy(group).agg(F.count("*").alias("_rows"))
    return [row[0] for row in counts.filter(F.col("_rows") > 0.8 * share * hub_rows).select(group).collect()]


def rank_within(
    df: DataFrame,
    group: str,
    order: list[str],
    *,
    rank: str = "rank",
    total: str = "total",
    slabs: int | None = None,
    hub_rows: int = HUB_ROWS,
    repeats: Sequence[str] = (),
) -> DataFrame:
    """1-based position of each row within its group, and the group's size, both bigint.

    Rows are written once. Groups of less than about ``hub_rows`` rows are shuffled by group and ranked there, so
    that what goes on to work by group needs no further shuffle. Larger groups, or all where a number
    of ``slabs`` is given, are ranked in slabs that cover many tasks. Columns named in ``repeats``, of the type of
    ``group``, are written and shuffled only where they differ from it."""
    if slabs:
        return _rank_in_slabs(df, group, order, rank, total, slabs)
    rows = materialize(_without_repeats(df, group, repeats), "rows")
    hubs = large_groups(rows, group, hub_rows)
    whole = Window.partitionBy(group)
    position = F.row_number().over(whole.orderBy(*order)).cast("bigint")
    added = [position.alias(rank), F.count("*").over(whole).alias(total)]
    # The shuffle stands below the columns that are filled in again, not above them as the window's own would.
    by_group = lambda some: _with_repeats(some.repartition(group), group, repeats) if repeats else some
    if not hubs:
        return by_group(rows).select(*df.columns, *added)
    large = F.coalesce(F.col(group).isin([x for x in hubs if x is not None]), F.lit(None in hubs))
    in_slabs = _rank_in_slabs(_with_repeats(rows.filter(large), group, repeats), group, order, rank, total, None)
    return by_group(rows.filter(~large)).select(*df.columns, *added).unionByName(in_slabs.select(*df.columns, rank, total))


def _without_repeats(df: DataFrame, group: str, repeats: Sequence[str]) -> DataFrame:
    """Null in place of the value of ``group``, and a column that tells the places."""
    if not repeats:
        return df
    same = {name: F.col(name).eqNullSafe(F.col(group)) for name in repeats}
    bits = [F.when(x, 1 << i).otherwise(0) for i, x in enumerate(same.values())]
    kept = [F.when(~same[c], F.col(c)).alias(c) if c in same else F.col(c) for c in df.columns]
    return df.select(*kept, sum(bits, F.lit(0)).alias("_same"))


def _with_repeats(df: DataFrame, group: str, repeats: Sequence[str]) -> DataFrame:
    if not repeats:
        return df
    same = {name: F.col("_same").bitwiseAND(1 << i) != 0 for i, name in enumerate(repeats)}
    return df.select(*[F.when(same[c], F.col(group)).otherwise(F.col(c)).alias(c) if c in same else F.col(c) for c in df.columns if c != "_same"])


def _rank_in_slabs(df: DataFrame, group: str, order: list[str], rank: str, total: str, slabs: int | None) -> DataFrame:
    """Rows are range partitioned on group and order, so that a large group covers many tasks and small
    ones share one. Each task ranks its own slab of a group; slab sizes, one row per group and slab,
    are summed up to offsets. The slabs are written because range boundaries are sampled and would
    differ in a second evaluation."""
    by = [group, *order]
    ranged = df.repartitionByRange(slabs, *by) if slabs else df.repartitionByRange(*by)
    ranged = materialize(ranged.withColumn("_slab", F.spark_partition_id()), "slabs")
    whole = Window.partitionBy(group)
    before = whole.orderBy("_slab").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy(group, "_slab").agg(F.count("*").alias("_rows"))
    offsets = sizes.select(
        F.col(group).alias("_group"),
        F.col("_slab").alias("_of_slab"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"),
        F.sum("_rows").over(whole).alias(total),
    )
    local = F.row_number().over(Window.partitionBy(group, "_slab").orderBy(*order))
    same = F.col(group).eqNullSafe(F.col("_group")) & (F.col("_slab") == F.col("_of_slab"))
    placed = ranged.withColumn("_local", local).join(offsets, same)
    return placed.select(*df.columns, (F.col("_local") + F.col("_offset")).alias(rank), total)


def successor_within(df: DataFrame, group: str, order: list[str], *, value: str, successor: str = "successor", rank: str = "rank") -> DataFrame:
    """``value`` of the next row of each row's group (null for the last one) and the row's 1-based position.

    Built like :func:`rank_within`: range partitions cut a large group into slabs, successors and positions
    are found inside a slab, and a small table with one row per group and slab links the last row of a
    slab to the first of the next and gives the offset. No task holds a whole group."""
    by = [group, *order]
    ranged = materialize(df.repartitionByRange(*by).withColumn("_slab", F.spark_partition_id()), "slabs")
    slab = Window.partitionBy(group, "_slab").orderBy(*order)
    sizes = ranged.groupBy(group, "_slab").agg(F.count("*").alias("_rows"), F.min_by(value, F.struct(*order)).alias("_first"))
    slabs = Window.partitionBy(group).orderBy("_slab")
    edges = sizes.select(
        F.col(group).alias("_group"),
        F.col("_slab").alias("_of_slab"),
        F.lead("_first").over(slabs).alias("_next"),
        F.coalesce(F.sum("_rows").over(slabs.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"),
        "_rows",
    )
    local = ranged.withColumns({"_local": F.row_number().over(slab), "_after": F.lead(value).over(slab)})
    same = F.col(group).eqNullSafe(F.col("_group")) & (F.col("_slab") == F.col("_of_slab"))
    placed = local.join(edges, same)
    after = F.when(F.col("_local") == F.col("_rows"), F.col("_next")).otherwise(F.col("_after"))
    return placed.select(*df.columns, after.alias(successor), (F.col("_local") + F.col("_offset")).alias(rank))
