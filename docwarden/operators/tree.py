"""Page trees as adjacency rows, page specifications and their reconciliation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from docwarden.functions.jsontree import config_contains
from docwarden.functions.text import casefold
from docwarden.operators.checks import violations
from docwarden.operators.skew import lookup_join
from docwarden.session import materialize


@dataclass(frozen=True)
class Tree:
    """``nodes`` has depth and path; pages and folders are its two kinds."""

    nodes: DataFrame
    violations: DataFrame

    @property
    def pages(self) -> DataFrame:
        return self.nodes.filter("kind = 'page'")

    @property
    def folders(self) -> DataFrame:
        return self.nodes.filter("kind = 'folder'")


def nodes_from_json(trees: DataFrame, column: str) -> DataFrame:
    """Nested tree documents, one per row, to adjacency rows. ``owner_id`` is the node that holds a
    row, to be compared with the parent it states. Levels are unfolded and written one after another
    until one is empty."""
    text = lambda v, name: F.try_variant_get(v, f"$.{name}", "string")
    level = trees.select(
        F.lit(None).cast("string").alias("owner_id"),
        F.explode(
            F.try_variant_get(F.try_parse_json(F.col(column)), "$.roots", "array<variant>")
        ).alias("node"),
    )
    rows = None
    while True:
        level = materialize(level.select("owner_id", F.to_json("node").alias("node")), "tree-level")
        if rows is not None and level.isEmpty():
            return rows
        level = level.select("owner_id", F.parse_json("node").alias("node"))
        node = F.col("node")
        found = level.select(
            text(node, "id").alias("id"),
            text(node, "parent_id").alias("parent_id"),
            text(node, "kind").alias("kind"),
            text(node, "name").alias("name"),
            text(node, "mental_model_id").alias("mental_model_id"),
            "owner_id",
        )
        rows = found if rows is None else rows.unionByName(found)
        level = level.select(
            text(node, "id").alias("owner_id"),
            F.explode(F.try_variant_get(node, "$.children", "array<variant>")).alias("node"),
        )


def _doubled(climb: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """One round of pointer doubling: a row's ancestor becomes that ancestor's ancestor."""
    above = climb.select(*[F.col(c).alias(f"_{c}") for c in climb.columns])
    joined = lookup_join(climb.withColumn("_id", F.coalesce("up", F.concat(F.lit("\u0000"), "id"))), above, ["_id"])
    kept = F.col("_depth").isNotNull()
    values = {name: F.when(kept, value).otherwise(F.col(name)) for name, value in sums.items()}
    return joined.select("id", F.when(kept, F.col("_up")).otherwise(F.col("up")).alias("up"), *[v.alias(n) for n, v in values.items()])


def climb_folders(folders: DataFrame) -> DataFrame:
    """(id, path, depth, problem) of every folder by pointer doubling, about log2(depth) rounds each
    way. Depths come first: a folder whose ancestors have not ended after as many rounds as double to
    the number of folders is in a cycle or below one. Only the others get a path."""
    one = F.min(F.struct("parent_id", "name")).alias("_one")  # repeated ids are a violation of their own
    folders = folders.groupBy("id").agg(one).select("id", F.col("_one.parent_id").alias("up"), "_one.name")
    folders = materialize(folders, "tree-folders")
    known = folders.select(F.col("id").alias("_known")).distinct()
    state = folders.join(known, F.col("up") == F.col("_known"), "left").select(
        "id", F.when(F.col("_known").isNotNull(), F.col("up")).alias("up"),
        F.lit(1).cast("long").alias("depth"), (F.col("up").isNotNull() & F.col("_known").isNull()).alias("lost"), "name",
    )
    state = materialize(state, "tree-folders")
    most = state.count().bit_length() + 1
    climb, rounds = state.select("id", "up", "depth", "lost"), 0
    while rounds < most:
        pending = climb.filter("up IS NOT NULL").count()
        if not pending:
            break
        climb = materialize(_doubled(climb, {"depth": F.col("depth") + F.col("_depth"), "lost": F.col("lost") | F.col("_lost")}), "tree-climb")
        rounds += 1
    ended = climb.filter("up IS NULL").select("id", F.col("depth").alias("all_depth"), "lost")
    paths = state.join(ended.select("id"), "id", "left_semi").select("id", "up", F.col("name").alias("path"), "depth")
    for _ in range(rounds):
        paths = materialize(_doubled(paths, {"path": F.concat_ws("/", "_path", "path"), "depth": F.col("depth") + F.col("_depth")}), "tree-paths")
    return state.select("id", "name").join(ended, "id", "left").join(paths.select("id", "path"), "id", "left").select(
        "id", F.coalesce("path", "name").alias("path"), F.coalesce("all_depth", F.lit(1)).alias("depth"),
        F.when(F.col("all_depth").isNull(), "cycle").when(F.col("lost"), "unknown_parent").alias("problem"),
    )


def flatten_tree(nodes: DataFrame) -> Tree:
    """Depth and name path of every node, and the rules a tree breaks.

    Only folders own children, so only the folder table, far smaller than the pages, climbs, as far
    as the tree is deep."""
    kind = F.lower("kind")
    nodes = nodes.withColumn("kind", kind)
    placed = climb_folders(nodes.filter("kind = 'folder'")).select(
        F.col("id").alias("_folder"), F.col("path").alias("_path"), F.col("depth").cast("int").alias("_depth"), "problem"
    )
    # A folder looks itself up, a page its parent.
    is_folder = F.col("kind") == "folder"
    at = nodes.withColumn(
        "_folder",
        F.when(is_folder, F.col("id")).otherwise(
            F.coalesce("parent_id", F.concat(F.lit("\u0000"), "id"))
        ),
    )
    joined = lookup_join(at, placed, ["_folder"])
    flat = joined.select(
        *nodes.columns,
        F.when(is_folder, F.col("_path")).otherwise(F.concat_ws("/", "_path", "name")).alias("path"),
        F.when(is_folder, F.col("_depth"))
        .otherwise(F.coalesce("_depth", F.lit(0)) + 1)
        .alias("depth"),
        F.col("_depth").isNotNull().alias("_placed"),
        "problem",
    )
    rules = _node_rules(nodes)
    rules["unknown_parent"] = (
        ~is_folder & F.col("parent_id").isNotNull() & ~F.col("_placed")
    ) | (is_folder & F.col("problem").eqNullSafe("unknown_parent"))
    rules["cycle"] = F.col("problem").eqNullSafe("cycle")
    found = violations(flat, ["id"], rules)
    repeated = (
        nodes.groupBy(casefold(F.col("id")).alias("id"))
        .agg(F.count("*").alias("n"))
        .filter("n > 1")
        .select("id", F.lit("duplicate_id").alias("violation"))
    )
    return Tree(flat.drop("_placed", "problem"), found.unionByName(repeated))


def _node_rules(nodes: DataFrame) -> dict[str, Column]:
    blank = lambda name: F.coalesce(F.col(name) == "", F.lit(True))
    rules = {
        "invalid_kind_or_id": ~F.coalesce(F.col("kind").isin("folder", "page"), F.lit(False))
        | blank("id"),
        "name_missing": blank("name"),
        "page_without_model": (F.col("kind") == "page") & blank("mental_model_id"),
        "folder_with_model": (F.col("kind") == "folder") & F.col("mental_model_id").isNotNull(),
    }
    if "owner_id" in nodes.columns:
        rules["parent_ownership"] = ~F.col("parent_id").eqNullSafe(F.col("owner_id"))
    return rules


SPEC_COLUMNS = ["name", "source_query", "parent_id", "tags", "max_tokens", "trigger"]


def normalize_specs(specs: DataFrame) -> DataFrame:
    """Whitelisted columns; ``label`` stands in for a missing name."""
    has = set(specs.columns)
    name = F.col("name") if "name" in has else F.lit(None).cast("string")
    if "label" in has:
        name = F.coalesce(name, F.col("label"))
    types = {"tags": "array<string>", "max_tokens": "int"}
    columns = [
        (F.col(c) if c in has else F.lit(None).cast(types.get(c, "string"))).alias(c)
        for c in SPEC_COLUMNS[1:]
    ]
    return specs.select(name.alias("name"), *columns)


def spec_violations(specs: DataFrame) -> DataFrame:
    blank = lambda name: F.coalesce(F.col(name) == "", F.lit(True))
    single = violations(
        specs,
        ["name"],
        {
            "name_missing": blank("name"),
            "source_query_missing": blank("source_query"),
            "max_tokens": F.col("max_tokens") <= 0,
        },
    )
    repeated = (
        specs.groupBy("parent_id", casefold(F.col("name")).alias("name"))
        .agg(F.count("*").alias("n"))
        .filter("n > 1")
        .select("name", F.lit("duplicate_name").alias("violation"))
    )
    return single.unionByName(repeated)


def reconcile_specs(
    specs: DataFrame, tree: DataFrame, models: DataFrame, bodies: DataFrame
) -> DataFrame:
    """Compare wanted pages with existing ones of the same parent and name.

    ``models`` has (mental_model_id, name, source_query, tags, max_tokens, trigger as JSON text),
    ``bodies`` (page_id, body). Absent fields of a specification are not compared."""
    folded = lambda c: casefold(F.col(c))
    # One key text for parent and name; a missing parent is part of it, so it is never a null key.
    key = lambda name: F.concat_ws(
        "\u0000", F.coalesce("parent_id", F.lit("\u0001")), folded(name)
    )
    wanted = specs.withColumn("_key", key("name"))
    pages = tree.filter("kind = 'page'").select(
        key("name").alias("_key"),
        F.col("id").alias("page_id"),
        F.col("mental_model_id"),
    )
    first_page = pages.groupBy("_key").agg(F.min(F.struct("page_id", "mental_model_id")).alias("_page"))
    folders = tree.filter("kind = 'folder'").select(F.col("id").alias("parent_id"), F.lit(True).alias("_known"))
    parts = lookup_join(
        wanted.withColumn("_parent", F.col("parent_id")).withColumn(
            "parent_id", F.coalesce("parent_id", F.concat(F.lit("\u0000"), "name"))
        ),
        folders, ["parent_id"],
    ).withColumn("parent_id", F.col("_parent"))
    joined = parts.join(first_page, "_key", "left").select(
        *specs.columns, "_known", "_page.page_id", "_page.mental_model_id"
    )
    joined = joined.withColumn(
        "_model", F.coalesce("mental_model_id", F.concat(F.lit("\u0000"), "name", F.lit("/"), F.coalesce("parent_id", F.lit(""))))
    )
    model = models.select(
        F.col("mental_model_id").alias("_model"),
        F.struct("name", "source_query", "tags", "max_tokens", "trigger").alias("model"),
    )
    joined = joined.join(model, "_model", "left").join(
        bodies.select(F.col("page_id").alias("_body_page"), "body"),
        F.coalesce("page_id", "_model") == F.col("_body_page"),
        "left",
    )
    m = lambda name: F.col(f"model.{name}")
    sorted_tags = lambda c: F.array_sort(c)
    same = (
        folded("name").eqNullSafe(casefold(m("name")))
        & F.col("source_query").eqNullSafe(m("source_query"))
        & (F.col("tags").isNull() | sorted_tags(F.col("tags")).eqNullSafe(sorted_tags(m("tags"))))
        & (F.col("max_tokens").isNull() | F.col("max_tokens").eqNullSafe(m("max_tokens")))
        & (F.col("trigger").isNull() | config_contains(m("trigger"), F.col("trigger")))
    )
    status = (
        F.when(F.col("parent_id").isNotNull() & F.col("_known").isNull(), "unknown_parent")
        .when(F.col("page_id").isNull(), "to_create")
        .when(F.col("model").isNull(), "inspection_failed")
        .when(~same, "configuration_mismatch")
        .when(F.coalesce(F.trim("body"), F.lit("")) == "", "inspection_failed")
        .otherwise("verified")
    )
    return joined.select("parent_id", "name", "page_id", status.alias("status"))
