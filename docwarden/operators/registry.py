"""Registered roots: longest-prefix resolution, keyed upsert, shared banks, proposals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from docwarden import vocab
from docwarden.functions.paths import ancestors, path_depth
from docwarden.functions.text import ascii_slug
from docwarden.operators.checks import failed_rules
from docwarden.operators.skew import lookup_join

REGISTRY_COLUMNS = [
    "root", "bank_id", "display_name", "product_identity", "relationship", "owner_slug",
    "project_slug", "reviewed", "credential_policy", "registered_at", "registered_by",
    "updated_at", "updated_by",
]


def resolve_roots(paths: DataFrame, roots: DataFrame, *, path: str = "path") -> DataFrame:
    """Most specific registered root of each distinct path, by whole components; null if none.

    Every path meets its own prefixes in an equi-join, so no range comparison is needed. The
    deepest root is a maximum, not a ranking, and combines before the shuffle."""
    prefixes = paths.select(path).distinct().select(path, F.explode(ancestors(F.col(path))).alias("root"))
    known = roots.select("root", path_depth(F.col("root")).alias("_depth"))
    joined = lookup_join(prefixes, known, ["root"])
    best = F.max(F.when(F.col("_depth").isNotNull(), F.struct("_depth", "root")))
    return joined.groupBy(path).agg(best.alias("_best")).select(
        path, F.col("_best.root").alias("root"), F.col("_best._depth").alias("depth")
    )


def product_banks(registry: DataFrame) -> DataFrame:
    """The bank of each product; more than one bank makes the relationship uncertain."""
    known = registry.filter("product_identity IS NOT NULL AND bank_id <> ''")
    per_product = known.groupBy("product_identity").agg(
        F.count("*").alias("roots"),
        F.min("bank_id").alias("_first"),
        F.max("bank_id").alias("_last"),
        F.min("owner_slug").alias("owner_slug"),
        F.min("project_slug").alias("project_slug"),
    )
    unique = F.col("_first") == F.col("_last")
    return per_product.select(
        "product_identity",
        "roots",
        F.when(unique, F.col("_first")).alias("bank_id"),
        F.when(unique, "resolved").otherwise("relationship_uncertain").alias("status"),
        "owner_slug",
        "project_slug",
    )


def bank_sharing(registry: DataFrame) -> DataFrame:
    """Roots, products and project slugs per bank; identities are combined before counting."""
    return registry.groupBy("bank_id").agg(
        F.count("*").alias("roots"),
        F.countDistinct("product_identity").alias("products"),
        F.countDistinct("project_slug").alias("project_slugs"),
    )


def propose_registration(requests: DataFrame, registry: DataFrame) -> DataFrame:
    """Profiles for (root, owner, name, existing_product). With an existing product its bank is
    reused; an unknown product or one with several banks is uncertain."""
    slugs = requests.withColumns(
        {"_owner": ascii_slug(F.col("owner")), "_project": ascii_slug(F.col("name"))}
    )
    banks = product_banks(registry).select(
        F.col("product_identity").alias("existing_product"),
        F.col("bank_id").alias("_bank"),
        F.col("status").alias("_status"),
        F.col("owner_slug").alias("_bank_owner"),
        F.col("project_slug").alias("_bank_project"),
    )
    asks = F.col("existing_product").isNotNull()
    # Requests without a product keep a key of their own.
    keyed = slugs.withColumn(
        "_product", F.coalesce("existing_product", F.concat(F.lit("\u0000"), "root"))
    )
    joined = lookup_join(
        keyed, banks.withColumnRenamed("existing_product", "_product"), ["_product"]
    )
    owner = F.when(
        asks, F.coalesce("_bank_owner", F.substring_index("_bank", "::", 1))
    ).otherwise(F.col("_owner"))
    project = F.when(
        asks, F.coalesce("_bank_project", F.substring_index("_bank", "::", -1))
    ).otherwise(F.col("_project"))
    status = (
        F.when(F.col("_owner").isNull() | F.col("_project").isNull(), "invalid_name")
        .when(asks & F.col("_status").isNull(), "relationship_uncertain")
        .when(asks & (F.col("_status") != "resolved"), "relationship_uncertain")
        .otherwise("proposal")
    )
    return joined.select(
        "root",
        F.col("name").alias("display_name"),
        owner.alias("owner_slug"),
        project.alias("project_slug"),
        F.when(asks, F.col("_bank"))
        .otherwise(F.concat_ws("::", "_owner", "_project"))
        .alias("bank_id"),
        F.when(asks, F.col("existing_product"))
        .otherwise(F.concat_ws("-", "_owner", "_project"))
        .alias("product_identity"),
        F.when(asks, "existing_product_additional_root")
        .otherwise("new_product")
        .alias("relationship"),
        F.lit(False).alias("reviewed"),
        F.lit("exclude").alias("credential_policy"),
        status.alias("status"),
    )


@dataclass(frozen=True)
class Upsert:
    registry: DataFrame
    conflicts: DataFrame


def registry_upsert(
    registry: DataFrame,
    proposals: DataFrame,
    *,
    registered_at: str,
    nickname: str | None = None,
) -> Upsert:
    """Registry with the proposals that break no rule applied; the others are conflicts.

    A proposal is judged against the registry as it is before the batch. Identity columns stay once
    set, a bank belongs to other roots only under a reviewed reuse of the same product and project,
    and the first registration is kept."""
    known = [c for c in REGISTRY_COLUMNS if c in registry.columns]
    asked = [c for c in known if c in proposals.columns]
    # One row per root; which of several proposals it is does not matter, as they are refused.
    new = (
        proposals.groupBy("root")
        .agg(F.count("*").alias("_copies"), F.min(F.struct(*asked)).alias("_new"))
        .select("root", "_copies", *[F.col(f"_new.{c}").alias(c) for c in asked if c != "root"])
    )
    old = registry.select("root", F.struct(*known).alias("old"))
    both = new.join(old, "root", "full_outer").withColumns(
        {
            "_proposed": F.col("_copies").isNotNull(),
            # Roots without a proposal get a key of their own instead of a common null.
            "bank_id": F.coalesce("bank_id", F.concat(F.lit("\u0000"), "root")),
        }
    )

    # Roots per bank, and per bank and identity; one row per group whatever the size of a bank.
    totals = registry.groupBy("bank_id").agg(F.count("*").alias("_bank_roots"))
    same = registry.groupBy("bank_id", "product_identity", "project_slug").agg(
        F.count("*").alias("_same_roots")
    )
    both = lookup_join(both, totals, ["bank_id"])
    both = lookup_join(
        both, same, ["bank_id", "product_identity", "project_slug"]
    )
    in_batch = proposals.groupBy("bank_id").agg(F.count("*").alias("_batch_roots"))
    both = lookup_join(both, in_batch, ["bank_id"])

    exists = F.col("old").isNotNull()
    own = F.coalesce((F.col("old.bank_id") == F.col("bank_id")).cast("int"), F.lit(0))
    own_same = own * F.coalesce(
        (
            (F.col("old.product_identity") == F.col("product_identity"))
            & (F.col("old.project_slug") == F.col("project_slug"))
        ).cast("int"),
        F.lit(0),
    )
    others = F.coalesce("_bank_roots", F.lit(0)) - own
    same_others = F.coalesce("_same_roots", F.lit(0)) - own_same
    reuse = (
        (F.coalesce("product_identity", F.lit("")) != "")
        & (F.coalesce("project_slug", F.lit("")) != "")
        & F.col("relationship").eqNullSafe(F.lit("existing_product_additional_root"))
        & F.coalesce("reviewed", F.lit(False))
    )
    identity = F.lit(False)
    for name in vocab.IDENTITY_COLUMNS:
        established = F.col(f"old.{name}")
        identity |= F.coalesce(established != "", F.lit(False)) & ~F.col(name).eqNullSafe(established)
    rules = {
        "root_or_bank_missing": F.coalesce(
            (F.col("root") == "") | (F.col("bank_id") == "") | F.col("bank_id").startswith("\u0000"),
            F.lit(True),
        ),
        "root_repeated_in_batch": F.col("_copies") > 1,
        "bank_change": exists & (F.col("old.bank_id") != F.col("bank_id")),
        "identity_change": identity,
        "bank_taken": (others > 0) & ~(reuse & (others == same_others)),
        "new_bank_shared_in_batch": (others == 0) & ~exists & (F.col("_batch_roots") > 1),
    }
    judged = both.withColumn("_failed", failed_rules(rules))
    conflicts = judged.filter("_proposed").select("root", F.explode("_failed").alias("violation"))
    accepted = F.col("_proposed") & (F.size("_failed") == 0)

    def merged(name: str) -> Column:
        old_value = F.col(f"old.{name}")
        if name in vocab.IDENTITY_COLUMNS:
            return F.coalesce(F.nullif(old_value, F.lit("")), F.col(name))
        if name == "registered_at":
            return F.coalesce(F.nullif(old_value, F.lit("")), F.lit(registered_at))
        if name == "registered_by":
            return F.coalesce(F.nullif(old_value, F.lit("")), F.lit(nickname).cast("string"))
        if name == "updated_at":
            return F.when(exists, F.lit(registered_at))
        if name == "updated_by":
            return F.when(exists, F.coalesce(F.lit(nickname).cast("string"), old_value))
        if name == "credential_policy":
            return F.coalesce(F.col(name), F.lit("exclude")) if name in asked else F.lit("exclude")
        return F.coalesce(F.col(name), old_value) if name in asked else old_value

    columns = [
        F.col("root")
        if c == "root"
        else F.when(accepted, merged(c)).otherwise(F.col(f"old.{c}")).alias(c)
        for c in known
    ]
    return Upsert(judged.filter(exists | accepted).select(*columns), conflicts)


def changed_mappings(before: DataFrame, after: DataFrame, *, key: str, mapping: str) -> DataFrame:
    """Entries that differ between two versions of a string map, and whether at most one does."""
    pairs = lambda name: F.map_entries(F.col(name))
    joined = before.select(key, F.col(mapping).alias("_before")).join(
        after.select(key, F.col(mapping).alias("_after")), key, "full_outer"
    )
    empty = F.create_map().cast("map<string,string>")
    joined = joined.select(
        key,
        F.coalesce("_before", empty).alias("_before"),
        F.coalesce("_after", empty).alias("_after"),
    )
    differing = F.array_sort(
        F.array_distinct(
            F.concat(
                F.transform(F.array_except(pairs("_before"), pairs("_after")), lambda e: e["key"]),
                F.transform(F.array_except(pairs("_after"), pairs("_before")), lambda e: e["key"]),
            )
        )
    )
    return joined.select(key, differing.alias("changed_keys")).withColumn(
        "only_one_changed", F.size("changed_keys") <= 1
    )
