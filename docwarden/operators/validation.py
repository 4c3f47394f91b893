"""Invariants of entries, tags and profiles, as violation tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docwarden import vocab
from docwarden.functions import jsontree
from docwarden.functions.paths import is_safe_relative, posix
from docwarden.functions.secrets import has_credential_value, is_sensitive_key
from docwarden.functions.times import is_zone_offset
from docwarden.operators.checks import violations


def tag_prefix(tag: Column) -> Column:
    return F.substring_index(tag, ":", 1)


def tag_value(tag: Column) -> Column:
    """Text after the first colon."""
    return F.regexp_extract(tag, r"^[^:]*:([\s\S]*)\z", 1)


def tag_of(tags: Column, prefix: str) -> Column:
    """Value of the first tag with a prefix, or null."""
    return tag_value(F.get(F.filter(tags, lambda t: t.startswith(prefix + ":")), F.lit(0)))


def _count(tags: Column, prefix: str) -> Column:
    return F.size(F.filter(tags, lambda t: t.startswith(prefix + ":")))


def tag_rules(tags: Column, *, kinds: tuple[str, ...] = ("source", "event")) -> dict[str, Column]:
    bad_component = lambda t: ~tag_value(t).rlike(vocab.TAG_COMPONENT) & (
        t != "kind:graph_projection"
    )
    unsafe = lambda t: is_sensitive_key(tag_prefix(t), "audit") | has_credential_value(t)
    rules = {
        "tag_without_namespace": F.exists(tags, lambda t: ~t.contains(":")),
        "tag_component": F.exists(tags, lambda t: t.contains(":") & bad_component(t)),
        "tag_repeated": F.size(F.array_distinct(tags)) < F.size(tags),
        "tag_reserved": F.exists(
            tags, lambda t: tag_prefix(t).isin(*vocab.RESERVED_TAGS) & t.contains(":")
        ),
        "tag_unsafe": F.exists(tags, unsafe),
        "tag_kind": ~tag_of(tags, "kind").isin(*kinds),
    }
    for prefix in vocab.SINGLETON_TAGS:
        rules[f"tag_{prefix}_not_single"] = _count(tags, prefix) != 1
    return rules


def validate_tags(df: DataFrame, keys: list[str], tags: str = "tags") -> DataFrame:
    return violations(df, keys, tag_rules(F.col(tags)))


def metadata_is_unsafe(metadata: Column) -> Column:
    """A string map with a secret or body key, or with a credential as a value."""
    return F.exists(
        F.map_entries(metadata),
        lambda e: is_sensitive_key(e["key"], "audit") | has_credential_value(e["value"]),
    )


def entry_rules() -> dict[str, Column]:
    c = F.col
    tags, metadata = c("tags"), c("metadata")
    eligible = c("classification").isin(*vocab.ELIGIBLE)
    user, project, kind = (tag_of(tags, p) for p in ("user", "project", "kind"))
    scope, trust, knowledge = (tag_of(tags, p) for p in ("scope", "trust", "knowledge"))
    meta = lambda key: F.try_element_at(metadata, F.lit(key))
    differs = lambda a, b: ~a.eqNullSafe(b)
    prefix = lambda k: F.concat(F.lit("kb:"), project, F.lit(f":{k}:"), scope, F.lit(":"))
    is_source = c("document_id").startswith(prefix("source"))
    is_event = c("document_id").startswith(prefix("event"))
    stamp = F.replace(F.substring(c("event_timestamp"), 1, 16), F.lit(":"), F.lit("-"))
    digest = lambda v: v.isNotNull() & ~v.rlike(vocab.SHA256_HEX)
    core = {
        "operator": user,
        "project_slug": project,
        "source_path": c("relative_path"),
        "source_sha256": F.coalesce("source_sha256", F.lit("")),
        "source_modified_at": F.coalesce("source_modified_at", F.lit("")),
        "knowledge_layer": knowledge,
        "verification_status": trust,
    }
    core_differs = differs(c("knowledge_layer"), knowledge)
    for key, expected in core.items():
        core_differs |= differs(meta(key), expected)
    rules = {
        "classification": ~c("classification").isin(*vocab.CLASSIFICATIONS),
        "delta": ~c("delta").isin(*vocab.DELTAS),
        "relative_path": ~is_safe_relative(c("relative_path")),
        "hash_format": digest(c("source_sha256")) | digest(c("exported_sha256")),
        "document_id": eligible
        & ~F.coalesce(
            c("document_id").rlike(r"^kb:[a-z0-9-]+:(?:source|event):[a-z0-9-]+:[^\n]+\z"),
            F.lit(False),
        ),
        "metadata_unsafe": eligible & metadata_is_unsafe(metadata),
        "metadata_differs": eligible & core_differs,
        "metadata_exported_hash": eligible
        & c("exported_sha256").isNotNull()
        & differs(meta("exported_sha256"), c("exported_sha256")),
        "id_does_not_bind_tags": eligible & ~is_source & ~is_event,
        "id_kind": eligible & ((is_source & (kind != "source")) | (is_event & (kind != "event"))),
        "source_id": eligible
        & is_source
        & differs(c("document_id"), F.concat(prefix("source"), c("relative_path"))),
        "event_timestamp": eligible
        & is_event
        & (
            c("event_timestamp").isNull()
            | ~is_zone_offset(c("event_timestamp"))
            | ~c("document_id").startswith(F.concat(prefix("event"), stamp, F.lit(":")))
        ),
        "timeless_source": eligible & (kind == "source") & c("event_timestamp").isNotNull(),
        "ineligible_with_id": ~eligible
        & (c("document_id").isNotNull() | c("export_path").isNotNull()),
        "export_path": c("export_path").isNotNull() & ~is_safe_relative(c("export_path")),
        "redacted_without_locator": (c("classification") == "include_redacted")
        & c("export_path").isNull(),
    }
    for name, cond in tag_rules(tags).items():
        rules[name] = eligible & cond
    return rules


def validate_entries(entries: DataFrame) -> DataFrame:
    return violations(entries, ["relative_path", "document_id"], entry_rules())


def validate_profiles(profiles: DataFrame) -> DataFrame:
    """Violations of a table of registration proposals, one row per root."""
    c = F.col
    text_columns = (
        "root", "display_name", "owner_slug", "project_slug", "bank_id", "product_identity",
        "relationship",
    )
    blank = F.lit(False)
    for name in text_columns:
        blank |= F.coalesce(c(name) == "", F.lit(True))
    canonical = c("root").rlike(r"^/(?:[^/]+(?:/[^/]+)*)?\z") & ~c("root").rlike(
        r"(?:^|/)\.{1,2}(?:/|\z)"
    )
    owner = F.substring_index("bank_id", "::", 1)
    rules = {
        "identity_missing": blank,
        "not_reviewed": ~F.coalesce(c("reviewed"), F.lit(False)),
        "relationship_uncertain": ~c("relationship").isin(*vocab.RELATIONSHIPS),
        "root_not_canonical": ~canonical,
        "bank_identity": ~c("bank_id").rlike(vocab.BANK_ID) | (owner != c("owner_slug")),
    }
    if "credential_policy" in profiles.columns:
        rules["credential_policy"] = ~c("credential_policy").isin(*vocab.CREDENTIAL_POLICIES)
    if {"credential_policy", "credential_sources"} <= set(profiles.columns):
        sources = c("credential_sources")
        unusable = (
            sources.isNull()
            | (F.size(sources) == 0)
            | (F.size(F.array_distinct(sources)) < F.size(sources))
            | F.exists(sources, lambda p: ~is_safe_relative(p) | (posix(p) != p) | (p == "."))
        )
        rules["credential_sources"] = (c("credential_policy") == "allow_project_staging") & unusable
    secret = F.lit(False)
    for name, kind in profiles.dtypes:
        if kind == "string" and name != "extra":
            secret |= has_credential_value(c(name), "registry")
    if "extra" in profiles.columns:
        secret |= jsontree.has_secrets(c("extra"), "registry")
        rules["extra_not_an_object"] = c("extra").isNotNull() & ~jsontree.is_json_object(c("extra"))
    rules["sensitive_material"] = secret
    return violations(profiles, ["root"], rules)


def attribution_check(entries: DataFrame, operator: str) -> DataFrame:
    """Rows whose ``user:`` tag is not exactly the active operator, or whose metadata differs."""
    users = F.filter("tags", lambda t: t.startswith("user:"))
    wrong = (F.size(users) != 1) | ~F.get(users, F.lit(0)).eqNullSafe(F.lit(f"user:{operator}"))
    wrong |= ~F.try_element_at("metadata", F.lit("operator")).eqNullSafe(F.lit(operator))
    return entries.filter(wrong)
