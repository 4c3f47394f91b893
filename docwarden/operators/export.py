"""Export records, derived records and their reconciliation with an approval."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from docwarden import vocab
from docwarden.functions.secrets import has_credential_value, is_sensitive_key
from docwarden.functions.text import casefold
from docwarden.functions.times import is_offset_iso
from docwarden.operators import provenance
from docwarden.operators.checks import violations
from docwarden.operators.entries import eligible
from docwarden.operators.preflight import preflight
from docwarden.operators.validation import metadata_is_unsafe, tag_of, tag_prefix
from docwarden.operators.skew import rank_within

ITEM_COLUMNS = [
    "content", "context", "timestamp", "document_id", "tags", "metadata", "observation_scopes",
]


def export_items(
    entries: DataFrame, corpus: DataFrame, staged: DataFrame, *, exported_at: str, run_id: str
) -> DataFrame:
    """Eligible, changed entries with their text. The filter runs on the entries before any
    content is joined; staged text is used where the entry has a locator."""
    due = eligible(entries)
    from_stage = due.filter("export_path IS NOT NULL").join(
        staged.select("export_path", "content"), "export_path"
    )
    from_source = due.filter("export_path IS NULL").join(
        corpus.select("relative_path", F.col("content").cast("string").alias("content")),
        "relative_path",
    )
    columns = [*entries.columns, "content"]
    rows = from_stage.select(*columns).unionByName(from_source.select(*columns))
    stamped = F.map_from_entries(
        F.array_sort(
            F.map_entries(
                F.map_concat(
                    F.map_filter("metadata", lambda k, _: ~k.isin("exported_at", "export_run_id")),
                    F.create_map(
                        F.lit("exported_at"), F.lit(exported_at),
                        F.lit("export_run_id"), F.lit(run_id),
                    ),
                )
            )
        )
    )
    return rows.select(
        "content",
        F.concat(F.lit("project knowledge: "), "knowledge_layer").alias("context"),
        F.coalesce("event_timestamp", F.lit("unset")).alias("timestamp"),
        "document_id",
        "tags",
        stamped.alias("metadata"),
        F.lit("shared").alias("observation_scopes"),
        "relative_path",
    )


def unsafe_items(items: DataFrame) -> DataFrame:
    """A second scan: texts that are no longer safe as they are. Rows whose policy keeps
    credentials are scanned under that policy."""
    policy = F.coalesce(F.try_element_at("metadata", F.lit("credential_policy")), F.lit("exclude"))
    scanned = preflight(items.withColumn("_policy", policy), policy="_policy")
    return scanned.filter("decision <> 'safe'").select(
        "document_id", F.lit("unsafe_content").alias("violation")
    )


def validate_derived(
    records: DataFrame, corpus: DataFrame, *, project: str, operator: str
) -> DataFrame:
    """Violations of derived records (document_id, content, tags, metadata, event_timestamp)."""
    meta = lambda key: F.try_element_at("metadata", F.lit(key))
    tags, document_id = F.col("tags"), F.col("document_id")
    channel = F.regexp_extract(document_id, f"^kb:{project}:(graph|dossier):[^\n]+\\z", 1)
    kind = F.when(channel == "graph", "graph_projection").when(channel == "dossier", "dossier")
    differs = lambda a, b: ~a.eqNullSafe(b)
    single = lambda p: F.size(F.filter(tags, lambda t: t.startswith(p + ":"))) == 1
    value = lambda p: tag_of(tags, p)
    multi = F.map_contains_key("metadata", "source_paths") | F.map_contains_key(
        "metadata", "evidence"
    )
    rules = {
        "document_id": F.coalesce(kind.isNull(), F.lit(True)),
        "content": F.coalesce(F.col("content") == "", F.lit(True)),
        "tag_identity": ~single("user")
        | ~single("project")
        | ~single("kind")
        | differs(value("user"), F.lit(operator))
        | differs(value("project"), F.lit(project))
        | differs(value("kind"), kind),
        "tag_controlled": ~single("scope")
        | ~single("trust")
        | ~single("knowledge")
        | (value("scope") == "")
        | (value("trust") == "")
        | (value("knowledge") == ""),
        "tag_reserved": F.exists(
            tags, lambda t: t.startswith("source:") | t.startswith("harness:")
        ),
        "tag_unsafe": F.exists(
            tags, lambda t: is_sensitive_key(tag_prefix(t), "audit") | has_credential_value(t)
        ),
        "metadata_unsafe": metadata_is_unsafe(F.col("metadata")),
        "metadata_identity": differs(meta("operator"), F.lit(operator))
        | differs(meta("project_slug"), F.lit(project))
        | (F.coalesce(meta("generator"), F.lit("")) == "")
        | (F.coalesce(meta("generator_version"), F.lit("")) == ""),
        "metadata_conflicts_with_tags": differs(meta("knowledge_layer"), value("knowledge"))
        | differs(meta("verification_status"), value("trust")),
        "event_timestamp": F.col("event_timestamp").isNotNull()
        & (F.col("event_timestamp") != "unset")
        & ~is_offset_iso(F.col("event_timestamp")),
    }
    found = violations(records, ["document_id"], rules)
    facts = records.withColumns({"_multi": multi, "kind": value("kind")})
    # Ids are semantic identities, not paths, so the text is scanned under a neutral path.
    scanned = preflight(
        records.select(
            "document_id", "content", F.lit("derived/record.md").alias("relative_path")
        )
    )
    unsafe = scanned.filter("decision <> 'safe'").select(
        "document_id", F.lit("unsafe_content").alias("violation")
    )
    singles = provenance.verify_provenance(
        facts.filter("NOT _multi").select(
            "document_id",
            meta("source_path").alias("source_path"),
            meta("source_sha256").alias("source_sha256"),
        ),
        corpus,
    )
    multis = provenance.verify_evidence(
        facts.filter("_multi").select("document_id", "kind", "metadata"), corpus
    )
    for checked in (singles, multis):
        found = found.unionByName(
            checked.filter("status <> 'ok'").select(
                "document_id", F.concat(F.lit("provenance_"), "status").alias("violation")
            )
        )
    return found.unionByName(unsafe)


def derived_items(records: DataFrame) -> DataFrame:
    return records.select(
        "content",
        F.concat(
            F.lit("project knowledge: "), F.try_element_at("metadata", F.lit("knowledge_layer"))
        ).alias("context"),
        F.coalesce("event_timestamp", F.lit("unset")).alias("timestamp"),
        "document_id",
        "tags",
        "metadata",
        F.lit("shared").alias("observation_scopes"),
    )


def union_sections(snapshot_items: DataFrame, derived: DataFrame) -> DataFrame:
    """Snapshot items first, then derived ones; ``section`` keeps the order."""
    return (
        snapshot_items.select(*ITEM_COLUMNS)
        .withColumn("section", F.lit(0))
        .unionByName(derived.select(*ITEM_COLUMNS).withColumn("section", F.lit(1)))
    )


def id_collisions(items: DataFrame) -> DataFrame:
    """Ids that are equal without regard to case."""
    return (
        items.groupBy(casefold(F.col("document_id")).alias("folded_id"))
        .agg(F.count("*").alias("copies"))
        .filter("copies > 1")
    )


def batch_totals(items: DataFrame) -> DataFrame:
    """Item count and UTF-8 bytes of the content."""
    return items.agg(
        F.count("*").alias("item_count"),
        F.coalesce(F.sum(F.octet_length("content").cast("bigint")), F.lit(0)).alias("total_bytes"),
    )


def reconcile_approval(approved: DataFrame, actual: DataFrame) -> DataFrame:
    """Ids that differ between an approval and what is about to be sent, or that it lists twice.

    Both sides have document_id and, if the order counts, position."""
    ordered = "position" in approved.columns and "position" in actual.columns
    place = F.min("position") if ordered else F.lit(None).cast("bigint")
    pick = lambda df, name: df.groupBy("document_id").agg(
        F.count("*").alias(f"in_{name}"), place.alias(f"{name}_position")
    )
    both = pick(approved, "approved").join(pick(actual, "actual"), "document_id", "full_outer")
    status = (
        F.when(F.col("in_approved").isNull(), "extra")
        .when(F.col("in_actual").isNull(), "missing")
        .when((F.col("in_approved") > 1) | (F.col("in_actual") > 1), "repeated")
        .when(F.col("approved_position") != F.col("actual_position"), "out_of_order")
        .otherwise("matched")
    )
    return both.select("document_id", status.alias("status"))


def batch_positions(items: DataFrame) -> DataFrame:
    """(document_id, position): snapshot items before derived ones, each in id order, from 1."""
    whole = items.select("document_id", "section", F.lit(0).alias("_batch"))
    return rank_within(whole, "_batch", ["section", "document_id"], rank="position").select("document_id", "position")


def total_violations(items: DataFrame, *, item_count: int, total_bytes: int) -> DataFrame:
    """One row without id for each total that the approval states otherwise."""
    totals = batch_totals(items)
    names = F.array(
        F.when(F.col("item_count") != item_count, "item_count_differs"),
        F.when(F.col("total_bytes") != total_bytes, "total_bytes_differ"),
    )
    return totals.select(F.lit(None).cast("string").alias("document_id"), F.explode(F.array_compact(names)).alias("violation"))


def reconcile_totals(items: DataFrame, *, item_count: int, total_bytes: int) -> DataFrame:
    totals = batch_totals(items)
    matches = (F.col("item_count") == item_count) & (F.col("total_bytes") == total_bytes)
    return totals.withColumn("status", F.when(matches, "matched").otherwise("mismatch"))


def retain_summary(compared: DataFrame) -> DataFrame:
    """What a submission of this snapshot would do; ``no_op`` when nothing is due."""
    entry = F.col("section") == "entry"
    due = (
        entry
        & F.col("classification").isin(*vocab.ELIGIBLE)
        & F.col("delta").isin(*vocab.EXPORTED_DELTAS)
    )
    counts = compared.agg(
        F.count_if(due).alias("submitted"),
        F.count_if(entry & ~due).alias("unchanged_or_ineligible"),
        F.count_if(~entry).alias("deleted_reported"),
    )
    return counts.withColumn(
        "status", F.when(F.col("submitted") == 0, "no_op").otherwise("ready")
    )


def identity_approval(entries: DataFrame, approved: DataFrame) -> DataFrame:
    """The same check on the snapshot alone, before any content is read."""
    return reconcile_approval(
        approved.select("document_id"), eligible(entries).select("document_id")
    )
