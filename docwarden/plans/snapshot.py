"""Building a snapshot of a corpus against the last successful one."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from docwarden.operators import entries as E
from docwarden.operators.profile import Profile
from docwarden.operators.validation import validate_entries
from docwarden.session import materialize


@dataclass(frozen=True)
class Snapshot:
    """``compared`` holds entries and deleted rows (column ``section``), ``staged`` the redacted
    texts and event chunks by export path, ``violations`` everything that makes it unusable."""

    compared: DataFrame
    staged: DataFrame
    violations: DataFrame

    @property
    def entries(self) -> DataFrame:
        return self.compared.filter("section = 'entry'").drop("section")

    @property
    def deleted(self) -> DataFrame:
        return self.compared.filter("section = 'deleted'").drop("section")


def build_snapshot(
    corpus: DataFrame,
    profile: Profile,
    previous: DataFrame | None = None,
    *,
    roles: DataFrame | None = None,
    staging: bool = True,
) -> Snapshot:
    """Scan, classify, split logbooks, compare and validate.

    The texts are read once: with a shared folder the content-free entries and the staged texts are
    written there, and everything after that works on them. Originals are never copied."""
    scanned = E.scan_entries(corpus, profile, roles=roles, staging=staging)
    text = F.when(F.col("export_path").isNotNull(), F.col("exported_text")).alias("staged_text")
    nothing = [
        F.lit(None).cast("string").alias("_identity"),
        F.lit(0).cast("bigint").alias("_same_time"),
    ]
    has_events = bool(profile.event_paths) or roles is not None
    if has_events:
        if not staging:
            raise ValueError("event paths require a staging area")
        is_event = F.col("_event") & (F.col("classification") == "include")
        sources = scanned.filter(~F.col("_event") | ~is_event)
        events = E.event_entries(scanned, profile, previous)
        unsafe_book = F.col("_event") & (F.col("classification") == "include_redacted")
        rows = sources.select(
            *E.ENTRY_COLUMNS, text, *nothing, unsafe_book.alias("_unsafe_book")
        ).unionByName(
            events.select(
                *E.ENTRY_COLUMNS, text, "_identity", "_same_time", F.lit(False).alias("_unsafe_book")
            )
        )
    else:
        rows = scanned.select(
            *E.ENTRY_COLUMNS, text, *nothing, F.lit(False).alias("_unsafe_book")
        )
    rows = materialize(rows, "scanned")
    # Free of content and read by every check, so it is written once too.
    compared = materialize(
        E.compare_snapshots(rows.select(*E.ENTRY_COLUMNS), previous), "compared"
    )
    staged = rows.filter("export_path IS NOT NULL").select(
        "export_path", F.col("staged_text").alias("content")
    )
    return Snapshot(compared, staged, _violations(rows, compared, has_events))


def _violations(rows: DataFrame, compared: DataFrame, has_events: bool) -> DataFrame:
    current = compared.filter("section = 'entry'")
    found = validate_entries(current).select("document_id", "violation")
    repeated = E.duplicate_ids(compared).select(
        "document_id", F.lit("duplicate_document_id").alias("violation")
    )
    collisions = (
        rows.filter("export_path IS NOT NULL")
        .groupBy("export_path")
        .agg(F.count("*").alias("n"), F.min("document_id").alias("document_id"))
        .filter("n > 1")
        .select("document_id", F.lit("export_path_collision").alias("violation"))
    )
    found = found.unionByName(repeated).unionByName(collisions)
    if has_events:
        events = rows.filter("_identity IS NOT NULL")
        books = rows.filter("_unsafe_book").select(
            "document_id", F.lit("event_container_not_safe").alias("violation")
        )
        found = found.unionByName(E.event_violations(events)).unionByName(books)
    return found
