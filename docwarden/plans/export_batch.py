"""Turning an approved snapshot into export records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from docwarden.operators import export, provenance, validation
from docwarden.operators.entries import eligible, with_roles
from docwarden.operators.profile import Profile
from docwarden.session import materialize


@dataclass(frozen=True)
class ExportBatch:
    """``approval`` lists ids with their status; anything but ``matched`` stops a submission."""

    items: DataFrame
    approval: DataFrame
    totals: DataFrame
    violations: DataFrame


def export_batch(
    entries: DataFrame,
    corpus: DataFrame,
    staged: DataFrame,
    approved: DataFrame,
    *,
    project: str,
    operator: str,
    exported_at: str,
    run_id: str,
    derived: DataFrame | None = None,
    profile: Profile | None = None,
    roles: DataFrame | None = None,
    approved_totals: tuple[int, int] | None = None,
) -> ExportBatch:
    """With the reviewed ``profile`` the credential policy of every entry must be the one the
    profile gives its path. ``approved`` has document_id and, if the approval fixes the order,
    position from 1; ``approved_totals`` is its number of items and of UTF-8 bytes."""
    tag = lambda df, name: df.select("document_id", F.lit(name).alias("violation"))
    hashes = provenance.corpus_hashes(corpus)
    staged_hashes = staged.select("export_path", F.sha2("content", 256).alias("sha256"))
    checked = provenance.verify_snapshot(entries, hashes, staged_hashes)
    found = tag(
        checked.filter("source_status <> 'ok' OR staged_status NOT IN ('ok', 'none')"),
        "bytes_differ_from_snapshot",
    )
    due = entries.filter("document_id IS NOT NULL")
    found = found.unionByName(tag(validation.attribution_check(due, operator), "attribution"))
    if profile is not None:
        held = F.col("_credential") & F.lit(profile.credential_policy == "allow_project_staging")
        stated = F.coalesce(
            F.try_element_at("metadata", F.lit("credential_policy")), F.lit("exclude")
        )
        differs = (stated == "allow_project_staging") != held
        marked = with_roles(eligible(due), profile, roles)
        found = found.unionByName(tag(marked.filter(differs), "credential_policy"))
    # The texts that are due are joined once; scan, approval and totals read the written items.
    items = materialize(
        export.export_items(entries, corpus, staged, exported_at=exported_at, run_id=run_id),
        "items",
    )
    found = found.unionByName(export.unsafe_items(items))
    if derived is None:
        derived = entries.sparkSession.createDataFrame(
            [],
            "document_id string, content string, tags array<string>, metadata map<string,string>,"
            " event_timestamp string",
        )
    else:
        found = found.unionByName(
            export.validate_derived(derived, hashes, project=project, operator=operator)
        )
    batch = export.union_sections(items, export.derived_items(derived))
    collisions = export.id_collisions(batch).select(
        F.col("folded_id").alias("document_id"), F.lit("id_collision").alias("violation")
    )
    if approved_totals is not None:
        count, size = approved_totals
        found = found.unionByName(export.total_violations(batch, item_count=count, total_bytes=size))
    actual = export.batch_positions(batch) if "position" in approved.columns else batch.select("document_id")
    return ExportBatch(
        batch,
        export.reconcile_approval(approved, actual),
        export.batch_totals(batch),
        found.unionByName(collisions),
    )
