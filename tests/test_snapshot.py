"""Snapshots: delta, renames, events, roles, violations, digests."""

import pytest
from pyspark.sql import functions as F

from docwarden.operators import entries as E
from docwarden.operators.digests import snapshot_digest
from docwarden.operators.profile import Profile
from docwarden.operators.validation import validate_entries
from docwarden.plans.snapshot import build_snapshot

PROFILE = Profile(project_slug="acme", operator="Alice", scope="wiki", topics=("topic:hr",))
BOOKS = Profile(project_slug="acme", operator="alice", event_paths=("LOGBOOK.md",),
                knowledge_layer="initiative")
SCHEMA = "relative_path string, content string"


def corpus(spark, files):
    return spark.createDataFrame(list(files.items()), SCHEMA)


def build(spark, files, previous=None, profile=PROFILE, **options):
    return build_snapshot(corpus(spark, files), profile, previous, **options)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_delta_rename_and_deletion(spark):
    before = build(spark, {
        "same.md": "a", "edited.md": "b", "gone.md": "c", "old/place.md": "unique text",
        "copy1.md": "twin", "copy2.md": "twin", "keep.md": "kept", "uploads/x.md": "z"})
    after = build(spark, {
        "same.md": "a", "edited.md": "b2", "new/place.md": "unique text", "copy3.md": "twin",
        "dup.md": "kept", "keep.md": "kept", "fresh.md": "n", "uploads/x.md": "z"}, before.entries)
    got = {r["relative_path"]: (r["delta"], r["renamed_from"]) for r in after.entries.collect()}
    assert got == {
        "same.md": ("unchanged", None), "edited.md": ("changed", None),
        "new/place.md": ("renamed", "old/place.md"),
        "copy3.md": ("new", None),  # two possible origins
        "dup.md": ("renamed", "keep.md"),  # a copy of a document that is still there
        "keep.md": ("unchanged", None), "fresh.md": ("new", None), "uploads/x.md": ("new", None)}
    assert rows(after.deleted, "relative_path", "delta") == [
        ("copy1.md", "deleted"), ("copy2.md", "deleted"), ("gone.md", "deleted"),
        ("old/place.md", "deleted")]
    assert after.violations.count() == 0
    again = build(spark, {"same.md": "a", "gone.md": "c"}, build(spark, {"same.md": "a", "gone.md": "c"}).entries)
    assert rows(E.delta_counts(again.compared), "delta", "entries") == [("unchanged", 2)]


def test_entry_columns(spark):
    snap = build(spark, {"a.md": "password: hunter2\n", "wiki/b.md": "fine", ".env": "x"})
    got = {r["relative_path"]: r for r in snap.entries.collect()}
    a = got["a.md"]
    assert a["classification"] == "include_redacted" and a["export_path"] == "a.md"
    assert a["document_id"] == "kb:acme:source:wiki:a.md"
    assert a["tags"] == ["kind:source", "knowledge:concept", "project:acme", "scope:wiki",
                         "topic:hr", "trust:verified", "user:alice"]
    assert a["metadata"]["exported_sha256"] == a["exported_sha256"]
    keys = snap.entries.filter("relative_path = 'a.md'").select(F.map_keys("metadata")).first()[0]
    assert keys == sorted(keys) and len(keys) == 9
    assert rows(snap.staged, "export_path", "content") == [("a.md", "password: [REDACTED]\n")]
    assert got[".env"]["document_id"] is None and got[".env"]["tags"] == []
    unstaged = build(spark, {"a.md": "password: hunter2\n"}, staging=False).entries.first()
    assert (unstaged["classification"], unstaged["document_id"]) == ("blocked_review", None)
    assert E.ordered(snap.entries).first()["relative_path"] == "a.md"


def test_roles(spark):
    profile = Profile(project_slug="acme", operator="alice", credential_policy="allow_project_staging",
                      reviewed=True, credential_sources=("ops/.env",),
                      derived_after_audit_paths=("graph/a.md",))
    files = {"ops/.env": "password: x", "b.md": "password: x", "graph/a.md": "t", "late.md": "t"}
    roles = spark.createDataFrame([("late.md", "derived", None)],
                                  "relative_path string, role string, scope string")
    got = {r["relative_path"]: r for r in build(spark, files, profile=profile, roles=roles).entries.collect()}
    assert got["ops/.env"]["classification"] == "include"
    assert got["ops/.env"]["metadata"]["credential_policy"] == "allow_project_staging"
    assert got["ops/.env"]["sensitivity_summary"] == ["credential_assignment_allowed"]
    assert got["b.md"]["classification"] == "include_redacted"
    assert got["graph/a.md"]["classification"] == got["late.md"]["classification"] == "derived_after_audit"


BOOK = ("Intro\n### 2026-09-01 17:20 CEST - Nuovo forno\r\nBody\r\n\r\n"
        "### 2026-01-05 08:00 CEST - Riunione\nText")


def test_events(spark):
    first = build(spark, {"LOGBOOK.md": BOOK, "x.md": "x"}, profile=BOOKS)
    got = {r["document_id"]: r for r in first.entries.collect()}
    key = "kb:acme:event:project-logbook:2026-09-01T17-20:nuovo-forno"
    assert set(got) == {key, "kb:acme:event:project-logbook:2026-01-05T08-00:riunione",
                        "kb:acme:source:workspace:x.md"}
    event = got[key]
    assert event["event_timestamp"] == "2026-09-01T17:20:00+02:00"
    chunk = "### 2026-09-01 17:20 CEST - Nuovo forno\nBody\n\n"
    assert (event["export_path"], chunk) in rows(first.staged, "export_path", "content")
    assert event["size"] == len(chunk)
    assert event["metadata"]["source_sha256"] == event["source_sha256"]
    assert len(event["metadata"]["container_sha256"]) == 64
    assert first.violations.count() == 0
    corrected = build(spark, {"LOGBOOK.md": BOOK.replace("Nuovo forno", "Export agenda")},
                      first.entries, BOOKS)
    moved = {r["document_id"]: r["delta"] for r in corrected.entries.collect()}
    assert moved[key] == "changed" and len(moved) == 2
    assert rows(corrected.staged, "export_path") == sorted(
        (r["export_path"],) for r in first.entries.collect() if r["export_path"])


def test_event_violations(spark):
    same = "### 2026-09-01 17:20 CEST - A\nx\n"
    cases = {
        same + same: "duplicate_event",
        "### 2026-09-01 17:20 CEST - ---\n": "heading_without_slug",
        "### 2026-03-29 02:30 CEST - Gap\n": "event_timestamp",
        "password: x\n" + same: "event_container_not_safe",
        "### 2026-13-01 17:20 CEST - A\n": "invalid_event_time",
    }
    for text, violation in cases.items():
        found = build(spark, {"LOGBOOK.md": text}, profile=BOOKS).violations
        assert violation in {r["violation"] for r in found.collect()}, violation
    with pytest.raises(ValueError):
        build(spark, {"LOGBOOK.md": same}, profile=BOOKS, staging=False)


def test_entry_violations(spark):
    entries = build(spark, {"a.md": "x", "b.md": "y"}).entries
    assert validate_entries(entries).count() == 0
    a = F.col("relative_path") == "a.md"
    changes = {
        "classification": ("classification", F.lit("maybe")),
        "hash_format": ("source_sha256", F.lit("ABC")),
        "source_id": ("document_id", F.lit("kb:acme:source:wiki:other.md")),
        "id_does_not_bind_tags": ("document_id", F.lit("kb:acme:source:app:a.md")),
        "tag_reserved": ("tags", F.array_append("tags", F.lit("source:x"))),
        "tag_repeated": ("tags", F.array_append("tags", F.lit("topic:hr"))),
        "tag_scope_not_single": ("tags", F.array_append("tags", F.lit("scope:b"))),
        "metadata_differs": ("metadata", F.map_filter("metadata", lambda k, _: k != "operator")),
        "metadata_unsafe": ("metadata", F.map_concat("metadata", F.create_map(F.lit("apiToken"), F.lit("x")))),
        "redacted_without_locator": ("classification", F.lit("include_redacted")),
        "timeless_source": ("event_timestamp", F.lit("2026-09-01T17:20:00+02:00")),
        "relative_path": ("relative_path", F.lit("../a.md")),
    }
    frames = [entries.withColumn(c, F.when(a, v).otherwise(F.col(c))).withColumn("case", F.lit(name))
              for name, (c, v) in changes.items()]
    for name, frame in zip(changes, frames, strict=True):
        assert name in {r["violation"] for r in validate_entries(frame).collect()}, name


def test_digest_ignores_order_and_sees_changes(spark):
    snap = build(spark, {f"d{i}.md": f"text {i}" for i in range(40)}).compared
    one = snapshot_digest(snap).first()[0]
    assert snapshot_digest(snap.repartition(7).orderBy(F.rand(3))).first()[0] == one
    changed = snap.withColumn("reason", F.when(F.col("relative_path") == "d7.md", "x").otherwise(F.col("reason")))
    assert snapshot_digest(changed).first()[0] != one
    assert snapshot_digest(snap.union(snap.limit(1))).first()[0] != one


def test_profile_rules():
    for bad in (dict(operator="unknown"), dict(operator=""), dict(project_slug="A B"),
                dict(credential_policy="other"), dict(credential_policy="allow_project_staging"),
                dict(topics=("hr",)), dict(event_paths=("a", "b")), dict(credential_sources=("../a",))):
        with pytest.raises(ValueError):
            Profile(**{"project_slug": "acme", "operator": "alice", **bad})
