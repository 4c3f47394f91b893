"""Preflight, snapshots, events and exports over the documents and conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docwarden.functions import secrets
from docwarden.functions.paths import classify_path
from docwarden.functions.rewrite import matches
from docwarden.operators import entries as E, export, preflight as P, validation as V
from docwarden.operators.digests import fold_digests, row_digest
from docwarden.plans.export_batch import export_batch
from docwarden.plans.snapshot import Snapshot, build_snapshot
from docwarden.operators import provenance
from docwarden.session import materialize
from workloads import inputs as I, oracle as O
from workloads.registry import query


def scanned(spark, d: str, side: str) -> DataFrame:
    return P.preflight(I.corpus(spark, d, side))


def entries(spark, d: str, side: str) -> DataFrame:
    return E.scan_entries(I.corpus(spark, d, side), I.PROFILE)


def stored(spark, d: str) -> DataFrame:
    """The earlier snapshot as a table, as a run finds it."""
    return materialize(entries(spark, d, "prev").select(*E.ENTRY_COLUMNS), "previous")


def compared(spark, d: str) -> DataFrame:
    previous = stored(spark, d)
    current = entries(spark, d, "cur").select(*E.ENTRY_COLUMNS)
    return E.compare_snapshots(current, previous)


def snapshot(spark, d: str) -> Snapshot:
    previous = stored(spark, d)
    return build_snapshot(I.corpus(spark, d, "cur"), I.PROFILE, previous)


def joined(values: str | Column) -> Column:
    return F.array_join(values, ",")


@query("path_classification", f"{O.CUR} SELECT relative_path, path_rule AS rule FROM cur_scan")
def path_classification(spark, d):
    df = I.corpus(spark, d, "cur")
    return df.select("relative_path", classify_path(F.col("relative_path")).alias("rule"))


@query("preflight_decisions", f"{O.CUR} SELECT relative_path, decision FROM cur_scan")
def preflight_decisions(spark, d):
    return scanned(spark, d, "cur").select("relative_path", "decision")


@query("content_rule_hits", f"{O.CUR} SELECT relative_path, CAST(line AS INT) AS line, rule FROM cur_findings")
def content_rule_hits(spark, d):
    return scanned(spark, d, "cur").select("relative_path", F.inline("findings")).drop("disposition")


@query(
    "rule_histogram",
    f"{O.CUR} SELECT rule, count(*) AS findings FROM cur_findings GROUP BY rule",
)
def rule_histogram(spark, d):
    return P.rule_histogram(scanned(spark, d, "cur"))


@query(
    "redacted_text",
    f"{O.CUR} SELECT relative_path, sha256(redacted) AS text_sha256, octet_length(encode(redacted)) AS bytes"
    " FROM cur_scan WHERE decision = 'redacted'",
)
def redacted_text(spark, d):
    done = scanned(spark, d, "cur").filter("decision = 'redacted'")
    return done.select(
        "relative_path",
        F.sha2("exported_text", 256).alias("text_sha256"),
        F.octet_length("exported_text").cast("bigint").alias("bytes"),
    )


@query("entropy_assignments", O.ASSIGNMENTS)
def entropy_assignments(spark, d):
    """Every assignment of a long value with its character classes and entropy."""
    found = I.corpus(spark, d, "cur").filter(
        F.col("content").rlike(r"[:=]\s*[^\s#]{32}")
    )
    pairs = found.select(
        "doc_id", F.explode(matches(F.col("content"), secrets.OPAQUE_ASSIGNMENT)).alias("m")
    ).select(
        "doc_id",
        F.regexp_extract("m", secrets.OPAQUE_ASSIGNMENT, 1).alias("assignment_key"),
        F.regexp_extract("m", secrets.OPAQUE_ASSIGNMENT, 2).alias("value"),
    )
    value = F.col("value")
    return pairs.filter(F.length("value") >= 32).select(
        "doc_id",
        "assignment_key",
        F.sha2("value", 256).alias("value_sha256"),
        secrets.char_class_count(value).alias("classes"),
        F.round(secrets.shannon_entropy(value) * 10000).cast("bigint").alias("entropy_1e4"),
    )


@query(
    "entry_classification",
    f"{O.CUR} SELECT relative_path, classification, size, source_sha256, exported_sha256, document_id FROM cur_entries",
)
def entry_classification(spark, d):
    return entries(spark, d, "cur").select(
        "relative_path", "classification", "size", "source_sha256", "exported_sha256", "document_id"
    )


@query(
    "classification_counts",
    f"{O.CUR} SELECT classification, count(*) AS entries FROM cur_entries GROUP BY classification",
)
def classification_counts(spark, d):
    return E.classification_counts(entries(spark, d, "cur"))


@query(
    "tags_built",
    f"{O.CUR} SELECT document_id, {O.TAGS} AS tags, count(*) OVER (PARTITION BY document_id) AS copies"
    " FROM cur_entries WHERE document_id IS NOT NULL",
)
def tags_built(spark, d):
    rows = entries(spark, d, "cur").filter("document_id IS NOT NULL")
    return rows.groupBy("document_id").agg(
        F.max(joined("tags")).alias("tags"), F.count("*").alias("copies")
    )


@query(
    "metadata_built",
    f"""{O.CUR} SELECT relative_path, 'credential_policy=exclude'
      || CASE WHEN exported_sha256 IS NOT NULL THEN ',exported_sha256=' || exported_sha256 ELSE '' END
      || ',knowledge_layer=concept,operator=alice,project_slug=acme,source_modified_at=' || source_modified_at
      || ',source_path=' || relative_path || ',source_sha256=' || source_sha256
      || ',verification_status=verified' AS metadata FROM cur_entries""",
)
def metadata_built(spark, d):
    pairs = F.transform(F.map_entries("metadata"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return entries(spark, d, "cur").select("relative_path", joined(pairs).alias("metadata"))


@query(
    "delta_status",
    f"{O.BOTH} SELECT relative_path, document_id, delta, renamed_from FROM entries",
)
def delta_status(spark, d):
    return (
        compared(spark, d)
        .filter("section = 'entry'")
        .select("relative_path", "document_id", "delta", "renamed_from")
    )


@query(
    "delta_counts",
    f"{O.BOTH} SELECT delta, count(*) AS entries FROM (SELECT delta FROM entries UNION ALL"
    " SELECT 'deleted' FROM deleted) GROUP BY delta",
)
def delta_counts(spark, d):
    return E.delta_counts(compared(spark, d))


@query(
    "renames",
    f"{O.BOTH} SELECT document_id, renamed_from FROM entries WHERE delta = 'renamed'",
)
def renames(spark, d):
    return compared(spark, d).filter("delta = 'renamed'").select("document_id", "renamed_from")


@query("deleted_documents", f"{O.BOTH} SELECT document_id, relative_path FROM deleted")
def deleted_documents(spark, d):
    return compared(spark, d).filter("section = 'deleted'").select("document_id", "relative_path")


@query(
    "snapshot_flagship",
    f"""{O.BOTH} SELECT classification, delta, count(*) AS entries, CAST(sum(size) AS BIGINT) AS bytes FROM (
      SELECT classification, delta, size FROM entries
      UNION ALL SELECT classification, 'deleted', size FROM deleted) GROUP BY classification, delta""",
)
def snapshot_flagship(spark, d):
    """The whole plan: scan, classify, compare with the stored snapshot, write."""
    return (
        snapshot(spark, d).compared
        .groupBy("classification", "delta")
        .agg(F.count("*").alias("entries"), F.sum("size").alias("bytes"))
    )


@query(
    "eligible_entries",
    f"{O.BOTH} SELECT document_id, delta FROM entries WHERE document_id IS NOT NULL AND delta <> 'unchanged'",
)
def eligible_entries(spark, d):
    current = compared(spark, d).filter("section = 'entry'")
    return E.eligible(current).select("document_id", "delta")


@query(
    "duplicate_ids",
    """SELECT 'kb:acme:source:lines:' || l_orderkey || '/' || l_linenumber AS document_id, count(*) AS copies
       FROM lineitem GROUP BY 1 HAVING count(*) > 1""",
)
def duplicate_ids(spark, d):
    ids = I.sql(
        spark, d,
        "SELECT 'kb:acme:source:lines:' || l_orderkey || '/' || l_linenumber AS document_id FROM {lineitem}",
        "lineitem",
    )
    return E.duplicate_ids(ids)


@query(
    "snapshot_violations",
    f"""{O.BOTH} SELECT document_id, 'duplicate_document_id' AS violation FROM (
        SELECT document_id FROM entries WHERE document_id IS NOT NULL
        UNION ALL SELECT document_id FROM deleted) GROUP BY document_id HAVING count(*) > 1""",
)
def snapshot_violations(spark, d):
    return snapshot(spark, d).violations


FAULTS = {
    "hash_format": ("doc_id % 7 = 0", "source_sha256", "upper(source_sha256)"),
    "delta": ("doc_id % 11 = 1", "delta", "'moved'"),
    "timeless_source": ("doc_id % 13 = 2", "event_timestamp", "'2026-09-01T10:00:00+02:00'"),
    "export_path": ("doc_id % 17 = 3", "export_path", "'../' || relative_path"),
}


@query(
    "entry_violations",
    f"""{O.CUR}, faulty AS (SELECT s.doc_id, e.* FROM cur_entries e JOIN cur_src s USING (relative_path))
      SELECT relative_path, 'hash_format' AS violation FROM faulty WHERE doc_id % 7 = 0
      UNION ALL SELECT relative_path, 'metadata_differs' FROM faulty WHERE doc_id % 7 = 0 AND document_id IS NOT NULL
      UNION ALL SELECT relative_path, 'delta' FROM faulty WHERE doc_id % 11 = 1
      UNION ALL SELECT relative_path, 'timeless_source' FROM faulty WHERE doc_id % 13 = 2 AND document_id IS NOT NULL
      UNION ALL SELECT relative_path, 'export_path' FROM faulty WHERE doc_id % 17 = 3
      UNION ALL SELECT relative_path, 'ineligible_with_id' FROM faulty WHERE doc_id % 17 = 3 AND document_id IS NULL""",
)
def entry_violations(spark, d):
    """Entries with planted faults; each fault breaks exactly the rules it should."""
    ids = I.corpus(spark, d, "cur").select("relative_path", "doc_id")
    rows = entries(spark, d, "cur").join(ids, "relative_path")
    for when, column, value in FAULTS.values():
        rows = rows.withColumn(
            column, F.when(F.expr(when), F.expr(value)).otherwise(F.col(column))
        )
    return V.validate_entries(rows).select("relative_path", "violation")


TAG_LIST = """array('user:alice', 'project:acme', 'scope:wiki', 'trust:verified',
  CASE WHEN doc_id % 5 = 0 THEN 'kind:other' ELSE 'kind:source' END,
  CASE WHEN doc_id % 7 = 0 THEN 'knowledge:Bad Layer' ELSE 'knowledge:concept' END,
  CASE WHEN doc_id % 11 = 0 THEN 'scope:app' ELSE 'topic:a' END,
  CASE WHEN doc_id % 13 = 0 THEN 'source:x' ELSE 'topic:b' END,
  CASE WHEN doc_id % 17 = 0 THEN 'topic:b' ELSE 'topic:c' END,
  CASE WHEN doc_id % 19 = 0 THEN 'plain' ELSE 'topic:d' END,
  CASE WHEN doc_id % 23 = 0 THEN 'password:x' ELSE 'topic:' || source END)"""


@query(
    "tag_violations",
    """SELECT doc_id, 'tag_kind' AS violation FROM documents WHERE doc_id % 5 = 0
      UNION ALL SELECT doc_id, 'tag_component' FROM documents WHERE doc_id % 7 = 0
      UNION ALL SELECT doc_id, 'tag_scope_not_single' FROM documents WHERE doc_id % 11 = 0
      UNION ALL SELECT doc_id, 'tag_reserved' FROM documents WHERE doc_id % 13 = 0
      UNION ALL SELECT doc_id, 'tag_repeated' FROM documents WHERE doc_id % 17 = 0 AND doc_id % 13 <> 0
      UNION ALL SELECT doc_id, 'tag_without_namespace' FROM documents WHERE doc_id % 19 = 0
      UNION ALL SELECT doc_id, 'tag_unsafe' FROM documents WHERE doc_id % 23 = 0""",
)
def tag_violations(spark, d):
    rows = I.sql(spark, d, f"SELECT doc_id, {TAG_LIST} AS tags FROM {{documents}}", "documents")
    return V.validate_tags(rows, ["doc_id"])


@query(
    "attribution_check",
    f"""{O.CUR} SELECT document_id FROM cur_entries JOIN cur_src USING (relative_path)
      WHERE document_id IS NOT NULL AND doc_id % 6 = 0""",
)
def attribution_check(spark, d):
    ids = I.corpus(spark, d, "cur").select("relative_path", "doc_id")
    rows = entries(spark, d, "cur").filter("document_id IS NOT NULL").join(ids, "relative_path")
    stale = F.transform("tags", lambda t: F.when(t == "user:alice", "user:bob").otherwise(t))
    rows = rows.withColumn("tags", F.when(F.expr("doc_id % 6 = 0"), stale).otherwise(F.col("tags")))
    return V.attribution_check(rows, "alice").select("document_id")


@query(
    "snapshot_digest",
    f"""{O.BOTH}, rows AS (
      SELECT sha256('{{"delta":"' || delta || '","document_id":"' || document_id || '","source_sha256":"' || source_sha256 || '"}}') AS digest
      FROM (SELECT delta, document_id, source_sha256 FROM entries WHERE document_id IS NOT NULL
            UNION ALL SELECT 'deleted', document_id, source_sha256 FROM deleted)),
    leaf AS (SELECT substr(digest, 1, 4) AS b, digest || ':' || count(*) AS t FROM rows GROUP BY digest),
    l2 AS (SELECT b, sha256(string_agg(t, chr(10) ORDER BY t)) AS h FROM leaf GROUP BY b),
    l1 AS (SELECT substr(b, 1, 2) AS b, sha256(string_agg(b || ':' || h, chr(10) ORDER BY b)) AS h FROM l2 GROUP BY 1),
    l0 AS (SELECT sha256(string_agg(b || ':' || h, chr(10) ORDER BY b)) AS digest FROM l1)
    SELECT digest FROM l0""",
)
def snapshot_digest(spark, d):
    rows = compared(spark, d).filter("document_id IS NOT NULL")
    columns = {c: F.col(c) for c in ("delta", "document_id", "source_sha256")}
    return fold_digests(rows.select(row_digest(columns).alias("digest")))


# --- logbook events ------------------------------------------------------------------------
def _books(spark, d: str, side: str, previous: DataFrame | None = None) -> DataFrame:
    books = E.scan_entries(I.logbooks(spark, d, side), I.LOGBOOK_PROFILE)
    # Every logbook is an event path here.
    books = books.withColumns({"_event": F.lit(True), "_event_scope": F.lit("project-logbook")})
    return E.event_entries(books, I.LOGBOOK_PROFILE, previous)


@query(
    "events_split",
    f"""{O.EVENTS} SELECT identity AS document_id, event_timestamp, sha256(chunk) AS source_sha256,
      octet_length(encode(chunk)) AS size, 'events/' || substr(sha256(relative_path), 1, 16) || '/' || sha256(identity) || '.md' AS export_path
      FROM cur_events""",
)
def events_split(spark, d):
    return _books(spark, d, "cur").select(
        "document_id", "event_timestamp", "source_sha256", "size", "export_path"
    )


@query(
    "event_identity_reuse",
    f"""{O.EVENTS} SELECT p.identity AS document_id, c.identity AS heading_identity, c.event_timestamp
      FROM cur_events c JOIN prev_events p ON c.relative_path = p.relative_path AND c.event_timestamp = p.event_timestamp""",
)
def event_identity_reuse(spark, d):
    previous = materialize(_books(spark, d, "prev").select(*E.ENTRY_COLUMNS), "previous")
    return _books(spark, d, "cur", previous).select(
        "document_id", F.col("_identity").alias("heading_identity"), "event_timestamp"
    )


@query(
    "event_deltas",
    f"""{O.EVENTS} SELECT CASE WHEN p.identity = c.identity AND sha256(p.chunk) = sha256(c.chunk) THEN 'unchanged' ELSE 'changed' END AS delta,
        count(*) AS entries
      FROM cur_events c JOIN prev_events p ON c.relative_path = p.relative_path AND c.event_timestamp = p.event_timestamp
      GROUP BY 1""",
)
def event_deltas(spark, d):
    previous = materialize(_books(spark, d, "prev").select(*E.ENTRY_COLUMNS), "previous")
    current = _books(spark, d, "cur", previous).select(*E.ENTRY_COLUMNS)
    return E.delta_counts(E.compare_snapshots(current, previous))


# --- export --------------------------------------------------------------------------------
def _items(spark, d: str) -> DataFrame:
    snap = snapshot(spark, d)
    return export.export_items(
        snap.entries, I.corpus(spark, d, "cur"), snap.staged,
        exported_at="2026-09-02T08:00:00+00:00", run_id="run-1",
    )


_DUE = "FROM entries WHERE document_id IS NOT NULL AND delta <> 'unchanged'"


@query(
    "export_items",
    f"""{O.BOTH} SELECT document_id, 'project knowledge: concept' AS context, 'unset' AS timestamp,
      sha256(exported_text) AS content_sha256, 'run-1' AS export_run_id, 'shared' AS observation_scopes {_DUE}""",
)
def export_items(spark, d):
    return _items(spark, d).select(
        "document_id", "context", "timestamp",
        F.sha2("content", 256).alias("content_sha256"),
        F.element_at("metadata", "export_run_id").alias("export_run_id"),
        "observation_scopes",
    )


@query(
    "batch_totals",
    f"{O.BOTH} SELECT count(*) AS item_count, CAST(sum(octet_length(encode(exported_text))) AS BIGINT) AS total_bytes {_DUE}",
)
def batch_totals(spark, d):
    return export.batch_totals(_items(spark, d))


@query(
    "approval_reconciliation",
    f"""{O.BOTH}, actual AS (SELECT document_id {_DUE}),
      approved AS (SELECT document_id FROM prev_entries WHERE document_id IS NOT NULL)
      SELECT coalesce(a.document_id, p.document_id) AS document_id,
        CASE WHEN p.document_id IS NULL THEN 'extra' WHEN a.document_id IS NULL THEN 'missing' ELSE 'matched' END AS status
      FROM actual a FULL OUTER JOIN approved p ON a.document_id = p.document_id""",
)
def approval_reconciliation(spark, d):
    approved = entries(spark, d, "prev").filter("document_id IS NOT NULL").select("document_id")
    current = compared(spark, d).filter("section = 'entry'")
    return export.identity_approval(current, approved)


@query(
    "retain_summary",
    f"""{O.BOTH} SELECT count(*) FILTER (document_id IS NOT NULL AND delta <> 'unchanged') AS submitted,
      count(*) FILTER (document_id IS NULL OR delta = 'unchanged') AS unchanged_or_ineligible,
      (SELECT count(*) FROM deleted) AS deleted_reported,
      CASE WHEN count(*) FILTER (document_id IS NOT NULL AND delta <> 'unchanged') = 0 THEN 'no_op' ELSE 'ready' END AS status
      FROM entries""",
)
def retain_summary(spark, d):
    return export.retain_summary(compared(spark, d))




@query(
    "id_collisions",
    """SELECT lang || '/' || (doc_id // 2) AS folded_id, count(*) AS copies FROM documents
       GROUP BY 1 HAVING count(*) > 1""",
)
def id_collisions(spark, d):
    ids = I.sql(
        spark, d,
        "SELECT CASE WHEN doc_id % 2 = 0 THEN upper(lang) ELSE lang END || '/' || (doc_id div 2)"
        " AS document_id FROM {documents}",
        "documents",
    )
    return export.id_collisions(ids)


@query(
    "snapshot_verify",
    f"""{O.BOTH} SELECT c.document_id,
        CASE WHEN p.relative_path IS NULL THEN 'missing' WHEN p.source_sha256 <> c.source_sha256 THEN 'mismatch' ELSE 'ok' END AS source_status,
        CASE WHEN c.exported_sha256 IS NULL THEN 'none'
             WHEN p.exported_sha256 IS NULL THEN 'missing'
             WHEN p.exported_sha256 <> c.exported_sha256 THEN 'mismatch' ELSE 'ok' END AS staged_status
      FROM cur_entries c LEFT JOIN prev_entries p USING (relative_path) WHERE c.document_id IS NOT NULL""",
)
def snapshot_verify(spark, d):
    """The current snapshot against the earlier files and staged texts."""
    current = entries(spark, d, "cur")
    earlier = entries(spark, d, "prev")
    hashes = provenance.corpus_hashes(I.corpus(spark, d, "prev"))
    staged = earlier.filter("export_path IS NOT NULL").select(
        "export_path", F.sha2("exported_text", 256).alias("sha256")
    )
    return provenance.verify_snapshot(current, hashes, staged).drop("relative_path")


@query(
    "freshness",
    f"""WITH {O.scan('prev')}, {O.scan('cur')} SELECT p.document_id,
        CASE WHEN c.relative_path IS NULL THEN 'gone' WHEN c.source_sha256 = p.source_sha256 THEN 'fresh' ELSE 'stale' END AS freshness
      FROM prev_entries p LEFT JOIN cur_entries c USING (relative_path) WHERE p.document_id IS NOT NULL""",
)
def freshness(spark, d):
    retained = entries(spark, d, "prev").filter("document_id IS NOT NULL").select(
        "document_id", F.col("relative_path").alias("source_path"), "source_sha256"
    )
    hashes = provenance.corpus_hashes(I.corpus(spark, d, "cur"))
    return provenance.freshness_check(retained, hashes).select("document_id", "freshness")


# --- derived records -----------------------------------------------------------------------
# A record cites the document it is about; some cite a wrong hash or an unsafe or unknown path.
CITED = """CASE WHEN doc_id % 9 = 1 THEN relative_path || '/' WHEN doc_id % 9 = 2 THEN 'nowhere/' || relative_path
  WHEN doc_id % 9 = 3 THEN '../' || relative_path ELSE relative_path END"""


def _cited(sha) -> str:
    hash_sql = f"CASE WHEN doc_id % 9 = 4 THEN {sha('relative_path')} WHEN doc_id % 9 = 5 THEN 'none' ELSE {sha('content')} END"
    return f"'rec-' || doc_id AS document_id, {CITED} AS source_path, {hash_sql} AS source_sha256"


@query(
    "provenance_check",
    f"""{O.CUR} SELECT 'rec-' || doc_id AS document_id, CASE doc_id % 9 WHEN 5 THEN 'incomplete' WHEN 1 THEN 'non_canonical'
      WHEN 3 THEN 'non_canonical' WHEN 2 THEN 'missing' WHEN 4 THEN 'mismatch' ELSE 'ok' END AS status FROM cur_src""",
)
def provenance_check(spark, d):
    docs = I.corpus(spark, d, "cur")
    records = docs.selectExpr(*_split_sql(_cited(I.spark_sha)))
    return provenance.verify_provenance(records, provenance.corpus_hashes(docs)).select(
        "document_id", "status"
    )


def _split_sql(text: str) -> list[str]:
    """Three aliased expressions of ``_cited``; aliases end each of them."""
    first, rest = text.split(" AS document_id, ")
    second, third = rest.split(" AS source_path, ")
    return [f"{first} AS document_id", f"{second} AS source_path", third]


def _dossiers(spark, d: str) -> DataFrame:
    """One record per document, citing it and its neighbours; every seventh is tampered with."""
    docs = I.corpus(spark, d, "cur").select(
        "doc_id", "relative_path", F.sha2("content", 256).alias("sha")
    )
    follower = docs.select(
        (F.col("doc_id") - 1).alias("doc_id"),
        F.col("relative_path").alias("next_path"),
        F.col("sha").alias("next_sha"),
    )
    pairs = docs.join(follower, "doc_id")
    kind = F.col("doc_id") % 7
    second = F.when(kind == 1, F.col("sha")).otherwise(F.col("next_sha"))
    second_path = F.when(kind == 2, F.col("relative_path")).otherwise(F.col("next_path"))
    item = lambda p, s: F.concat(
        F.lit('{"source_path":"'), p, F.lit('","source_sha256":"'), s, F.lit('"}')
    )
    evidence = F.concat(
        F.lit("["), item(F.col("relative_path"), F.col("sha")), F.lit(","),
        item(F.col("next_path"), second), F.lit("]"),
    )
    listed = F.concat(
        F.lit('["'), "relative_path", F.lit('","'), second_path, F.lit('"]')
    )
    return pairs.select(
        F.concat(F.lit("kb:acme:dossier:"), "doc_id").alias("document_id"),
        F.when(kind == 3, "graph_projection").otherwise("dossier").alias("kind"),
        F.create_map(
            F.lit("source_paths"), listed,
            F.lit("evidence"), evidence,
            F.lit("source_sha256"),
            F.when(kind == 4, F.sha2("sha", 256)).otherwise(F.sha2(evidence, 256)),
        ).alias("metadata"),
    )


@query(
    "evidence_check",
    f"""{O.CUR} SELECT 'kb:acme:dossier:' || a.doc_id AS document_id,
      CASE a.doc_id % 7 WHEN 3 THEN 'only_for_dossiers' WHEN 2 THEN 'not_an_ordered_unique_list'
        WHEN 1 THEN CASE WHEN a.content = b.content THEN 'ok' ELSE 'source_differs' END
        WHEN 4 THEN 'aggregate_differs' ELSE 'ok' END AS status
      FROM cur_src a JOIN cur_src b ON b.doc_id = a.doc_id + 1""",
)
def evidence_check(spark, d):
    hashes = provenance.corpus_hashes(I.corpus(spark, d, "cur"))
    return provenance.verify_evidence(_dossiers(spark, d), hashes).select("document_id", "status")


@query(
    "derived_validation",
    f"""{O.CUR}, facts AS (SELECT * FROM cur_scan)
      SELECT 'kb:acme:graph:' || doc_id AS document_id, 'tag_identity' AS violation FROM facts WHERE doc_id % 5 = 0
      UNION ALL SELECT 'kb:acme:graph:' || doc_id, 'metadata_conflicts_with_tags' FROM facts WHERE doc_id % 7 = 0
      UNION ALL SELECT 'kb:acme:graph:' || doc_id, 'event_timestamp' FROM facts WHERE doc_id % 11 = 1
      UNION ALL SELECT 'kb:acme:graph:' || doc_id, 'metadata_unsafe' FROM facts WHERE doc_id % 13 = 1
      UNION ALL SELECT 'kb:acme:graph:' || doc_id, 'provenance_mismatch' FROM facts WHERE doc_id % 9 = 4
      UNION ALL SELECT 'kb:acme:graph:' || doc_id, 'unsafe_content' FROM facts
        WHERE pem_line > 0 OR opaque OR len(assign_lines) + len(bearer_lines) > 0""",
)
def derived_validation(spark, d):
    docs = I.corpus(spark, d, "cur")
    sha = F.sha2("content", 256)
    records = docs.select(
        F.concat(F.lit("kb:acme:graph:"), "doc_id").alias("document_id"),
        "content",
        F.array(
            F.when(F.expr("doc_id % 5 = 0"), "user:bob").otherwise("user:alice"),
            F.lit("project:acme"), F.lit("kind:graph_projection"), F.lit("scope:wiki"),
            F.lit("trust:derived"), F.lit("knowledge:component"),
        ).alias("tags"),
        F.map_filter(
            F.create_map(
                F.lit("operator"), F.lit("alice"), F.lit("project_slug"), F.lit("acme"),
                F.lit("generator"), F.lit("g"), F.lit("generator_version"), F.lit("1"),
                F.lit("knowledge_layer"),
                F.when(F.expr("doc_id % 7 = 0"), "risk").otherwise("component"),
                F.lit("verification_status"), F.lit("derived"),
                F.lit("source_path"), F.col("relative_path"),
                F.lit("source_sha256"),
                F.when(F.expr("doc_id % 9 = 4"), F.sha2("relative_path", 256)).otherwise(sha),
                F.lit("password"), F.when(F.expr("doc_id % 13 = 1"), "x"),
            ),
            lambda _, v: v.isNotNull(),
        ).alias("metadata"),
        F.when(F.expr("doc_id % 11 = 1"), "2026-09-01T10:00:00").alias("event_timestamp"),
    )
    return export.validate_derived(
        records, provenance.corpus_hashes(docs), project="acme", operator="alice"
    )


@query(
    "export_batch",
    f"""{O.BOTH}, due AS (SELECT document_id {_DUE})
      SELECT status, count(*) AS ids FROM (
        SELECT CASE WHEN p.document_id IS NULL THEN 'extra' WHEN a.document_id IS NULL THEN 'missing' ELSE 'matched' END AS status
        FROM due a FULL OUTER JOIN (SELECT document_id FROM cur_entries WHERE document_id IS NOT NULL) p
          ON a.document_id = p.document_id) GROUP BY status""",
)
def export_batch_approval(spark, d):
    """Approval status of a whole batch, built with its second scan and byte checks."""
    snap = snapshot(spark, d)
    approved = entries(spark, d, "cur").filter("document_id IS NOT NULL").select("document_id")
    batch = export_batch(
        snap.entries, I.corpus(spark, d, "cur"), snap.staged, approved,
        project="acme", operator="alice", exported_at="2026-09-02T08:00:00+00:00", run_id="run-1",
    )
    return batch.approval.groupBy("status").agg(F.count("*").alias("ids"))


@query(
    "export_batch_order",
    f"""{O.BOTH}, due AS (SELECT document_id, row_number() OVER (ORDER BY document_id) AS position {_DUE}),
      a AS (SELECT document_id, position + CASE WHEN position % 10 = 3 THEN 1 ELSE 0 END AS position FROM due WHERE position % 10 <> 7
        UNION ALL SELECT document_id, position FROM due WHERE position % 10 = 5)
      SELECT document_id, CASE WHEN a.document_id IS NULL THEN 'extra' WHEN n > 1 THEN 'repeated'
          WHEN a.position <> due.position THEN 'out_of_order' ELSE 'matched' END AS status
      FROM due LEFT JOIN (SELECT document_id, min(position) AS position, count(*) AS n FROM a GROUP BY document_id) a USING (document_id)
      UNION ALL SELECT 'total', 'item_count_differs' UNION ALL SELECT 'total', 'total_bytes_differ'""",
)
def export_batch_order(spark, d):
    """An approval that shifts, leaves out and repeats ids and states other totals."""
    snap = snapshot(spark, d)
    due = E.eligible(snap.entries).select("document_id").withColumn("section", F.lit(0))
    right = export.batch_positions(due)
    at = F.col("position")
    shifted = right.filter(at % 10 != 7).withColumn("position", at + F.when(at % 10 == 3, 1).otherwise(0))
    batch = export_batch(
        snap.entries, I.corpus(spark, d, "cur"), snap.staged, shifted.unionByName(right.filter(at % 10 == 5)),
        project="acme", operator="alice", exported_at="2026-09-02T08:00:00+00:00", run_id="run-1", approved_totals=(-1, -1),
    )
    totals = batch.violations.select(F.coalesce("document_id", F.lit("total")).alias("document_id"), F.col("violation").alias("status"))
    return batch.approval.unionByName(totals)


@query(
    "export_batch_violations",
    f"""{O.BOTH} SELECT document_id, 'bytes_differ_from_snapshot' AS violation FROM entries WHERE exported_sha256 IS NOT NULL
      UNION ALL SELECT document_id, 'unsafe_content' FROM entries WHERE exported_sha256 IS NOT NULL AND delta <> 'unchanged'""",
)
def export_batch_violations(spark, d):
    """Staged texts replaced by the originals: their bytes and their content are refused."""
    snap = snapshot(spark, d)
    docs = I.corpus(spark, d, "cur")
    originals = snap.staged.select("export_path").join(
        docs.select(F.col("relative_path").alias("export_path"), "content"), "export_path"
    )
    approved = entries(spark, d, "cur").filter("document_id IS NOT NULL").select("document_id")
    return export_batch(
        snap.entries, docs, originals, approved,
        project="acme", operator="alice", exported_at="2026-09-02T08:00:00+00:00", run_id="run-1",
    ).violations


@query(
    "candidate_check",
    """SELECT relative_path, 'duplicate' AS violation FROM (
         SELECT 'wiki/' || source || '/' || (doc_id % 50) || CASE WHEN doc_id % 3 = 0 THEN '/../x' ELSE '' END AS relative_path FROM documents)
       GROUP BY relative_path HAVING count(*) > 1
       UNION ALL SELECT 'wiki/' || source || '/' || (doc_id % 50) || '/../x', 'outside_root' FROM documents WHERE doc_id % 3 = 0""",
)
def candidate_check(spark, d):
    from docwarden.sources.corpus import candidate_violations

    listed = I.sql(
        spark, d,
        "SELECT 'wiki/' || source || '/' || (doc_id % 50) || CASE WHEN doc_id % 3 = 0 THEN '/../x' ELSE '' END"
        " AS relative_path FROM {documents}",
        "documents",
    )
    return candidate_violations(listed)


@query(
    "candidate_scan",
    f"""WITH {O.scan('prev')}, {O.scan('cur')} SELECT p.relative_path,
        CASE WHEN c.relative_path IS NULL THEN 'blocked_review' ELSE c.classification END AS classification
      FROM prev_entries p LEFT JOIN cur_entries c USING (relative_path)""",
)
def candidate_scan(spark, d):
    """Earlier paths as candidates; those that are gone are blocked for review."""
    from docwarden.sources.corpus import candidate_filter

    listed = I.corpus(spark, d, "prev").select("relative_path")
    found = candidate_filter(I.corpus(spark, d, "cur"), listed)
    return E.scan_entries(found, I.PROFILE).select("relative_path", "classification")
