"""Sources and sinks: what is written to the shared folder and read back, beside SQL over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from docwarden.operators import export, preflight as P
from docwarden.operators.digests import fold_digests
from docwarden.sources import corpus as C, tables as S
from workloads import corpus_queries as Q, inputs as I, oracle as O
from workloads.registry import query
from workloads.scratch import scratch_folder


@query(
    "corpus_scan",
    "SELECT sha256(text || chr(10)) AS source_sha256, octet_length(encode(text)) + 1 AS size, count(*) AS files FROM documents GROUP BY ALL",
)
def corpus_scan(spark, d):
    """Every document as a file of its own."""
    folder = scratch_folder(spark, "files")
    texts = I.table(spark, d, "documents").select("text")
    C.write_text_files(texts, folder)
    return C.scan_corpus(spark, folder, glob="*.txt").groupBy("source_sha256", "size").agg(F.count("*").alias("files"))


@query(
    "snapshot_round_trip",
    f"""{O.BOTH} SELECT relative_path, classification, delta, source_sha256, 'entry' AS section FROM entries
      UNION ALL SELECT relative_path, classification, 'deleted', source_sha256, 'deleted' FROM deleted""",
)
def snapshot_round_trip(spark, d):
    """Written with its digest, read back with the digest checked."""
    folder = scratch_folder(spark, "snapshot")
    S.write_snapshot(Q.snapshot(spark, d).compared, folder, "run-1")
    return S.read_snapshot(spark, folder, "run-1").select("relative_path", "classification", "delta", "source_sha256", "section")


@query("staged_round_trip", f"{O.CUR} SELECT exported_sha256, count(*) AS texts FROM cur_entries WHERE classification = 'include_redacted' GROUP BY 1")
def staged_round_trip(spark, d):
    folder = scratch_folder(spark, "staged")
    S.stage_exports(Q.snapshot(spark, d).staged, folder, "run-1")
    return S.read_staged(spark, folder, "run-1").groupBy(F.sha2("content", 256).alias("exported_sha256")).agg(F.count("*").alias("texts"))


@query("bucketed_items", f"{O.BOTH} SELECT document_id, sha256(exported_text) AS content_sha256 {Q._DUE}")
def bucketed_items(spark, d):
    """Contents from a table of buckets by path, which the join does not move."""
    folder = scratch_folder(spark, "bucketed")
    table = f"corpus_{folder.rpartition('-')[2]}"
    corpus = C.write_bucketed_corpus(I.corpus(spark, d, "cur"), table, folder, buckets=32)
    snap = Q.snapshot(spark, d)
    items = export.export_items(snap.entries, corpus, snap.staged, exported_at="2026-09-01T12:00:00+02:00", run_id="run-1")
    return items.select("document_id", F.sha2("content", 256).alias("content_sha256"))


@query(
    "audit_log",
    """SELECT 'user-' || user_id AS operation_id, event_type AS phase, CASE WHEN event_type <> 'view' THEN event_id END AS item_count FROM events
      WHERE event_type NOT IN ('error', 'signup')""",
)
def audit_log(spark, d):
    """Events as JSON lines; those with a secret or that are no object are left out."""
    folder = scratch_folder(spark, "audit")
    S.append_audit(log_events(spark, d), folder, key="event_id", json="event", strict=False)
    return S.read_audit(spark, folder).select("operation_id", "phase", "item_count")


def log_events(spark, d):
    return I.table(spark, d, "events").select("event_id", F.expr(
        """CASE event_type WHEN 'error' THEN '{"operation_id": "x", "note": "password: p' || event_id || '"}' WHEN 'signup' THEN '[' || event_id || ']'
           ELSE to_json(named_struct('operation_id', 'user-' || user_id, 'phase', event_type, 'item_count', if(event_type = 'view', null, event_id))) END"""
    ).alias("event"))


@query(
    "observed_totals",
    f"""{O.CUR} SELECT (SELECT count(*) FROM events WHERE event_type NOT IN ('error', 'signup')) AS appended,
      (SELECT count(*) FROM events WHERE event_type = 'error') AS secret, (SELECT count(*) FROM events WHERE event_type = 'signup') AS not_an_object,
      count(*) AS item_count, sum(octet_length(encode(exported_text)))::BIGINT AS total_bytes FROM cur_entries WHERE document_id IS NOT NULL""",
)
def observed_totals(spark, d):
    """Counted by the jobs that write the log and the exported texts."""
    logged = S.append_audit_counted(log_events(spark, d), scratch_folder(spark, "audit"), json="event")
    items = Q.scanned(spark, d, "cur").filter("exported_text IS NOT NULL").select("relative_path", F.col("exported_text").alias("content"))
    written = S.write_items(items, scratch_folder(spark, "items"))
    totals = logged | written
    return spark.createDataFrame([totals], ", ".join(f"{name} long" for name in totals))


@query("graph_read", f"SELECT type, confidence, count(*) AS edges, count(DISTINCT source) AS sources FROM ({O.EDGES}) GROUP BY ALL")
def graph_read(spark, d):
    """Nodes and edges as JSON lines with a field that the schema does not know."""
    folder = scratch_folder(spark, "graph")
    nodes, edges = I.sql(spark, d, I.NODES, *I.NODE_TABLES), I.sql(spark, d, I.EDGES, *I.EDGE_TABLES)
    nodes.withColumn("extra", F.lit(1)).write.json(f"{folder}/nodes", compression="gzip")
    edges.withColumn("extra", F.lit(1)).write.json(f"{folder}/edges", compression="gzip")
    _, read = S.read_graph(spark, f"{folder}/nodes", f"{folder}/edges", format="json")
    return read.groupBy("type", "confidence").agg(F.count("*").alias("edges"), F.count_distinct("source").alias("sources"))


@query(
    "derived_read",
    "SELECT 'kb:acme:dossier:' || o_orderkey AS document_id, o_orderpriority AS content, 'kind:dossier' AS tag, o_custkey::VARCHAR AS customer FROM orders",
)
def derived_read(spark, d):
    """A batch of derived records, bound to the hash of its files."""
    folder = scratch_folder(spark, "derived")
    records = I.table(spark, d, "orders").select(
        F.concat(F.lit("kb:acme:dossier:"), "o_orderkey").alias("document_id"), F.col("o_orderpriority").alias("content"),
        F.array(F.lit("kind:dossier")).alias("tags"), F.create_map(F.lit("customer"), F.col("o_custkey").cast("string")).alias("metadata"),
    )
    records.write.json(folder)
    approved = fold_digests(S.file_hashes(spark, folder), column="sha256").head()[0]
    read = S.read_derived_batch(spark, folder, expected_sha256=approved)
    return read.select("document_id", "content", F.col("tags")[0].alias("tag"), F.col("metadata")["customer"].alias("customer"))


@query(
    "content_type_rules",
    """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'binary_content' WHEN 1 THEN 'undecodable_content' WHEN 2 THEN 'binary_content' END AS rule
      FROM documents WHERE doc_id % 6 < 3""",
)
def content_type_rules(spark, d):
    """Bytes: a zero byte at the end, a byte that is no UTF-8, both, or plain text."""
    raw, key = F.col("text").cast("binary"), F.col("doc_id") % 6
    tail = F.when(key == 0, F.unhex(F.lit("00"))).when(key == 1, F.unhex(F.lit("FF"))).when(key == 2, F.unhex(F.lit("FF00"))).otherwise(F.unhex(F.lit("")))
    docs = I.table(spark, d, "documents").select("doc_id", F.concat(F.lit("wiki/"), "doc_id", F.lit(".md")).alias("relative_path"), F.concat(raw, tail).alias("content"))
    found = P.preflight(docs).select("doc_id", F.explode("findings.rule").alias("rule"))
    return found.filter(F.col("rule").isin("binary_content", "undecodable_content"))


@query(
    "credential_policy",
    f"""{O.CUR} SELECT relative_path, CASE WHEN doc_id % 4 <> 0 THEN decision
        WHEN path_rule IS NOT NULL AND path_rule <> 'path_environment_file' THEN 'blocked' ELSE 'safe' END AS decision FROM cur_scan""",
)
def credential_policy(spark, d):
    """Every fourth document is held under a policy that keeps its credentials."""
    policy = F.when(F.col("doc_id") % 4 == 0, "allow_project_staging").otherwise("exclude")
    return P.preflight(I.corpus(spark, d, "cur"), policy=policy).select("relative_path", "decision")
