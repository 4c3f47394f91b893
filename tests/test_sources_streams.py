"""Files, tables, the audit log and the streaming twins."""

import hashlib
import json
import shutil

import pytest
from pyspark.sql import functions as F

from docwarden.operators import audit as A, entries as E
from docwarden.operators.checks import ViolationError
from docwarden.operators.profile import Profile
from docwarden.operators.validation import validate_profiles
from docwarden.plans.export_batch import export_batch
from docwarden.plans.snapshot import build_snapshot
from docwarden.sources import corpus as C, tables as S
from docwarden.streaming import jobs
from workloads import inputs as I, source_queries

PROFILE = Profile(project_slug="acme", operator="alice", scope="wiki")


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    files = {"wiki/a.md": b"fine\n", "wiki/b.md": b"password: hunter2\n", "wiki/c.bin": b"\x00\x01",
             "vendor/d.md": b"x", "e.md": b"\xff"}
    for name, raw in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(raw)
    return root, files


def test_scan_and_snapshot_round_trip(spark, tree, tmp_path):
    root, files = tree
    listed = spark.createDataFrame([(n,) for n in files] + [("wiki/gone.md",)], "relative_path string")
    docs = C.scan_corpus(spark, str(root), candidates=listed)
    got = {r["relative_path"]: r for r in docs.collect()}
    assert set(got) == {*files, "wiki/gone.md"}
    assert got["wiki/a.md"]["source_sha256"] == hashlib.sha256(b"fine\n").hexdigest()
    assert got["wiki/a.md"]["size"] == 5 and got["wiki/a.md"]["source_modified_at"].endswith("+00:00")
    snap = build_snapshot(docs, PROFILE)
    assert {r["relative_path"]: r["classification"] for r in snap.entries.collect()} == {
        "wiki/a.md": "include", "wiki/b.md": "include_redacted", "wiki/c.bin": "blocked_review",
        "vendor/d.md": "exclude", "e.md": "blocked_review", "wiki/gone.md": "blocked_review"}
    assert snap.violations.count() == 0

    path = str(tmp_path / "snapshots")
    S.write_snapshot(snap.compared, path, "r1")
    S.stage_exports(snap.staged, str(tmp_path / "staged"), "r1")
    back = S.read_snapshot(spark, path, "r1")
    assert back.count() == 6
    staged = S.read_staged(spark, str(tmp_path / "staged"), "r1")
    assert staged.first()["content"] == "password: [REDACTED]\n"

    entries = back.filter("section = 'entry'").drop("section")
    approved = entries.filter("document_id IS NOT NULL").select("document_id")
    batch = export_batch(entries, docs, staged, approved, project="acme", operator="alice",
                         exported_at="2026-09-02T08:00:00+00:00", run_id="r1")
    assert batch.violations.count() == 0
    assert {r["status"] for r in batch.approval.collect()} == {"matched"}
    items = {r["document_id"]: r for r in batch.items.collect()}
    assert items["kb:acme:source:wiki:wiki/a.md"]["content"] == "fine\n"
    assert items["kb:acme:source:wiki:wiki/b.md"]["metadata"]["export_run_id"] == "r1"

    tampered = str(tmp_path / "tampered")
    shutil.copytree(path, tampered)
    rows = back.withColumn("reason", F.lit("edited"))
    rows.write.mode("overwrite").parquet(f"{tampered}/rows/run_id=r1")
    with pytest.raises(ViolationError, match="digest"):
        S.read_snapshot(spark, tampered, "r1")
    rows.drop("reason").write.mode("overwrite").parquet(f"{tampered}/rows/run_id=r1")
    with pytest.raises(ViolationError, match="columns"):
        S.read_snapshot(spark, tampered, "r1")


def test_candidates(spark):
    listed = spark.createDataFrame([("a",), ("a",), ("",), ("../x",)], "relative_path string")
    assert {tuple(r) for r in C.candidate_violations(listed).collect()} == {
        ("a", "duplicate"), ("", "empty"), ("../x", "outside_root")}


def test_export_rejects_changed_bytes(spark):
    schema = "relative_path string, content string"
    docs = spark.createDataFrame([("a.md", "one"), ("b.md", "two")], schema)
    snap = build_snapshot(docs, PROFILE)
    later = spark.createDataFrame([("a.md", "one"), ("b.md", "password: x")], schema)
    found = export_batch(snap.entries, later, snap.staged, snap.entries.select("document_id"), project="acme",
                         operator="bob", exported_at="t", run_id="r").violations
    b = "kb:acme:source:wiki:b.md"
    got = {tuple(r) for r in found.collect()}
    assert {(b, "bytes_differ_from_snapshot"), (b, "unsafe_content"), (b, "attribution")} <= got


def test_export_rejects_another_credential_policy(spark):
    docs = spark.createDataFrame([("ops/.env", "password: x"), ("a.md", "y")], "relative_path string, content string")
    held = Profile(project_slug="acme", operator="alice", scope="wiki", credential_policy="allow_project_staging",
                   reviewed=True, credential_sources=("ops/.env",))
    snap = build_snapshot(docs, held)
    batch = lambda profile: {tuple(r) for r in export_batch(
        snap.entries, docs, snap.staged, snap.entries.select("document_id"), project="acme", operator="alice",
        exported_at="t", run_id="r", profile=profile).violations.collect()}
    assert batch(held) == set()
    assert batch(PROFILE) == {("kb:acme:source:wiki:ops/.env", "credential_policy")}


def test_profile_credential_sources(spark):
    row = lambda root, policy, sources: (root, "d", "acme", "p", "acme::p", "acme-p", "new_product", True, policy, sources)
    schema = ("root string, display_name string, owner_slug string, project_slug string, bank_id string,"
              " product_identity string, relationship string, reviewed boolean, credential_policy string,"
              " credential_sources array<string>")
    allow = "allow_project_staging"
    rows = [row("/a", "exclude", None), row("/b", allow, ["ops/.env"]), row("/c", allow, []), row("/d", allow, None),
            row("/e", allow, ["a", "a"]), row("/f", allow, ["../a"]), row("/g", "other", None), row("/h", allow, ["./a"])]
    got = {tuple(r) for r in validate_profiles(spark.createDataFrame(rows, schema)).collect()}
    assert got == {(r, "credential_sources") for r in ("/c", "/d", "/e", "/f", "/h")} | {("/g", "credential_policy")}


def test_audit_log(spark, tmp_path):
    event = lambda i, **kw: (i, json.dumps({"operation_id": "o", "phase": "intended", **kw}))
    path = str(tmp_path / "audit")
    good = spark.createDataFrame([event(1, document_ids=["a"]), event(2, item_count=3)], "i int, e string")
    S.append_audit(good, path, key="i", json="e")
    bad = spark.createDataFrame([event(3, content="body"), event(4, note="password: x"), event(5)], "i int, e string")
    with pytest.raises(ViolationError):
        S.append_audit(bad, path, key="i", json="e")
    assert {tuple(r) for r in A.reject_secrets(bad, key="i", json="e").collect()} == {(3, "secret"), (4, "secret")}
    S.append_audit(bad, path, key="i", json="e", strict=False)
    read = S.read_audit(spark, path)
    assert read.count() == 3 and read.filter("item_count = 3").first()["phase"] == "intended"


def test_graph_and_derived_inputs(spark, tmp_path):
    graph = {"metadata": {"generated_at": "2026-09-01T10:00:00+02:00"}, "nodes": [
        {"id": "a", "type": "t", "label": "A", "extra": 1}], "edges": [
        {"source": "a", "target": "a", "type": "t", "evidence": "e", "confidence": "c"}]}
    (tmp_path / "g.json").write_text(json.dumps(graph, indent=1))
    nodes, edges, meta = S.read_graph_document(spark, str(tmp_path / "g.json"))
    assert nodes.first()["path"] is None and edges.count() == 1
    assert meta.first()["generated_at"].startswith("2026")
    record = json.dumps({"document_id": "kb:acme:dossier:x", "content": "c", "tags": [], "metadata": {}}) + "\n"
    (tmp_path / "d.json").write_text(record)
    digest = hashlib.sha256(record.encode()).hexdigest()
    assert S.read_derived_batch(spark, str(tmp_path / "d.json"), expected_sha256=digest).count() == 1
    with pytest.raises(ViolationError):
        S.read_derived_batch(spark, str(tmp_path / "d.json"), expected_sha256="0" * 64)
    S.write_inventory(nodes, edges, str(tmp_path / "inv"))
    registry = spark.createDataFrame([("/a", '{"db": {"password": "x"}}')], "root string, extra string")
    with pytest.raises(ViolationError):
        S.write_registry(registry, str(tmp_path / "reg"), extra="extra")
    S.write_registry(registry.drop("extra"), str(tmp_path / "reg"))
    assert S.read_registry(spark, str(tmp_path / "reg")).count() == 1
    more = spark.createDataFrame([("/b",)], "root string")
    S.write_registry(S.read_registry(spark, str(tmp_path / "reg")).unionByName(more), str(tmp_path / "reg"))
    assert {r[0] for r in S.read_registry(spark, str(tmp_path / "reg")).collect()} == {"/a", "/b"}
    with pytest.raises(ViolationError):
        S.write_registry(spark.createDataFrame([("/c", "password=seven otters")], "root string, display_name string"), str(tmp_path / "reg"))


PHASES = [
    ("done", "intended", 0), ("done", "acknowledged", 1), ("done", "completed", 200),
    ("late", "intended", 0), ("late", "completed", 400), ("lost", "intended", 10),
    ("edge", "intended", 0), ("edge", "failed", 300), ("done", "intended", 0),
    ("flush", "other", 100_000),
]


def feed(spark):
    rows = spark.createDataFrame(PHASES, "operation_id string, phase string, s int")
    return rows.select("operation_id", "phase", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("s")).alias("ts"))


def test_lifecycle(spark):
    got = {r["operation_id"]: r for r in A.audit_lifecycle(feed(spark)).collect()}
    assert got["done"]["phase_order"] == "intended>acknowledged>completed"
    assert (got["done"]["outcome"], got["done"]["events"]) == ("completed", 4)
    assert (got["lost"]["outcome"], got["flush"]["has_intent"]) == ("open", False)
    status = spark.createDataFrame([("queued", "o"), ("queued", ""), (None, "o"), ("failed", "o"), ("odd", "o")],
                                   "s string, o string").coalesce(1)
    assert [r[0] for r in status.select(A.status_normalize(F.col("s"), F.col("o"))).collect()] == [
        "acknowledged", "uncertain", "acknowledged", "failed", "uncertain"]
    assert [r[0] for r in status.select(A.poll_status(F.col("s"))).collect()][0] == "uncertain"


def drain(stream, tmp_path, name):
    out, check = str(tmp_path / name), str(tmp_path / (name + "-c"))
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(
        availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def test_stream_outcomes_equal_batch(spark, tmp_path):
    feed(spark).write.parquet(str(tmp_path / "feed"))
    read = lambda: spark.readStream.schema("operation_id string, phase string, ts timestamp").parquet(str(tmp_path / "feed"))
    columns = ["operation_id", "outcome"]
    batch = sorted(tuple(r) for r in A.operation_outcomes(feed(spark)).select(*columns).collect())
    assert batch == [("done", "completed"), ("edge", "failed"), ("late", "timed_out"), ("lost", "timed_out")]
    streamed = drain(jobs.stream_outcomes(read(), read()), tmp_path, "out")
    assert sorted(tuple(r) for r in streamed.select(*columns).collect()) == batch
    once = drain(jobs.stream_dedup(read()), tmp_path, "once")
    assert once.filter("operation_id = 'done' AND phase = 'intended'").count() == 1


def test_upsert_over_several_batches(spark, tmp_path):
    path = str(tmp_path / "table")
    schema = "document_id string, exported_at int, content string"
    batches = [[("a", 1, "a1"), ("b", 1, "b1"), ("a", 2, "a2")], [("b", 3, "b3"), ("c", 3, "c3")], [("a", 1, "old")]]
    for version, rows in enumerate(batches):
        for _ in range(2):  # a repeated batch changes nothing
            jobs.upsert_batch(spark.createDataFrame(rows, schema), path, version)
    got = {r["document_id"]: r["content"] for r in jobs.read_upserted(spark, path).collect()}
    assert got == {"a": "a2", "b": "b3", "c": "c3"}
    # Another run counts its batches from 0 again.
    jobs.upsert_batch(spark.createDataFrame([("a", 9, "a9"), ("d", None, "d0")], schema), path, 0, run="second")
    jobs.upsert_batch(spark.createDataFrame([("d", 1, "d1"), ("d", 1, "d2")], schema), path, 1, run="second")
    expected = {"a": "a9", "b": "b3", "c": "c3", "d": "d2"}
    assert {r["document_id"]: r["content"] for r in jobs.read_upserted(spark, path).collect()} == expected
    jobs.compact(spark, path, str(tmp_path / "compacted"))
    again = jobs.read_upserted(spark, str(tmp_path / "compacted"))
    assert again.columns == ["document_id", "exported_at", "content"] and again.count() == 4
    assert {r["document_id"]: r["content"] for r in again.collect()} == expected


def test_one_outcome_per_start(spark):
    rows = [("o", "intended", 0), ("o", "failed", 50), ("o", "completed", 50), ("o", "cancelled", 90), ("o", "intended", 60), ("p", "completed", 1), ("p", "intended", 2)]
    events = spark.createDataFrame(rows, "operation_id string, phase string, s int").select(
        "operation_id", "phase", F.timestamp_seconds(F.col("s")).alias("ts"))
    got = [tuple(r) for r in A.operation_outcomes(events).orderBy("operation_id", "start_ts").select("operation_id", "outcome").collect()]
    assert got == [("o", "completed"), ("o", "cancelled"), ("p", "timed_out")]


def test_scan_cuts_the_root_from_the_front(spark, tmp_path):
    root = tmp_path / "it's docs"
    for name in ("readme.md", "sub/it's docs/readme.md"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("x")
    got = {r["relative_path"] for r in C.scan_corpus(spark, str(root)).select("relative_path").collect()}
    assert got == {"readme.md", "sub/it's docs/readme.md"}


def test_every_row_is_a_file_of_its_own(spark, tmp_path):
    root = tmp_path / "it's 100%20 files"
    texts = ["a", "a", "", None, "two\nlines", "\u00e9" * 70_000] + [f"n{i}" for i in range(4_200)]
    rows = spark.createDataFrame([(x,) for x in texts], "text string").coalesce(1)
    assert C.write_text_files(rows, f"file:{root}") == len(texts)
    want = sorted(hashlib.sha256((x or "").encode() + b"\n").hexdigest() for x in texts)
    assert sorted(r[0] for r in C.scan_corpus(spark, str(root), glob="*.txt").select("source_sha256").collect()) == want
    # Nothing beside the files (no checksum files, which cost a process each), in folders of bounded size.
    made = [x for x in root.rglob("*") if x.is_file()]
    assert len(made) == len(texts) and {x.suffix for x in made} == {".txt"}
    assert max(len(list(x.iterdir())) for x in root.iterdir()) == C.FOLDER_FILES
    assert C.write_text_files(rows.filter("false"), str(tmp_path / "none")) == 0
    assert C.scan_corpus(spark, str(tmp_path / "none"), glob="*.txt").count() == 0


def test_local_files_are_listed_and_read_by_tasks(spark, tmp_path, monkeypatch):
    root = tmp_path / "it's 100%20 docs"
    names = ["a.txt", "s/b.txt", "s/_h.txt", "s/_h=1.txt", "s/.x.txt", "_hid/c.txt", "_metadata/d.txt", "_k=1/e.txt", "s/_metadata.txt",
             "s/y._COPYING_", "s/z.md", "sp ace/\u00e9.txt", "/".join(f"d{i}" for i in range(40)) + "/x.txt", *(f"many/{i}/n.txt" for i in range(120))]
    for name in (*names, "s/empty.txt"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("" if "empty" in name else f"text of {name}")
    (root / "link").symlink_to(root / "s")
    (root / "dead.txt").symlink_to(root / "nowhere")
    monkeypatch.setattr(C, "LISTED_ENTRIES", 50)
    monkeypatch.setattr(C, "READ_BYTES", 100)
    for glob in (None, "*.txt", "[!a].{txt,md}"):
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        plain = (reader.option("pathGlobFilter", glob) if glob else reader).load(str(root))
        want = {(r.path.split("%20 docs/", 1)[1], bytes(r.content), r.length) for r in plain.select("path", "content", "length").collect()}
        scanned = C.scan_corpus(spark, str(root), glob=glob)
        got = scanned.collect()
        assert {(r.relative_path, bytes(r.content), r["size"]) for r in got} == want and len(got) == len(want) > 2
        assert all(r.source_sha256 == hashlib.sha256(r.content).hexdigest() for r in got)
    # The driver holds the files of the listing, not of the tree.
    assert not any("docs/" in f for f in scanned.inputFiles())
    listed = spark.createDataFrame([("a.txt",), ("gone.txt",)], "relative_path string")
    chosen = C.scan_corpus(spark, str(root), candidates=listed)
    (root / "s/b.txt").unlink()  # not chosen, so not read
    assert {(r.relative_path, r["size"], r.missing) for r in chosen.collect()} == {("a.txt", 13, False), ("gone.txt", None, True)}


def test_local_files_are_held_against_their_checksums(spark, tmp_path):
    root = tmp_path / "lines"
    spark.createDataFrame([("x" * 2000,)], "text string").coalesce(1).write.text(str(root))
    assert [r["size"] for r in C.scan_corpus(spark, str(root)).select("size").collect()] == [2001]
    part = next(root.glob("part-*.txt"))
    part.write_text("x" * 1500 + "y" * 500 + "\n")
    with pytest.raises(Exception, match="[Cc]hecksum error"):
        C.scan_corpus(spark, str(root)).select("source_sha256").collect()


def test_graph_lines_are_written_compressed(spark, sf_dir):
    read = source_queries.graph_read(spark, sf_dir)
    held = [f for f in read.inputFiles() if "/edges/" in f]
    assert held and all(f.endswith(".json.gz") for f in held)
    assert read.agg(F.sum("edges")).first()[0] == I.edges(spark, sf_dir).count()


def test_log_reports_what_it_leaves_out(spark, tmp_path):
    rows = [("1", '{"a": 1}'), ("2", "password: plum"), ("3", "[1]"), ("4", '{"a": 1, "a": {"password": "x"}}')]
    events = spark.createDataFrame(rows, "k string, event string")
    left = S.append_audit(events, str(tmp_path / "log"), key="k", json="event", strict=False)
    assert {tuple(r) for r in left.collect()} == {("2", "secret"), ("3", "not_an_object"), ("4", "secret")}
    assert spark.read.text(str(tmp_path / "log")).count() == 1
    with pytest.raises(ViolationError):
        S.append_audit(events, str(tmp_path / "log"), key="k", json="event")


def test_ordered_and_eligible(spark):
    docs = spark.createDataFrame([("b.md", "x"), ("a.md", "y"), (".env", "z")], "relative_path string, content string")
    entries = build_snapshot(docs, PROFILE).entries
    assert [r["relative_path"] for r in E.ordered(entries).collect()] == ["a.md", "b.md", ".env"]
    assert E.eligible(entries).count() == 2
