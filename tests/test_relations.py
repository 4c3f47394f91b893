"""Provenance, exports, registry, tree, specifications, quality."""

import hashlib
import json

import pytest

from docwarden.operators import export, provenance, quality as Q, registry as R, tree as T
from docwarden.operators.checks import ViolationError, require_none


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def statuses(df, key, value="status"):
    return {r[key]: r[value] for r in df.collect()}


FILES = {"a.md": "A", "b.md": "B"}


def hashes(spark):
    docs = spark.createDataFrame(list(FILES.items()), "relative_path string, content string")
    return provenance.corpus_hashes(docs)


def test_provenance(spark):
    cases = {"ok": ("a.md", sha("A")), "mismatch": ("a.md", sha("x")), "missing": ("c.md", sha("A")),
             "non_canonical": ("./a.md", sha("A")), "incomplete": ("a.md", "A" * 64)}
    rows = [(k, *v) for k, v in cases.items()] + [("n", None, sha("A"))]
    df = spark.createDataFrame(rows, "document_id string, source_path string, source_sha256 string")
    got = statuses(provenance.verify_provenance(df, hashes(spark)), "document_id")
    assert got == {**{k: k for k in cases}, "n": "incomplete"}
    fresh = statuses(provenance.freshness_check(df, hashes(spark)), "document_id", "freshness")
    assert (fresh["ok"], fresh["mismatch"], fresh["missing"]) == ("fresh", "stale", "gone")


def evidence(*items):
    listed = [{"source_path": p, "source_sha256": s} for p, s in items]
    text = json.dumps(listed, separators=(",", ":"))
    return {"source_paths": json.dumps([p for p, _ in items]), "evidence": text, "source_sha256": sha(text)}


def test_evidence(spark):
    good = evidence(("a.md", sha("A")), ("b.md", sha("B")))
    swapped = evidence(("b.md", sha("B")), ("a.md", sha("A")))
    cases = {
        "ok": ("dossier", good),
        "only_for_dossiers": ("graph_projection", good),
        "not_json": ("dossier", {**good, "evidence": "{"}),
        "not_an_ordered_unique_list": ("dossier", evidence(("a.md", sha("A")))),
        "evidence_differs_from_paths": ("dossier", {**good, "source_paths": '["b.md","a.md"]'}),
        "source_differs": ("dossier", evidence(("a.md", sha("A")), ("b.md", sha("x")))),
        "aggregate_differs": ("dossier", {**good, "source_sha256": swapped["source_sha256"]}),
    }
    rows = [(k, kind, meta) for k, (kind, meta) in cases.items()]
    rows.append(("extra", "dossier", {**good, "evidence": good["evidence"].replace('"a.md"', '"a.md","x":"y"')}))
    df = spark.createDataFrame(rows, "document_id string, kind string, metadata map<string,string>")
    got = statuses(provenance.verify_evidence(df, hashes(spark)), "document_id")
    assert got.pop("extra") == "evidence_differs_from_paths"
    assert got == {k: k for k in cases}


def test_approval(spark):
    ids = lambda *names: spark.createDataFrame(list(enumerate(names)), "position bigint, document_id string")
    got = statuses(export.reconcile_approval(ids("a", "b", "c"), ids("a", "c", "d")), "document_id")
    assert got == {"a": "matched", "b": "missing", "c": "out_of_order", "d": "extra"}
    items = spark.createDataFrame([("A", "é"), ("a", "xy")], "document_id string, content string")
    assert tuple(export.batch_totals(items).first()) == (2, 4)
    assert export.reconcile_totals(items, item_count=2, total_bytes=3).first()["status"] == "mismatch"
    assert export.id_collisions(items).first()["folded_id"] == "a"
    assert tuple(export.batch_totals(items.limit(0)).first()) == (0, 0)


PROFILE = "root string, bank_id string, display_name string, product_identity string, relationship string, owner_slug string, project_slug string, reviewed boolean"


def test_resolve_roots(spark):
    roots = spark.createDataFrame([("/srv/product",), ("/srv/product/mobile",), ("/srv",)], "root string")
    paths = spark.createDataFrame([("/srv/product/web/a",), ("/srv/product/mobile",), ("/srv/product-copy/x",),
                                   ("/other",)], "path string")
    assert statuses(R.resolve_roots(paths, roots), "path", "root") == {
        "/srv/product/web/a": "/srv/product", "/srv/product/mobile": "/srv/product/mobile",
        "/srv/product-copy/x": "/srv", "/other": None}


def test_registry_upsert(spark):
    row = lambda root, bank, product="acme-p", relation="new_product", reviewed=True, slug="p": (
        root, bank, "d " + root, product, relation, "acme", slug, reviewed)
    extra = ", credential_policy string, registered_at string, registered_by string, updated_at string, updated_by string"
    old = spark.createDataFrame(
        [(*row("/a", "acme::p"), "exclude", "t0", "alice", None, None),
         (*row("/b", "acme::q", None, slug="q"), "exclude", "t0", None, None, None)], PROFILE + extra)
    reuse = "existing_product_additional_root"
    new = spark.createDataFrame([
        row("/a", "acme::p"),                                   # update
        row("/b", "acme::z", "acme-q", slug="q"),               # bank change
        row("/c", "acme::p", relation=reuse),                   # reviewed reuse
        row("/d", "acme::p"),                                   # bank taken
        row("/e", "acme::p", relation=reuse, reviewed=False),   # not reviewed
        row("/f", "acme::p", "other", reuse),                   # other product
        row("/g", "acme::new"),                                 # new
        row("/h", "acme::twice"), row("/i", "acme::twice"),     # one batch, one new bank
    ], PROFILE)
    result = R.registry_upsert(old, new, registered_at="t1", nickname="bob")
    assert {tuple(r) for r in result.conflicts.collect()} == {
        ("/b", "bank_change"), ("/d", "bank_taken"), ("/e", "bank_taken"), ("/f", "bank_taken"),
        ("/h", "new_bank_shared_in_batch"), ("/i", "new_bank_shared_in_batch")}
    got = {r["root"]: r for r in result.registry.collect()}
    assert set(got) == {"/a", "/b", "/c", "/g"}
    assert (got["/a"]["registered_at"], got["/a"]["registered_by"], got["/a"]["updated_at"], got["/a"]["updated_by"]) == ("t0", "alice", "t1", "bob")
    assert (got["/g"]["registered_at"], got["/g"]["registered_by"], got["/g"]["updated_at"]) == ("t1", "bob", None)
    changed = spark.createDataFrame([row("/a", "acme::p", "acme-other")], PROFILE)
    conflicts = R.registry_upsert(old, changed, registered_at="t1").conflicts
    assert [r["violation"] for r in conflicts.collect()] == ["identity_change"]
    unset = spark.createDataFrame([row("/b", "acme::q", "acme-q", slug="q")], PROFILE)
    done = R.registry_upsert(old, unset, registered_at="t1", nickname="bob")
    assert done.conflicts.count() == 0
    b = done.registry.filter("root = '/b'").first()
    assert (b["product_identity"], b["registered_at"], b["registered_by"]) == ("acme-q", "t0", "bob")


def test_tree_from_json(spark):
    tree = {"roots": [{"id": "f1", "kind": "Folder", "name": "F", "children": [
        {"id": "f2", "kind": "folder", "name": "G", "parent_id": "f1", "children": [
            {"id": "p1", "kind": "page", "name": "P", "parent_id": "f2", "mental_model_id": "m"}]},
        {"id": "P1", "kind": "page", "name": "Q", "parent_id": "f2", "mental_model_id": ""}]}]}
    nodes = T.nodes_from_json(spark.createDataFrame([(json.dumps(tree),)], "t string"), "t")
    flat = T.flatten_tree(nodes)
    assert {r["id"]: (r["path"], r["depth"]) for r in flat.nodes.collect()} == {
        "f1": ("F", 1), "f2": ("F/G", 2), "p1": ("F/G/P", 3), "P1": ("F/G/Q", 3)}
    assert {tuple(r) for r in flat.violations.collect()} == {
        ("P1", "parent_ownership"), ("P1", "page_without_model"), ("p1", "duplicate_id")}
    loop = spark.createDataFrame([("a", "b", "folder", "A", None), ("b", "a", "folder", "B", None)],
                                 "id string, parent_id string, kind string, name string, mental_model_id string")
    deep = {"id": "d39", "kind": "page", "name": "P", "parent_id": "d38", "mental_model_id": "m"}
    for i in range(38, -1, -1):
        deep = {"id": f"d{i}", "kind": "folder", "name": f"n{i}", "children": [deep], **({"parent_id": f"d{i - 1}"} if i else {})}
    unfolded = T.nodes_from_json(spark.createDataFrame([(json.dumps({"roots": [deep]}),)], "t string"), "t")
    whole = T.flatten_tree(unfolded)
    assert whole.violations.count() == 0 and whole.nodes.count() == 40
    assert whole.nodes.filter("id = 'd39'").first()["path"] == "/".join(f"n{i}" for i in range(39)) + "/P"
    tail = loop.unionByName(spark.createDataFrame([("c", "a", "folder", "C", None), ("e", "gone", "folder", "E", None), ("f", "e", "folder", "F", None)], loop.schema))
    assert {tuple(r) for r in T.flatten_tree(tail).violations.collect()} == {
        ("a", "cycle"), ("b", "cycle"), ("c", "cycle"), ("e", "unknown_parent"), ("f", "unknown_parent")}
    assert {r["violation"] for r in T.flatten_tree(loop).violations.collect()} == {"cycle"}


def test_quality(spark):
    schema = "critical boolean, applicable boolean, correct boolean, violation string"
    passing = [(True, True, True, None)] * 9 + [(False, True, False, None)]
    gate = lambda rows: Q.quality_gate(spark.createDataFrame(rows, schema)).first()["passed"]
    assert gate(passing) is True
    assert gate(passing + [(False, True, False, None)]) is False
    assert gate(passing[:-1] + [(True, True, False, None)]) is False
    assert gate(passing + [(False, False, False, "temporal")]) is False
    decisions = spark.createDataFrame([(1, "s", 1), (2, "s", 2), (3, "s", 3)], "decision_id int, subject string, decided_at int")
    wrong = spark.createDataFrame([(3,)], "disproved_id int")
    assert statuses(Q.current_decisions(decisions, wrong), "decision_id") == {1: "superseded", 2: "current", 3: "disproved"}
    pages = spark.createDataFrame([(f"d{i}", "secret body", '{"token": "t", "items": [1]}') for i in range(5)],
                                  "id string, content string, metadata string")
    page = Q.page_documents(pages, limit=2, offset=1).collect()
    assert [r["id"] for r in page] == ["d1", "d2"] and page[0]["total"] == 5
    assert "content" not in page[0] and json.loads(page[0]["metadata"]) == {"token": "<redacted>", "items": [1]}
    assert [r["id"] for r in Q.page_documents(pages, limit=2, after="d2").collect()] == ["d3", "d4"]
    for bad in (dict(limit=0), dict(limit=101), dict(limit=True), dict(offset=-1)):
        with pytest.raises(ValueError):
            Q.page_documents(pages, **bad)


def test_strict_checks(spark):
    require_none(spark.createDataFrame([], "violation string"))
    with pytest.raises(ViolationError, match="duplicate"):
        require_none(spark.createDataFrame([("duplicate",)], "violation string"))


def test_map_diff(spark):
    before = spark.createDataFrame([("k", {"a": "1", "b": "2"})], "k string, m map<string,string>")
    after = spark.createDataFrame([("k", {"a": "1", "b": "3", "c": "4"})], "k string, m map<string,string>")
    row = R.changed_mappings(before, after, key="k", mapping="m").first()
    assert (row["changed_keys"], row["only_one_changed"]) == (["b", "c"], False)
