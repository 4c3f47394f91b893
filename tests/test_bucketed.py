"""A corpus in buckets by path: contents stay where they lie."""

import re

import pytest

from docwarden.operators import export
from docwarden.operators.digests import digest_depth
from docwarden.plans.snapshot import build_snapshot
from docwarden.operators.profile import Profile
from docwarden.sources import corpus as C


def above(plan, scan, stop):
    """Names of the plan's nodes between the scan of a table and the first join above it."""
    lines = [x for x in plan.splitlines() if re.search(r"[A-Za-z]", x)]
    depth = lambda x: re.search(r"[A-Za-z*(]", x).start()
    at = next(i for i, x in enumerate(lines) if scan in x)
    level, out = depth(lines[at]), []
    for line in reversed(lines[:at]):
        if depth(line) < level:
            level = depth(line)
            if re.search(stop, line):
                return out
            out.append(line)
    raise AssertionError("no join above the scan")


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_contents_are_not_exchanged(spark, tmp_path, no_broadcast):
    docs = spark.range(300).selectExpr("concat('wiki/', id, '.md') AS relative_path", "concat('text ', id, if(id % 5 = 0, '\npassword: hunter2hunter2', '')) AS content")
    table = C.write_bucketed_corpus(docs, "kept_corpus", str(tmp_path / "kept"), buckets=16)
    snap = build_snapshot(docs, Profile(project_slug="acme", operator="alice", scope="wiki"))
    make = lambda corpus: export.export_items(snap.entries, corpus, snap.staged, exported_at="t", run_id="r")
    items = make(table)
    plan = items._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in above(plan, "kept_corpus", "Join") if "Exchange" in x]
    rows = lambda df: sorted((r.document_id, r.content) for r in df.collect())
    assert rows(items) == rows(make(docs)) and items.count() == 300
    listed = spark.createDataFrame([("wiki/3.md",), ("wiki/x.md",)], "relative_path string")
    found = C.candidate_filter(table, listed)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in above(plan, "kept_corpus", "Join") if "Exchange" in x]
    assert sorted((r.relative_path, r.missing) for r in found.collect()) == [("wiki/3.md", False), ("wiki/x.md", True)]
    spark.sql("DROP TABLE kept_corpus")
    again = C.open_bucketed_corpus(spark, "kept_corpus", str(tmp_path / "kept"), "relative_path string, content string", buckets=16)
    assert rows(make(again)) == rows(make(docs))
    spark.sql("DROP TABLE kept_corpus")


def test_a_fold_is_as_deep_as_its_rows_ask_for():
    assert [digest_depth(n) for n in (0, 1, 4096 * 256, 4096 * 256 + 1, 10**9, 10**12)] == [1, 1, 1, 2, 3, 4]
