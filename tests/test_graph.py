"""Graph capsules: subjects, ids, stability, hot groups."""

import time

import pytest
from pyspark.sql import functions as F

from docwarden.operators import graph as G
from docwarden.operators.skew import large_groups, lookup_join, rank_within
from docwarden.plans.capsules import graph_capsules
from docwarden.session import materialize

NODES = [("route:home", "route", "Home", "/home"), ("entity:user", "entity", "User", "src/user.py"),
         ("wiki:guide", "wiki", "Guide", "docs/guide.md"), ("svc", "service", "Svc", "src/svc.py"),
         ("x", "entity", "X", None)]
EDGES = [("svc", "route:home", "serves", "e1", "high"), ("svc", "entity:user", "reads", "e2", "high"),
         ("wiki:guide", "route:home", "documents", "e3", "low"), ("svc", "svc", "calls", "e4", "low"),
         ("wiki:guide", "x", "mentions", "e5", "low")]
POLICY = G.GraphPolicy(project_slug="acme", operator="alice", scope="runtime", coverage_note="all",
                       included_path_prefixes=("src", "docs"), url_node_types=("route",), max_edges=1)


def frames(spark, nodes=NODES, edges=EDGES):
    return (spark.createDataFrame(nodes, "id string, type string, label string, path string"),
            spark.createDataFrame(edges, "source string, target string, type string, evidence string, confidence string"))


def test_subjects(spark):
    got = {r["evidence"]: r["subject"] for r in G.edge_subjects(*frames(spark)).collect()}
    assert got == {"e1": "route:home", "e2": "entity:user", "e3": "route:home", "e4": "svc", "e5": "x"}


def test_capsules(spark):
    built = graph_capsules(*frames(spark), POLICY, audit_status="passed")
    assert built.violations.count() == 0
    got = {r["document_id"]: r for r in built.capsules.collect()}
    base = [i for i in got if ":part-" not in i]
    assert len(got) == 5 and len(base) == 4
    home = next(i for i in base if "route-home-" in i)
    assert got[home]["content"] == (
        "# Graph projection: route:home (part 1 of 2)\n\n"
        "A bounded projection of audited graph relationships.\nCoverage: all\n"
        "Derived: maintained documents and live sources take precedence.\n\n## Relationships\n"
        "- type: documents\n  source: wiki:guide\n  target: route:home\n  evidence: e3\n  confidence: low\n")
    assert home + ":part-2" in got
    assert got[home]["metadata"]["subject_node_id"] == "route:home"
    whole = graph_capsules(*frames(spark), G.GraphPolicy(**{**POLICY.__dict__, "max_edges": 12}),
                           audit_status="passed").capsules
    ids = {r["document_id"] for r in whole.collect()}
    assert ids == set(base) and ids <= set(got)
    inventory = {tuple(r)[:2] for r in G.capsule_inventory(whole, built.capsules).collect()}
    assert (home + ":part-2", "stale") in inventory and (home, "expected") in inventory
    with pytest.raises(ValueError):
        graph_capsules(*frames(spark), POLICY, audit_status="pending")


def test_violations(spark):
    nodes = NODES + [("x", "entity", "again", None), ("y", "page", "Y", "other/y"), ("z", "page", "Z", "../z")]
    edges = EDGES + [EDGES[0], ("svc", "nowhere", "calls", "e", "low"), ("svc", "x", "", "e", "low")]
    found = graph_capsules(*frames(spark, nodes, edges), POLICY, audit_status="passed").violations
    assert {tuple(r) for r in found.collect()} == {
        ("x", "duplicate_node"), ("svc", "duplicate_edge"), ("nowhere", "unknown_node"),
        ("svc", "incomplete_edge"), ("y", "outside_policy"), ("z", "unsafe_path")}


def test_hot_subject_is_ranked_over_many_tasks(spark):
    rows = [("hub", f"t{i:05d}", "calls", f"e{i % 7}", "low") for i in range(3000)]
    rows += [(f"s{i % 50}", f"t{i:05d}", "calls", "e", "low") for i in range(1000)]
    subjects = spark.createDataFrame(
        rows, "source string, target string, type string, evidence string, confidence string"
    ).withColumn("subject", F.col("source")).repartition(6)
    plain = rank_within(subjects, "subject", G.EDGE_ORDER)
    hot = rank_within(subjects, "subject", G.EDGE_ORDER, slabs=9)
    columns = [*subjects.columns, "rank", "total"]
    assert hot.select(*columns).exceptAll(plain.select(*columns)).count() == 0
    assert hot.count() == 4000
    assert {r[0] for r in hot.filter("subject = 'hub'").agg(F.max("rank")).collect()} == {3000}
    assert dict(hot.dtypes)["rank"] == dict(plain.dtypes)["rank"] == "bigint"
    tops = hot.groupBy("subject").agg(F.count("*").alias("n"), F.countDistinct("rank").alias("k"), F.max("rank").alias("top"), F.max("total").alias("total"))
    assert tops.filter("n <> k OR n <> top OR n <> total").count() == 0
    assert rank_within(subjects.filter("false"), "subject", G.EDGE_ORDER).count() == 0


def test_groups_are_shuffled_once_and_hubs_in_slabs(spark):
    rows = [("hub", f"t{i:05d}") for i in range(3000)] + [(None, f"t{i:05d}") for i in range(2500)]
    rows += [(f"s{i % 50}", f"t{i:05d}") for i in range(1000)]
    df = spark.createDataFrame(rows, "g string, o string").repartition(6)
    assert sorted(large_groups(df, "g", 2000), key=str) == [None, "hub"]
    plain, cut = rank_within(df, "g", ["o"]), rank_within(df, "g", ["o"], hub_rows=2000)
    assert plain.count() == cut.count() == 6500 and plain.exceptAll(cut).count() == 0
    assert plain.filter("g IS NULL").agg(F.max("rank"), F.max("total")).first() == (2500, 2500)
    # Work by group goes on in the same partitions.
    again = plain.groupBy("g", (F.col("rank") % 12).alias("part")).agg(F.collect_list("o"))
    assert again._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_ends_that_are_the_subject_are_moved_once(spark):
    ends = [("a", "b", "a"), ("a", "b", "b"), ("a", "a", "a"), ("a", "b", "other"), (None, "b", None), (None, "b", "b"), ("a", None, None), ("a", "b", None)]
    rows = [(s, t, f"type{i % 3}", f"e{i}", "low", subject) for i in range(40) for s, t, subject in ends]
    df = spark.createDataFrame(rows, "source string, target string, type string, evidence string, confidence string, subject string").repartition(5)
    plain = rank_within(df, "subject", G.EDGE_ORDER, rank="position", total="subject_edges")
    for got in (G.number_edges(df), rank_within(df, "subject", G.EDGE_ORDER, rank="position", total="subject_edges", repeats=("source", "target"), hub_rows=100)):
        assert got.columns == plain.columns and got.count() == 320
        assert got.exceptAll(plain).count() == plain.exceptAll(got).count() == 0
    ranked = G.number_edges(df)
    held = spark.read.parquet(*ranked.inputFiles()).filter("subject IN ('a', 'b')")
    assert held.filter("source <=> subject OR target <=> subject").count() == 0
    again = ranked.groupBy("subject", (F.col("position") % 12).alias("part")).agg(F.collect_list("source"))
    assert again._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_written_results_leave_no_shuffle_files(spark):
    blocks = lambda: {str(x) for x in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(
        spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()) if str(x).startswith("shuffle_")}
    counted = spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count()
    held = blocks()
    assert materialize(counted, "counted").agg(F.sum("count")).first()[0] == 1000
    for _ in range(50):  # the executors are told, not waited for
        left = blocks() - held
        if len({x.split("_")[1] for x in left}) <= 1:
            break
        time.sleep(0.1)
    assert len({x.split("_")[1] for x in left}) <= 1  # at most the sum's own
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_checks_and_capsules_read_written_nodes_and_edges(spark):
    built = graph_capsules(*frames(spark), POLICY, audit_status="passed")
    for result in (built.violations, built.capsules):
        plan = result._jdf.queryExecution().optimizedPlan().toString()
        assert "LocalRelation [id" not in plan and "LogicalRDD" not in plan
    assert {f.rsplit("/", 2)[1].split("-")[0] for f in built.violations.inputFiles()} == {"nodes", "edges", "rows"}


def test_lookups_hash_the_small_side(spark):
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = spark.range(1000).select("id", (F.col("id") % 7).alias("k"))
        got = lookup_join(left, spark.range(5).select(F.col("id").alias("k"), F.lit(1).alias("v")), ["k"])
        assert len(got.filter("v = 1").collect()) == sum(i % 7 < 5 for i in range(1000))
        got = got.groupBy().count()
        got.collect()
        plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_lookup_join_keeps_every_row(spark):
    left = spark.range(1000).select("id", F.when(F.col("id") < 900, "hot").otherwise("cold").alias("k"))
    right = spark.createDataFrame([("hot", 1)], "k string, v int")
    got = lookup_join(left, right, ["k"])
    assert got.count() == 1000 and got.filter("v = 1").count() == 900
