"""Successor chains, lifecycle sessions and the places of secrets."""

import datetime as dt
import json

from pyspark.sql import functions as F

from docwarden.operators import audit as A, quality as Q


def test_chains(spark):
    rows = [(i, "hot" if i % 3 else f"s{i % 7}", None if i == 4 else f"2026-01-{i % 28 + 1:02d}") for i in range(200)]
    decisions = spark.createDataFrame(rows, "decision_id int, subject string, decided_at string").repartition(5)
    wrong = {3, 50, 199}
    got = {r.decision_id: (r.superseded_by, r.position, r.status) for r in Q.decision_chains(decisions, spark.createDataFrame([(i,) for i in wrong], "disproved_id int")).collect()}
    chains = {}
    for i, subject, at in sorted(rows, key=lambda r: (r[2] is not None, r[2] or "", r[0])):
        if i not in wrong:
            chains.setdefault(subject, []).append(i)
    expected = {i: (None, None, "disproved") for i in wrong}
    for chain in chains.values():
        for at, i in enumerate(chain):
            after = chain[at + 1] if at + 1 < len(chain) else None
            expected[i] = (after, at + 1, "superseded" if after is not None else "current")
    assert got == expected
    assert Q.decision_chains(decisions.filter("false")).count() == 0


def test_sessions(spark):
    at = lambda s: dt.datetime(2026, 1, 1) + dt.timedelta(seconds=s)
    rows = [
        ("a", "intended", 0), ("a", "acknowledged", 5), ("a", "completed", 50), ("a", "completed", 60),
        ("b", "intended", 0), ("b", "acknowledged", 250), ("b", "failed", 400),  # in the session, after the deadline
        ("c", "intended", 0), ("c", "completed", 1000),  # two sessions
        ("d", "failed", 7),
    ]
    events = spark.createDataFrame([(o, p, at(s)) for o, p, s in rows], "operation_id string, phase string, ts timestamp")
    got = sorted((r.operation_id, r.phase_order, r.outcome, r.end_ts, r.acknowledged_ts) for r in A.lifecycle_sessions(events).collect())
    assert got == [
        ("a", "intended>acknowledged>completed", "completed", at(50), at(5)), ("b", "intended>acknowledged>failed", "timed_out", None, at(250)),
        ("c", "completed", "completed", at(1000), None), ("c", "intended", "timed_out", None, None), ("d", "failed", "failed", at(7), None),
    ]


def test_places(spark):
    deep = {"api_key": "x"}
    for _ in range(6):
        deep = {"a": [1, deep]}
    rows = [(1, json.dumps(deep)), (2, '{"note": "Bearer ' + "a" * 20 + '", "ok": {"n": null}}'), (3, "[1]"), (4, None), (5, "{}"), (6, '{"secret": {"token": [1]}}')]
    got = {(r.id, r.place, r.rule) for r in A.secret_places(spark.createDataFrame(rows, "id int, j string"), key="id", json="j").collect()}
    assert got == {
        (1, "$" + ".a[1]" * 6 + ".api_key", "sensitive_key"), (2, "$.note", "credential_value"), (3, "$", "not_an_object"), (4, "$", "not_an_object"),
        (6, "$.secret", "sensitive_key"), (6, "$.secret.token", "sensitive_key"),
    }


def test_no_places(spark):
    rows = spark.createDataFrame([], "id int, j string")
    assert A.secret_places(rows, key="id", json="j").select(F.col("place")).count() == 0
