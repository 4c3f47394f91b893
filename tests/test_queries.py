"""The driver contract, and a selection of registered queries beside their oracle SQL.

``python tests/check_oracle.py`` runs all of them."""

import pytest
from check_oracle import compare, oracle_connection

import __spark_entry__ as entry
from workloads import registry

SELECTED = (
    "path_classification", "content_rule_hits", "redacted_text", "delta_status", "tag_violations",
    "events_split", "graph_edge_subjects", "graph_capsules", "path_policy", "evidence_check",
    "root_resolution", "registry_upsert", "tree_pages", "spec_reconcile", "audit_lifecycle",
    "map_diff", "current_decisions", "document_page", "stream_dedup", "stream_upsert",
)


@pytest.fixture(scope="module")
def oracle(sf_dir):
    return oracle_connection(sf_dir)


def test_every_query_has_an_oracle():
    assert set(registry.QUERIES) == set(registry.ORACLE)
    assert set(registry.QUERIES) <= set(entry.queries()) and set(registry.ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", SELECTED)
def test_query_equals_oracle(spark, oracle, sf_dir, name):
    message, _ = compare(spark, oracle, name, entry.queries()[name], entry.oracle_sql()[name], sf_dir)
    assert message == ""


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
