"""Capsules of an audited graph."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, functions as F

from docwarden.operators import graph as G
from docwarden.session import materialize


@dataclass(frozen=True)
class Capsules:
    capsules: DataFrame
    check: Callable[[], DataFrame]

    @cached_property
    def violations(self) -> DataFrame:
        """Checked when first asked for."""
        return self.check()


def graph_capsules(
    nodes: DataFrame, edges: DataFrame, policy: G.GraphPolicy, *, audit_status: str
) -> Capsules:
    """Policy, duplicates and endpoints are checked; edges are grouped, cut and rendered. Edges are
    written once, since checks and capsules read them; nodes are written for the checks."""
    if audit_status != "passed":
        raise ValueError("the graph audit has not passed")
    edges = materialize(edges.select(*G.EDGE_COLUMNS), "edges")
    chunks = G.chunk_edges(G.edge_subjects(nodes, edges, policy.subject_types), policy.max_edges)
    capsules = G.render_capsules(chunks, policy)
    return Capsules(capsules, lambda: graph_violations(nodes, edges, capsules, policy))


def graph_violations(nodes: DataFrame, edges: DataFrame, capsules: DataFrame, policy: G.GraphPolicy) -> DataFrame:
    """Faults of nodes, edges and the capsules built from them."""
    if "path" not in nodes.columns:
        nodes = nodes.withColumn("path", F.lit(None).cast("string"))
    nodes = materialize(nodes.select("id", "type", "label", "path"), "nodes")
    tag = lambda df, key, name: df.select(
        F.col(key).alias("id"), F.lit(name).alias("violation")
    )
    found = (
        G.path_policy(nodes, policy)
        .unionByName(tag(G.incomplete_nodes(nodes), "id", "incomplete_node"))
        .unionByName(G.empty_graph(nodes, edges))
        .unionByName(tag(G.duplicate_nodes(nodes), "id", "duplicate_node"))
        .unionByName(tag(G.duplicate_edges(edges), "source", "duplicate_edge"))
        .unionByName(tag(G.incomplete_edges(edges), "source", "incomplete_edge"))
        .unionByName(tag(G.edge_integrity(nodes, edges), "id", "unknown_node"))
    )
    return found.unionByName(tag(G.duplicates(capsules, ["document_id"]), "document_id", "duplicate_capsule"))
