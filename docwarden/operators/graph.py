"""Graph edges to bounded documents: integrity, subjects, chunks, rendering, stale ids."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from docwarden import vocab
from docwarden.functions.paths import path_in_prefixes
from docwarden.functions.text import subject_slug
from docwarden.operators.checks import duplicates
from docwarden.operators.profile import active_operator, build_metadata, tag_component
from docwarden.operators.skew import lookup_join, rank_within

EDGE_COLUMNS = ["source", "target", "type", "evidence", "confidence"]
EDGE_ORDER = ["type", "source", "target", "evidence", "confidence"]


@dataclass(frozen=True)
class GraphPolicy:
    project_slug: str
    operator: str
    scope: str
    coverage_note: str
    included_path_prefixes: tuple[str, ...]
    excluded_path_prefixes: tuple[str, ...] = ()
    url_node_types: tuple[str, ...] = ()
    projection_slug: str | None = None
    max_edges: int = vocab.MAX_EDGES
    topics: tuple[str, ...] = ()
    generated_at: str = ""
    source_path: str = ""
    source_sha256: str = ""
    generator: str = "graph-capsules"
    generator_version: str = "1"
    subject_types: tuple[str, ...] = vocab.CAPSULE_SUBJECT_TYPES

    def __post_init__(self) -> None:
        active_operator(self.operator)
        for label in ("project_slug", "scope"):
            tag_component(getattr(self, label), label)
        if isinstance(self.max_edges, bool) or self.max_edges <= 0:
            raise ValueError("max_edges must be a positive integer")
        if self.generated_at and not re.search(r"T.*(?:Z|[+-]\d\d:\d\d)\Z", self.generated_at):
            raise ValueError("generated_at needs a time with an offset")
        if not self.coverage_note.strip() or not self.included_path_prefixes:
            raise ValueError("a coverage note and included path prefixes are required")


def duplicate_edges(edges: DataFrame) -> DataFrame:
    return duplicates(edges, EDGE_COLUMNS)


def duplicate_nodes(nodes: DataFrame) -> DataFrame:
    return duplicates(nodes, ["id"])


def incomplete_edges(edges: DataFrame) -> DataFrame:
    blank = F.lit(False)
    for name in EDGE_COLUMNS:
        blank |= F.coalesce(F.col(name) == "", F.lit(True))
    return edges.filter(blank)


def incomplete_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes without id, type or label."""
    blank = F.lit(False)
    for name in ("id", "type", "label"):
        blank |= F.coalesce(F.col(name) == "", F.lit(True))
    return nodes.filter(blank)


def empty_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row without id if there are no nodes or no edges."""
    some = lambda df: df.limit(1).agg(F.count("*").alias("n"))
    return some(nodes).unionByName(some(edges)).agg(F.min("n").alias("n")).filter("n = 0").select(
        F.lit(None).cast("string").alias("id"), F.lit("empty_graph").alias("violation")
    )


def edge_integrity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Endpoints that are no node, with the number of edge ends. Endpoints are counted before the
    join, so a hub costs one row."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("id"))
    return (
        ends.groupBy("id").agg(F.count("*").alias("edge_ends")).join(nodes, "id", "left_anti")
    )


def path_policy(nodes: DataFrame, policy: GraphPolicy) -> DataFrame:
    """Nodes whose path the policy refuses."""
    status = path_in_prefixes(
        F.col("path"),
        F.col("type"),
        list(policy.included_path_prefixes),
        list(policy.excluded_path_prefixes),
        list(policy.url_node_types),
    )
    return nodes.select("id", status.alias("violation")).filter("violation <> 'ok'")


def _prefix_rank(node: Column, types: tuple[str, ...]) -> Column:
    rank = F.when(F.lit(False), F.lit(0))
    for position, name in enumerate(types):
        rank = rank.when(node.startswith(f"{name}:"), F.lit(position))
    return rank


def edge_subjects(
    nodes: DataFrame, edges: DataFrame, types: tuple[str, ...] = vocab.CAPSULE_SUBJECT_TYPES
) -> DataFrame:
    """The endpoint each edge is about: the first preferred type that source, then target, has by
    node type or id prefix; otherwise the source. Only nodes of preferred types are joined."""
    typed = nodes.filter(F.col("type").isin(*types)).select(
        F.col("id"), (F.array_position(F.array(*map(F.lit, types)), F.col("type")) - 1).alias("rank")
    )
    df = edges
    for end in ("source", "target"):
        side = typed.select(F.col("id").alias(end), F.col("rank").alias(f"_{end}"))
        df = lookup_join(df, side, [end])
    none = F.lit(len(types)).cast("bigint")
    best = {
        end: F.least(
            F.coalesce(F.col(f"_{end}"), none), F.coalesce(_prefix_rank(F.col(end), types), none)
        )
        for end in ("source", "target")
    }
    return df.withColumn(
        "subject",
        F.when(best["target"] < best["source"], F.col("target")).otherwise(F.col("source")),
    ).drop("_source", "_target")


def chunk_edges(
    subjects: DataFrame,
    max_edges: int = vocab.MAX_EDGES,
    *,
    slabs: int | None = None,
) -> DataFrame:
    """Number the edges of a subject in order and cut them into parts of ``max_edges``."""
    ranked = number_edges(subjects, slabs=slabs)
    return cut_edges(ranked, max_edges)


def number_edges(subjects: DataFrame, *, slabs: int | None = None) -> DataFrame:
    """Position of each edge within its subject, whatever the size of the parts. A subject is one end of its
    edge as a rule, and is moved once."""
    ends = ("source", "target")
    return rank_within(subjects, "subject", EDGE_ORDER, rank="position", total="subject_edges", slabs=slabs, repeats=ends)


def cut_edges(ranked: DataFrame, max_edges: int = vocab.MAX_EDGES) -> DataFrame:
    """Parts of ``max_edges`` numbered edges."""
    return ranked.withColumns(
        {
            "part": (F.floor((F.col("position") - 1) / max_edges) + 1).cast("int"),
            "parts": F.ceil(F.col("subject_edges") / max_edges).cast("int"),
        }
    )


def _edge_text() -> Column:
    return F.concat(
        F.lit("- type: "), "type",
        F.lit("\n  source: "), "source",
        F.lit("\n  target: "), "target",
        F.lit("\n  evidence: "), "evidence",
        F.lit("\n  confidence: "), "confidence",
    )


def render_capsules(chunks: DataFrame, policy: GraphPolicy) -> DataFrame:
    """One document per subject and part; a part holds at most ``max_edges`` edges."""
    grouped = chunks.groupBy("subject", "part", "parts").agg(
        F.array_sort(F.collect_list(F.struct("position", _edge_text().alias("text")))).alias("edges")
    )
    projection = policy.projection_slug or policy.scope
    base = F.concat(
        F.lit(f"kb:{policy.project_slug}:graph:{tag_component(projection, 'projection_slug')}:"),
        subject_slug(F.col("subject")),
    )
    document_id = F.when(F.col("part") == 1, base).otherwise(
        F.concat(base, F.lit(":part-"), F.col("part"))
    )
    heading = F.concat(
        F.lit("# Graph projection: "),
        "subject",
        F.when(
            F.col("parts") > 1,
            F.concat(F.lit(" (part "), "part", F.lit(" of "), "parts", F.lit(")")),
        ).otherwise(""),
    )
    content = F.concat(
        heading,
        F.lit(
            "\n\nA bounded projection of audited graph relationships.\n"
            f"Coverage: {policy.coverage_note}\n"
            "Derived: maintained documents and live sources take precedence.\n\n"
            "## Relationships\n"
        ),
        F.array_join("edges.text", "\n"),
        F.lit("\n"),
    )
    user = active_operator(policy.operator)
    tags = sorted(
        {
            f"user:{user}", f"project:{policy.project_slug}", "kind:graph_projection",
            f"scope:{policy.scope}", "trust:derived", "knowledge:component",
            *[f"topic:{tag_component(t.split(':', 1)[1], 'topic')}" for t in policy.topics],
        }
    )
    metadata = build_metadata(
        {
            "operator": user,
            "project_slug": policy.project_slug,
            "source_path": policy.source_path,
            "source_sha256": policy.source_sha256,
            "sidecar_sha256": policy.source_sha256,
            "sidecar_generated_at": policy.generated_at,
            "knowledge_layer": "component",
            "verification_status": "derived",
            "generator": policy.generator,
            "generator_version": policy.generator_version,
            "coverage": policy.coverage_note,
            "projection_slug": projection,
            "subject_node_id": F.col("subject"),
        }
    )
    return grouped.select(
        document_id.alias("document_id"),
        F.array(*map(F.lit, tags)).alias("tags"),
        metadata.alias("metadata"),
        content.alias("content"),
        F.lit(None).cast("string").alias("event_timestamp"),
        "subject",
        "part",
        "parts",
        F.size("edges").alias("edges"),
    )


def capsule_inventory(capsules: DataFrame, previous_ids: DataFrame) -> DataFrame:
    """Expected ids and, as a proposal only, earlier ids that are no longer produced."""
    expected = capsules.select("document_id", F.lit("expected").alias("status"))
    stale = stale_ids(capsules, previous_ids).select("document_id", F.lit("stale").alias("status"))
    return expected.unionByName(stale).withColumn("stale_id_policy", F.lit(vocab.STALE_POLICY))


def stale_ids(capsules: DataFrame, previous_ids: DataFrame) -> DataFrame:
    return previous_ids.select("document_id").join(
        capsules.select("document_id"), "document_id", "left_anti"
    )
