"""The reviewed settings of one project; the data itself never passes through it."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, functions as F

from docwarden import vocab


def tag_component(value: str, label: str) -> str:
    folded = str(value).casefold()
    if not re.match(vocab.TAG_COMPONENT, folded):
        raise ValueError(f"invalid {label}")
    return folded


def active_operator(value: str) -> str:
    if not value or value.casefold() == "unknown":
        raise ValueError("an active operator is required")
    return tag_component(value, "operator")


@dataclass(frozen=True)
class Profile:
    """``scope`` falls back to ``workspace`` for sources and ``project-logbook`` for events. Path
    lists are for a handful of paths; larger ones are passed as a ``roles`` table."""

    project_slug: str
    operator: str
    scope: str | None = None
    knowledge_layer: str = "concept"
    trust: str = "verified"
    topics: tuple[str, ...] = ()
    credential_policy: str = "exclude"
    reviewed: bool = False
    credential_sources: tuple[str, ...] = ()
    event_paths: tuple[str, ...] = ()
    event_scopes: dict[str, str] = field(default_factory=dict)
    derived_after_audit_paths: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        active_operator(self.operator)
        tag_component(self.project_slug, "project_slug")
        if self.credential_policy not in vocab.CREDENTIAL_POLICIES:
            raise ValueError("credential_policy must be exclude or allow_project_staging")
        if self.credential_policy != "exclude" and not self.reviewed:
            raise ValueError("allow_project_staging requires a reviewed profile")
        for path in self.credential_sources:
            parts = path.split("/")
            if not path or "\\" in path or path.startswith("/") or set(parts) & {"", ".", ".."}:
                raise ValueError("credential_sources must be canonical relative paths")
        if len(set(self.credential_sources)) != len(self.credential_sources):
            raise ValueError("credential_sources must not repeat")
        if len(self.event_paths) > 1 and not set(self.event_paths) <= set(self.event_scopes):
            raise ValueError("several event paths require event_scopes")
        if any(not topic.startswith("topic:") for topic in self.topics):
            raise ValueError("topics must use the topic namespace")

    @property
    def source_scope(self) -> str:
        return self.scope or "workspace"

    @property
    def event_scope(self) -> str:
        return self.scope or "project-logbook"

    @property
    def user(self) -> str:
        return active_operator(self.operator)


def build_tags(profile: Profile, kind: str, scope: Column | str | None = None) -> Column:
    """Sorted distinct tags."""
    scope = F.lit(scope or profile.source_scope) if not isinstance(scope, Column) else scope
    fixed = [
        f"knowledge:{tag_component(profile.knowledge_layer, 'knowledge_layer')}",
        f"kind:{kind}",
        f"project:{tag_component(profile.project_slug, 'project_slug')}",
        f"trust:{tag_component(profile.trust, 'trust')}",
        f"user:{profile.user}",
        *[f"topic:{tag_component(t.split(':', 1)[1], 'topic')}" for t in profile.topics],
    ]
    return F.array_sort(
        F.array_distinct(
            F.array(*[F.lit(t) for t in fixed], F.concat(F.lit("scope:"), scope))
        )
    )


def build_metadata(values: dict[str, Column | str]) -> Column:
    """String map with keys in sorted order; null values are left out."""
    pairs = []
    for key in sorted(values):
        value = values[key]
        pairs += [F.lit(key), value if isinstance(value, Column) else F.lit(value)]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())
