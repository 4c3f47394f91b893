"""Relative paths: normal form, exclusion rules, prefixes and export locators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from docwarden import vocab
from docwarden.functions.text import fold_letters


def _any(values: tuple[str, ...]) -> str:
    return "(?:" + "|".join(v.replace(".", "\\.") for v in values) + ")"


def posix(path: Column) -> Column:
    """Forward slashes; empty and ``.`` parts removed, as a path library would."""
    text = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.regexp_replace(F.regexp_replace(text, r"/(?:\.?/)+", "/"), r"^\./|/\.?$", "")


def is_safe_relative(path: Column) -> Column:
    """Non-empty, relative, forward slashes only and without a parent step."""
    bad = (path == "") | path.contains("\\") | path.rlike(r"^/|(?:^|/)\.\.(?:/|$)")
    return F.coalesce(~bad, F.lit(False))


def normalize_path(path: Column) -> Column:
    """Normal relative form; null for absolute, empty, drive-letter or parent-stepping paths."""
    text = posix(path)
    unsafe = (
        path.rlike(r"^[/\\]|^[A-Za-z]:") | text.rlike(r"(?:^|/)\.\.(?:/|$)") | text.isin("", ".")
    )
    return F.when(~unsafe, text)


def classify_path(path: Column) -> Column:
    """Name of the first exclusion rule a path falls under, or null.

    Every rule is a regular expression over the whole path, so the column stays inside generated
    code: ``parts`` holds the case-folded parts, ``words`` the same with each part's words
    separated by one blank. Word fragments are looked for inside single words."""
    plain = posix(F.regexp_replace(path, r"^[/\\]+", ""))
    parts = fold_letters(plain)
    spaced = fold_letters(F.regexp_replace(plain, "([a-z0-9])([A-Z])", "$1 $2"))
    words = F.regexp_replace(spaced, "[^a-z0-9/]+", " ")

    domain, strong = _any(vocab.DOMAIN_FRAGMENTS), _any(vocab.STRONG_FRAGMENTS)
    safe = r"[^/]*\b" + _any(vocab.SAFE_PATH_WORDS) + r"\b"
    bulk = r"[^/]*\b" + _any(vocab.BULK_PATH_WORDS) + r"\b"
    part = "(?:^|/)"
    sensitive = (
        words.rlike(
            f"{part}(?=[^/]*{domain})(?:(?=[^/]*{strong})|(?=[^/]*data)(?!{safe}))"
        )
        | words.rlike(f"{part}(?!{safe})(?={bulk})")
        | (words.rlike(domain) & words.rlike(strong))
        | parts.rlike(part + _any(vocab.SENSITIVE_PARTS) + "(?:/|$)")
    )
    env = parts.rlike(r"(?:^|/)\.env(?:\.[^/]*)?\z") & ~is_env_template(path)
    return (
        F.when(env, "path_environment_file")
        .when(
            parts.rlike(part + _any(vocab.BUILD_PARTS) + "(?:/|$)"),
            "path_dependency_or_build_artifact",
        )
        .when(sensitive, "path_sensitive_or_generated_data")
        .when(
            parts.rlike(r"\." + _any(vocab.BINARY_SUFFIXES) + r"\z"),
            "path_binary_or_dump_candidate",
        )
    )


def is_env_template(path: Column) -> Column:
    name = fold_letters(F.substring_index(posix(path), "/", -1))
    return name.isin(*vocab.ENV_TEMPLATE_NAMES)


def ancestors(path: Column) -> Column:
    """All leading whole-component prefixes of a path, the path itself included, longest last."""
    parts = F.split(path, "/")
    return F.filter(
        F.transform(
            F.sequence(F.lit(1), F.size(parts)),
            lambda i: F.array_join(F.slice(parts, 1, i), "/"),
        ),
        lambda prefix: prefix != "",
    )


def path_depth(path: Column) -> Column:
    return F.size(F.filter(F.split(path, "/"), lambda p: p != ""))


def export_locator(path: Column, document_id: Column) -> Column:
    """``events/<16 hex of the path>/<hash of the id>.md``"""
    return F.concat(
        F.lit("events/"),
        F.substring(F.sha2(path, 256), 1, 16),
        F.lit("/"),
        F.sha2(document_id, 256),
        F.lit(".md"),
    )


def path_in_prefixes(
    path: Column,
    node_type: Column,
    included: list[str],
    excluded: list[str] | None = None,
    url_types: list[str] | None = None,
) -> Column:
    """Status of a node's path under an include / exclude policy.

    ``ok``, or the reason it is refused. Null paths are fine. Locators that start with ``/`` are
    accepted for the declared URL node types only."""

    def prefix_of(value: str) -> str:
        return value.replace("\\", "/").rstrip("/") + "/"

    def starts(prefixes: list[str]) -> Column:
        hit = F.lit(False)
        for prefix in prefixes:
            hit |= text.startswith(prefix_of(prefix))
        return hit

    text = posix(path)
    declared = fold_letters(node_type).isin(*[t.casefold() for t in url_types or [""]])
    is_url = declared & path.startswith("/")
    unsafe = path.rlike(r"^[/\\]|^[A-Za-z]:") | text.rlike(r"(?:^|/)\.\.(?:/|$)")
    return (
        F.when(path.isNull(), "ok")
        .when(path == "", "invalid_path")
        .when(is_url & path.rlike(r"^//|\\|[\x00-\x1F\x7F]"), "ambiguous_url")
        .when(is_url, "ok")
        .when(unsafe, "unsafe_path")
        .when(starts(excluded or []), "excluded")
        .when(starts(included), "ok")
        .otherwise("outside_policy")
    )
