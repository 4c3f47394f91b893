"""Preflight: decide per document whether its text may be exported as is, redacted, or not at all.

One narrow transformation, no shuffle. Ordinary prose pays a few cheap regular expressions; the
array work on matches runs only where a trigger says that a match is possible."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from docwarden.functions import rewrite, secrets
from docwarden.functions.fence import fence
from docwarden.functions.paths import classify_path, is_env_template
from docwarden.operators.rules import apply_rules

FINDINGS = "array<struct<line:int,rule:string,disposition:string>>"


def _finding(rule: str, line: Column, disposition: str = "blocked_review") -> Column:
    return F.struct(
        line.cast("int").alias("line"),
        F.lit(rule).alias("rule"),
        F.lit(disposition).alias("disposition"),
    )


def _findings(rule: str, lines: Column) -> Column:
    return F.transform(lines, lambda line: _finding(rule, line))


def _none() -> Column:
    return F.array().cast(FINDINGS)


def _lines(text: Column, pattern: str, is_hit) -> Column:
    return rewrite.hit_lines(
        rewrite.segments(text, pattern), rewrite.matches(text, pattern), is_hit
    )


def _any_match(match: Column) -> Column:
    return match.isNotNull()


def preflight(
    documents: DataFrame,
    *,
    path: str = "relative_path",
    content: str = "content",
    policy: str | Column | None = None,
    rules: DataFrame | None = None,
) -> DataFrame:
    """Add ``decision``, ``exported_text`` and ``findings`` to a table of documents.

    ``content`` is text or binary; binary content with a NUL byte or that is not UTF-8 is blocked.
    ``policy`` is a column with the credential policy of each row (default ``exclude``); with
    ``allow_project_staging`` credentials are reported but the text is kept. ``rules`` are further rules as
    rows (see :mod:`docwarden.operators.rules`); without them there is no shuffle."""
    if policy is None:
        policy = F.lit("exclude")
    elif isinstance(policy, str):
        policy = F.col(policy)
    raw = F.col(content)
    binary = isinstance(documents.schema[content].dataType, T.BinaryType)
    readable = F.lit(True)
    byte_rule = F.lit(None).cast("string")
    if binary:
        byte_rule = F.when(F.contains(raw, F.lit(b"\x00")), "binary_content").when(
            ~F.is_valid_utf8(raw.cast("string")), "undecodable_content"
        )

    allowed = F.coalesce(policy == "allow_project_staging", F.lit(False))
    rule = F.col("_path_rule")
    df = documents.withColumns({"_allowed": allowed, "_path_rule": classify_path(F.col(path))})
    waived = F.col("_allowed") & (rule == "path_environment_file")
    df = df.withColumn("_path_rule", F.when(~waived, rule))
    df = df.withColumn("_byte_rule", F.when(rule.isNull(), byte_rule))
    if binary:
        readable = F.col("_byte_rule").isNull()
    # Text only where the content rules are reached; null switches every later step off. The
    # lower-case copy serves plain substring tests, far cheaper than a regular expression.
    df = df.withColumn("_text", F.when(rule.isNull() & readable, raw.cast("string")))
    df = df.withColumn("_low", F.lower("_text"))

    text, low = F.col("_text"), F.col("_low")
    held = F.col("_allowed")
    opaque_lines = F.when(
        text.rlike(secrets.OPAQUE_TRIGGER),
        _lines(text, secrets.OPAQUE_ASSIGNMENT, secrets.is_opaque_assignment),
    )
    df = df.withColumns(
        {
            "_pem_line": F.when(
                low.contains("-----begin") & text.rlike(secrets.KEY_BLOCK_HEADER),
                rewrite.first_line(text, secrets.KEY_BLOCK_HEADER),
            ),
            "_opaque_lines": opaque_lines,
            "_bearer": F.coalesce(
                low.contains("bearer") & low.rlike(secrets.BEARER_TRIGGER), F.lit(False)
            ),
            "_assigns": F.coalesce(
                secrets.may_assign(low) & low.rlike(secrets.ASSIGNMENT_TRIGGER), F.lit(False)
            ),
        }
    )
    blocked_text = F.col("_pem_line").isNotNull() | (
        F.size(F.coalesce("_opaque_lines", F.array().cast("array<int>"))) > 0
    )
    df = df.withColumn("_stop", blocked_text)

    # Assignments: one pass for the matches, shared by the line numbers and the rewritten text.
    rewrites = ~F.col("_stop") & ~held
    found = F.when(
        F.col("_assigns") & (rewrites | held), rewrite.matches(text, secrets.ASSIGNMENT)
    )
    df = df.withColumn("_found", found)
    df = df.withColumn(
        "_hits",
        F.transform(
            "_found",
            lambda m: F.when(held, secrets.is_credential_assignment(m, keep_bearer=False))
            .otherwise(secrets.is_credential_assignment(m))
        ),
    )
    any_hit = F.exists("_hits", lambda h: h)
    df = df.withColumn(
        "_parts", F.when(any_hit, rewrite.segments(text, secrets.ASSIGNMENT))
    )
    marked = F.arrays_zip(F.col("_found").alias("m"), F.col("_hits").alias("h"))
    df = df.withColumn("_marked", F.when(F.col("_parts").isNotNull(), marked))
    df = df.withColumns(
        {
            "_assignment_lines": F.when(
                F.col("_parts").isNotNull(), _marked_lines(F.col("_parts"), F.col("_marked"))
            ),
            "_text1": F.when(
                F.col("_parts").isNotNull() & ~held,
                rewrite.reassemble(
                    F.col("_parts"),
                    F.transform(
                        "_marked",
                        lambda x: F.when(x["h"], secrets.redacted_assignment(x["m"])).otherwise(
                            x["m"]
                        ),
                    ),
                ),
            ).otherwise(text),
        }
    )
    # The two bearer passes work on the text the previous pass produced.
    bearer = F.col("_bearer") & (rewrites | held)
    text1, text2 = F.col("_text1"), F.col("_text2")
    df = df.withColumns(
        {
            "_authorization_lines": F.when(
                bearer, _lines(text1, secrets.AUTHORIZATION_BEARER, _any_match)
            ),
            "_text2": F.when(
                bearer & ~held,
                F.regexp_replace(text1, secrets.AUTHORIZATION_BEARER, "$1[REDACTED]"),
            ).otherwise(text1),
        }
    )
    df = df.withColumns(
        {
            "_bare_lines": F.when(bearer, _lines(text2, secrets.BARE_BEARER, _any_match)),
            "_text3": F.when(
                bearer & ~held, F.regexp_replace(text2, secrets.BARE_BEARER, "$1[REDACTED]")
            ).otherwise(text2),
        }
    )

    no_lines = F.array().cast("array<int>")
    assignment = F.coalesce("_assignment_lines", no_lines)
    bearer_hits = F.concat(
        F.coalesce("_authorization_lines", no_lines), F.coalesce("_bare_lines", no_lines)
    )
    exported = F.array_sort(
        F.concat(
            _findings("credential_assignment", assignment),
            _findings("bearer_token", bearer_hits),
        )
    )
    material = F.when(
        F.col("_pem_line").isNotNull(),
        F.array(_finding("credential_material_allowed", F.col("_pem_line"))),
    ).otherwise(_none())
    kept = F.array_sort(
        F.concat(
            material,
            _findings(
                "credential_assignment_allowed",
                F.concat(assignment, bearer_hits, F.coalesce("_opaque_lines", no_lines)),
            ),
        )
    )
    findings = (
        F.when(
            rule.isNotNull(),
            F.array(
                F.struct(
                    F.lit(0).alias("line"), rule.alias("rule"), F.lit("exclude").alias("disposition")
                )
            ),
        )
        .when(
            F.col("_byte_rule").isNotNull(),
            F.array(
                F.struct(
                    F.lit(0).alias("line"),
                    F.col("_byte_rule").alias("rule"),
                    F.lit("blocked_review").alias("disposition"),
                )
            ),
        )
        .when(held, kept)
        .when(
            F.col("_pem_line").isNotNull(),
            F.array(_finding("private_key_material", F.col("_pem_line"))),
        )
        .when(
            F.col("_stop"),
            F.array(
                _finding("unknown_high_entropy_assignment", F.get("_opaque_lines", F.lit(0)))
            ),
        )
        .otherwise(exported)
    )
    df = df.withColumn("findings", findings.cast(FINDINGS))
    has = F.size("findings") > 0
    decision = (
        F.when(rule.isNotNull() | F.col("_byte_rule").isNotNull(), "blocked")
        .when(held, "safe")
        .when(F.col("_stop"), "blocked")
        .when(has & is_env_template(F.col(path)), "blocked")
        .when(has, "redacted")
        .otherwise("safe")
    )
    df = df.withColumn("decision", decision)
    df = df.withColumn(
        "exported_text",
        F.when(F.col("decision") == "redacted", F.col("_text3")).when(
            F.col("decision") == "safe", text
        ),
    )
    scanned = fence(df, documents.columns, ["decision", "exported_text", "findings"])
    return scanned if rules is None else apply_rules(scanned, rules, path=path, policy=policy)


def _marked_lines(parts: Column, marked: Column) -> Column:
    steps = F.zip_with(
        parts,
        marked,
        lambda s, x: F.struct(
            rewrite.newlines(s).alias("before"),
            F.coalesce(rewrite.newlines(x["m"]), F.lit(0)).alias("inside"),
            F.coalesce(x["h"], F.lit(False)).alias("hit"),
        ),
    )
    return rewrite.hit_lines_of(steps)


def rule_histogram(scanned: DataFrame) -> DataFrame:
    """Findings and documents per rule; a document's rules are counted before the shuffle."""
    return (
        scanned.select(F.explode("findings.rule").alias("rule"))
        .groupBy("rule")
        .agg(F.count("*").alias("findings"))
    )
