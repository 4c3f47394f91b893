"""Quality gate, latest versions, current decisions, checkpoints and document pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docwarden import vocab
from docwarden.functions.jsontree import sanitize_json
from docwarden.operators.skew import lookup_join, successor_within


def quality_gate(cases: DataFrame) -> DataFrame:
    """One row: critical cases all correct, at least 90 % of the applicable ones, no violation.

    ``cases`` has critical, applicable, correct (boolean) and violation (class name or null)."""
    applicable = F.coalesce("applicable", F.lit(True))
    counts = cases.agg(
        F.count("*").alias("cases"),
        F.count_if("critical").alias("critical"),
        F.count_if(F.col("critical") & F.col("correct")).alias("critical_correct"),
        F.count_if(applicable).alias("applicable"),
        F.count_if(applicable & F.col("correct")).alias("applicable_correct"),
        F.count_if(F.col("violation").isin(*vocab.VIOLATION_CLASSES)).alias("violations"),
    )
    return counts.withColumn(
        "passed",
        (F.col("critical") == F.col("critical_correct"))
        & (F.col("applicable_correct") * 10 >= F.col("applicable") * 9)
        & (F.col("applicable") > 0)
        & (F.col("violations") == 0),
    )


def latest_per_id(
    records: DataFrame, *, key: str = "document_id", order: tuple[str, ...] = ("exported_at",)
) -> DataFrame:
    """The last record of each id, one even if several share the order; a missing order value comes
    before any other. Maxima combine before the shuffle, so an id with very many records is one row
    per task."""
    last = F.max_by(F.struct(*records.columns), F.struct(*order)).alias("_last")
    return records.groupBy(F.col(key).alias("_key")).agg(last).select("_last.*")


def current_decisions(decisions: DataFrame, corrections: DataFrame | None = None) -> DataFrame:
    """Mark the decisions of a subject: the latest is current, earlier ones are superseded by it,
    and those a correction refutes are disproved. Nothing is removed.

    ``decisions`` has decision_id, subject and decided_at; ``corrections`` disproved_id. A subject
    with very many decisions is one maximum per task, and its lookup is spread."""
    standing = decisions
    if corrections is not None:
        refuted = corrections.select(F.col("disproved_id").alias("decision_id")).distinct()
        standing = decisions.join(refuted.withColumn("_refuted", F.lit(True)), "decision_id", "left")
    else:
        standing = decisions.withColumn("_refuted", F.lit(None).cast("boolean"))
    latest = (
        standing.filter("_refuted IS NULL")
        .groupBy("subject")
        .agg(F.max(F.struct("decided_at", "decision_id")).alias("_last"))
        .select("subject", F.col("_last.decision_id").alias("current_id"))
    )
    joined = lookup_join(standing, latest, ["subject"])
    status = (
        F.when(F.col("_refuted").isNotNull(), "disproved")
        .when(F.col("decision_id") == F.col("current_id"), "current")
        .otherwise("superseded")
    )
    return joined.withColumn("status", status).drop("_refuted")


def decision_chains(decisions: DataFrame, corrections: DataFrame | None = None) -> DataFrame:
    """Each decision with its place in its subject's chain: ``superseded_by`` (the very next decision that
    stands, null for the current one), ``position`` (from 1) and ``status``. A decision that a correction
    refutes is ``disproved`` and in no chain; what came before it is superseded by what came after.

    ``decisions`` has decision_id, subject and decided_at; ``corrections`` disproved_id. Decisions of one time
    are ordered by id, those without a time come first. A subject with very many decisions is cut into
    ranges of time, so no task holds it whole."""
    if corrections is None:
        standing, refuted = decisions, decisions.filter("false")
    else:
        wrong = corrections.select(F.col("disproved_id").alias("decision_id")).distinct()
        standing, refuted = decisions.join(wrong, "decision_id", "left_anti"), decisions.join(wrong, "decision_id", "left_semi")
    columns = decisions.columns
    chained = successor_within(
        standing.select(columns), "subject", ["decided_at", "decision_id"], value="decision_id", successor="superseded_by", rank="position"
    )
    chained = chained.withColumn("status", F.when(F.col("superseded_by").isNull(), "current").otherwise("superseded"))
    return chained.unionByName(refuted.select(columns).withColumn("status", F.lit("disproved")), allowMissingColumns=True)


def checkpoint_runs(runs: DataFrame, *, key: str = "project") -> DataFrame:
    """Per project the last run that succeeded; dry and failed runs never replace it."""
    done = runs.filter("result = 'completed' AND NOT dry_run")
    return done.groupBy(key).agg(F.max(F.struct("finished_at", "run_id")).alias("_last")).select(
        key, F.col("_last.run_id").alias("run_id"), F.col("_last.finished_at").alias("finished_at")
    )


def document_summary(documents: DataFrame) -> DataFrame:
    """Whitelisted columns, JSON ones sanitised; ``summary_violations`` reports rows without an id."""
    columns = [c for c in vocab.SUMMARY_COLUMNS if c in documents.columns]
    types = dict(documents.dtypes)
    clean = lambda c: (
        sanitize_json(F.col(c), keep_listings=True).alias(c)
        if c in ("metadata", "document_metadata") and types[c] == "string"
        else F.col(c)
    )
    return documents.select(*[clean(c) for c in columns])


def summary_violations(documents: DataFrame) -> DataFrame:
    """One row for every document without an id."""
    return documents.filter(F.coalesce(F.col("id") == "", F.lit(True))).select("id", F.lit("id_missing").alias("violation"))


def page_documents(
    documents: DataFrame, *, limit: int = vocab.PAGE_LIMIT, offset: int = 0, after: str | None = None, with_total: bool = True
) -> DataFrame:
    """One page of summaries in id order with total, limit and offset.

    For pages far into a large table pass the last id as ``after`` instead of a deep offset, and
    leave the total, which counts the table, to the first page."""
    if isinstance(limit, bool) or not 1 <= limit <= vocab.PAGE_LIMIT:
        raise ValueError(f"the page limit is between 1 and {vocab.PAGE_LIMIT}")
    if isinstance(offset, bool) or offset < 0:
        raise ValueError("the page offset must not be negative")
    total: Column = documents.agg(F.count("*")).scalar() if with_total else F.lit(None).cast("bigint")
    rows = document_summary(documents)
    if after is not None:
        rows = rows.filter(F.col("id") > after)
    page = rows.orderBy("id").offset(offset).limit(limit)
    return page.withColumns(
        {"total": total, "limit": F.lit(limit), "offset": F.lit(offset)}
    )
