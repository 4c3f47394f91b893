"""Comparing recorded hashes with the bytes a corpus has now.

``corpus`` tables have (relative_path, sha256), one row per path. A source cited by a large share
of the records is spread over several tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docwarden import vocab
from docwarden.functions.paths import is_safe_relative, posix
from docwarden.operators.digests import evidence_digest
from docwarden.operators.skew import lookup_join

EVIDENCE = "array<struct<source_path:string,source_sha256:string>>"


def _is_hash(value: Column) -> Column:
    return F.coalesce(value.rlike(vocab.SHA256_HEX), F.lit(False))


def _canonical(path: Column) -> Column:
    return is_safe_relative(path) & (posix(path) == path) & ~path.isin("", ".")


def _status(path: Column, stated: Column, actual: Column) -> Column:
    return (
        F.when(path.isNull() | (path == "") | ~_is_hash(stated), "incomplete")
        .when(~_canonical(path), "non_canonical")
        .when(actual.isNull(), "missing")
        .when(actual != stated, "mismatch")
        .otherwise("ok")
    )


def corpus_hashes(corpus: DataFrame, *, content: str = "content") -> DataFrame:
    raw = F.col(content)
    if dict(corpus.dtypes)[content] == "string":
        raw = F.encode(raw, "UTF-8")
    return corpus.select("relative_path", F.sha2(raw, 256).alias("sha256"))


def _with_actual(df: DataFrame, corpus: DataFrame, path: str) -> DataFrame:
    side = corpus.select(F.col("relative_path").alias(path), F.col("sha256").alias("_actual"))
    return lookup_join(df, side, [path])


def verify_provenance(
    records: DataFrame, corpus: DataFrame, *, key: str = "document_id"
) -> DataFrame:
    """Status of each record's source_path and source_sha256."""
    joined = _with_actual(records, corpus, "source_path")
    status = _status(F.col("source_path"), F.col("source_sha256"), F.col("_actual"))
    return joined.withColumn("status", status).drop("_actual")


def verify_evidence(records: DataFrame, corpus: DataFrame) -> DataFrame:
    """Status of multi-source records.

    ``records`` has document_id, kind and a metadata map with source_paths and evidence as JSON
    text and the aggregate source_sha256. Paths are unique and at least two, evidence follows them
    position by position, every hash equals the corpus, and the aggregate binds the order."""
    meta = lambda key: F.try_element_at("metadata", F.lit(key))
    df = records.select(
        "document_id",
        "kind",
        F.from_json(meta("source_paths"), "array<string>").alias("paths"),
        F.from_json(meta("evidence"), EVIDENCE).alias("evidence"),
        F.from_json(meta("evidence"), "array<map<string,string>>").alias("_raw"),
        meta("source_sha256").alias("stated"),
        meta("source_path").isNotNull().alias("_single"),
    )
    paths, evidence = F.col("paths"), F.col("evidence")
    extra_keys = F.exists("_raw", lambda m: F.size(m) != 2)
    shape = (
        F.when((F.col("kind") != "dossier") | F.col("_single"), "only_for_dossiers")
        .when(paths.isNull() | evidence.isNull(), "not_json")
        .when(
            (F.size(paths) < 2)
            | (F.size(F.array_distinct(paths)) != F.size(paths))
            | F.exists(paths, lambda p: p.isNull() | (p == ""))
            | (F.size(evidence) != F.size(paths)),
            "not_an_ordered_unique_list",
        )
        .when(
            F.coalesce(extra_keys, F.lit(True))
            | F.exists(
                F.arrays_zip(paths.alias("p"), F.col("evidence.source_path").alias("e")),
                lambda x: ~x["p"].eqNullSafe(x["e"]),
            ),
            "evidence_differs_from_paths",
        )
        .otherwise("ok")
    )
    df = df.select(
        "document_id",
        shape.alias("shape"),
        (evidence_digest(evidence).eqNullSafe(F.col("stated"))).alias("aggregate_ok"),
        "evidence",
    )
    items = df.select(
        "document_id", "shape", "aggregate_ok",
        F.posexplode_outer("evidence").alias("position", "item"),
    ).select(
        "document_id", "shape", "aggregate_ok", "position",
        F.col("item.source_path").alias("source_path"),
        F.col("item.source_sha256").alias("source_sha256"),
    )
    # A record without evidence has a null path; its own id keeps such rows apart.
    checked = _with_actual(
        items.withColumn("source_path", F.coalesce("source_path", F.concat(F.lit("\u0000"), "document_id"))),
        corpus, "source_path",
    ).withColumn("item_status", _status(F.col("source_path"), F.col("source_sha256"), F.col("_actual")))
    per_record = checked.groupBy("document_id").agg(
        F.first("shape").alias("shape"),
        F.first("aggregate_ok").alias("aggregate_ok"),
        F.count(F.when(F.col("item_status") != "ok", 1)).alias("bad_sources"),
    )
    status = (
        F.when(F.col("shape") != "ok", F.col("shape"))
        .when(F.col("bad_sources") > 0, "source_differs")
        .when(~F.col("aggregate_ok"), "aggregate_differs")
        .otherwise("ok")
    )
    return per_record.select("document_id", status.alias("status"), "bad_sources")


def verify_snapshot(entries: DataFrame, corpus: DataFrame, staged: DataFrame) -> DataFrame:
    """Source and staged status of every eligible entry; ``staged`` has (export_path, sha256).

    An event is bound to its logbook through the container hash."""
    rows = entries.filter(F.col("classification").isin(*vocab.ELIGIBLE)).select(
        "document_id",
        "relative_path",
        "export_path",
        F.when(
            F.col("document_id").contains(":event:"),
            F.try_element_at("metadata", F.lit("container_sha256")),
        )
        .otherwise(F.col("source_sha256"))
        .alias("expected_source"),
        F.coalesce("exported_sha256", "source_sha256").alias("expected_staged"),
    )
    joined = _with_actual(rows, corpus, "relative_path").withColumnRenamed(
        "_actual", "_source"
    )
    # Entries without a staged text get a key of their own instead of a common null.
    joined = joined.withColumn(
        "_export", F.coalesce("export_path", F.concat(F.lit("\u0000"), "document_id"))
    ).join(
        staged.select(F.col("export_path").alias("_export"), F.col("sha256").alias("_staged")),
        "_export",
        "left",
    )

    def status(actual: str, expected: str) -> Column:
        return (
            F.when(F.col(actual).isNull(), "missing")
            .when(~F.col(actual).eqNullSafe(F.col(expected)), "mismatch")
            .otherwise("ok")
        )

    return joined.select(
        "document_id",
        "relative_path",
        status("_source", "expected_source").alias("source_status"),
        F.when(F.col("export_path").isNull(), "none")
        .otherwise(status("_staged", "expected_staged"))
        .alias("staged_status"),
    )


def freshness_check(retained: DataFrame, corpus: DataFrame) -> DataFrame:
    """fresh, stale or gone for retained (document_id, source_path, source_sha256)."""
    joined = _with_actual(retained, corpus, "source_path")
    status = (
        F.when(F.col("_actual").isNull(), "gone")
        .when(F.col("_actual").eqNullSafe(F.col("source_sha256")), "fresh")
        .otherwise("stale")
    )
    return joined.withColumn("freshness", status).drop("_actual")
