"""Tables the jobs keep: snapshots, staged texts, registry, inventories, graphs, audit log."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from docwarden.functions.jsontree import has_secrets, is_json_object
from docwarden.functions.secrets import has_credential_value
from docwarden.operators.audit import accepted_events, reject_secrets
from docwarden.operators.checks import ViolationError, require_none
from docwarden.operators.digests import digest_depth, snapshot_digest
from docwarden.operators.entries import ENTRY_COLUMNS, ENTRY_SCHEMA

SNAPSHOT_SCHEMA = ENTRY_SCHEMA + ", section string"
GRAPH_NODES = "id string, type string, label string, path string"
GRAPH_EDGES = "source string, target string, type string, evidence string, confidence string"
DERIVED_SCHEMA = (
    "document_id string, content string, tags array<string>, metadata map<string,string>,"
    " event_timestamp string"
)
AUDIT_SCHEMA = (
    "ts timestamp, operator string, action string, phase string, result string, run_id string,"
    " bank_id string, operation_id string, item_count bigint, total_bytes bigint,"
    " document_ids array<string>, source_sha256s array<string>, manifest_sha256 string"
)


def write_snapshot(compared: DataFrame, path: str, run_id: str, *, depth: int | None = None) -> None:
    """Entries and deleted rows of one run, then its digest over the rows as written. The fold is as deep
    as the number of rows asks for; the depth is stored beside the digest."""
    spark = compared.sparkSession
    target = f"{path}/rows/run_id={run_id}"
    compared.select(*ENTRY_COLUMNS, "section").write.mode("errorifexists").parquet(target)
    written = spark.read.schema(SNAPSHOT_SCHEMA).parquet(target)
    depth = depth or digest_depth(written.count())
    snapshot_digest(written, depth=depth).withColumn("depth", F.lit(depth)).write.mode(
        "errorifexists"
    ).json(f"{path}/digests/run_id={run_id}")


def read_snapshot(spark: SparkSession, path: str, run_id: str, *, verify: bool = True) -> DataFrame:
    """Rows of one run; with ``verify`` their digest must equal the recorded one."""
    target = f"{path}/rows/run_id={run_id}"
    stored = set(spark.read.parquet(target).columns)
    if stored != {*ENTRY_COLUMNS, "section"}:
        raise ViolationError("snapshot has the wrong columns")
    rows = spark.read.schema(SNAPSHOT_SCHEMA).parquet(target)
    if verify:
        recorded = spark.read.schema("digest string, depth int").json(
            f"{path}/digests/run_id={run_id}"
        ).head(1)
        if not recorded:
            raise ViolationError("snapshot has no digest")
        if snapshot_digest(rows, depth=recorded[0]["depth"]).head()["digest"] != recorded[0]["digest"]:
            raise ViolationError("snapshot digest differs from its rows")
    return rows


def stage_exports(staged: DataFrame, path: str, run_id: str) -> None:
    """Redacted texts and event chunks by locator; originals are not in ``staged``."""
    repeated = staged.groupBy("export_path").agg(F.count("*").alias("n")).filter("n > 1")
    require_none(repeated.select(F.lit("export_path_collision").alias("violation")))
    staged.select("export_path", "content").write.mode("errorifexists").parquet(
        f"{path}/run_id={run_id}"
    )


def read_staged(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    return spark.read.schema("export_path string, content string").parquet(f"{path}/run_id={run_id}")


def append_audit(events: DataFrame, path: str, *, key: str, json: str, strict: bool = True) -> DataFrame:
    """Append JSON lines; returns the violations of the events that were left out. Strict mode refuses
    the whole batch if there is one."""
    rejected = reject_secrets(events, key=key, json=json)
    if strict:
        require_none(rejected)
    accepted_events(events, json=json).select(F.col(json).alias("value")).write.mode(
        "append"
    ).text(path)
    return rejected


def append_audit_counted(events: DataFrame, path: str, *, json: str) -> dict[str, int]:
    """Append the accepted events and count, in the one job that writes them: ``appended``, and by reason
    ``secret`` and ``not_an_object``. The events are read once."""
    whole = is_json_object(F.col(json))
    secret = has_secrets(F.col(json)) | (~whole & has_credential_value(F.col(json)))
    reason = F.when(secret, "secret").when(~whole, "not_an_object").otherwise("appended")
    seen = Observation("audit")
    counts = [F.count_if(F.col("_reason") == name).alias(name) for name in ("appended", "secret", "not_an_object")]
    judged = events.select(F.col(json).alias("value"), reason.alias("_reason")).observe(seen, *counts)
    judged.filter("_reason = 'appended'").select("value").write.mode("append").text(path)
    return dict(seen.get)


def write_items(items: DataFrame, path: str) -> dict[str, int]:
    """Write export items; ``item_count`` and ``total_bytes`` (UTF-8) come from the job that writes them."""
    seen = Observation("items")
    size = F.coalesce(F.sum(F.octet_length("content").cast("bigint")), F.lit(0))
    items.observe(seen, F.count("*").alias("item_count"), size.alias("total_bytes")).write.mode("errorifexists").parquet(path)
    return dict(seen.get)


def read_audit(spark: SparkSession, path: str, schema: str = AUDIT_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).json(path)


def stream_audit(spark: SparkSession, path: str, schema: str = AUDIT_SCHEMA) -> DataFrame:
    return spark.readStream.schema(schema).json(path)


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """Hash of every file of an input, to bind a batch to exact bytes."""
    return spark.read.format("binaryFile").load(path).select(
        "path", F.sha2("content", 256).alias("sha256")
    )


def require_hash(spark: SparkSession, path: str, expected: str) -> None:
    """Refuse an input whose files do not have the stated hash (one file) or fold of hashes."""
    from docwarden.operators.digests import fold_digests

    hashes = file_hashes(spark, path)
    actual = hashes.agg(
        F.count("*").alias("files"), F.min("sha256").alias("only")
    ).withColumn("fold", fold_digests(hashes, column="sha256").scalar())
    row = actual.head()
    if expected not in ({row["only"]} if row["files"] == 1 else set()) | {row["fold"]}:
        raise ViolationError("input hash differs from the approved one")


def read_graph(
    spark: SparkSession, nodes: str, edges: str, *, format: str = "parquet"
) -> tuple[DataFrame, DataFrame]:
    """Node and edge tables (parquet or JSON lines); unknown extra fields are ignored."""
    return (
        spark.read.format(format).schema(GRAPH_NODES).load(nodes),
        spark.read.format(format).schema(GRAPH_EDGES).load(edges),
    )


def read_graph_document(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and metadata of graphs kept as one JSON document per file."""
    schema = (
        "metadata struct<generated_at:string>, "
        f"nodes array<struct<{_struct(GRAPH_NODES)}>>, edges array<struct<{_struct(GRAPH_EDGES)}>>"
    )
    raw = spark.read.schema(schema).option("multiLine", "true").json(path)
    return (
        raw.select(F.inline("nodes")),
        raw.select(F.inline("edges")),
        raw.select("metadata.generated_at"),
    )


def _struct(ddl: str) -> str:
    return ", ".join(":".join(field.split()) for field in ddl.split(", "))


def read_derived_batch(
    spark: SparkSession, path: str, *, format: str = "json", expected_sha256: str | None = None
) -> DataFrame:
    if expected_sha256 is not None:
        require_hash(spark, path, expected_sha256)
    return spark.read.format(format).schema(DERIVED_SCHEMA).load(path)


def write_registry(registry: DataFrame, path: str, *, extra: str | None = None) -> None:
    """Write a new version of the roots table beside the earlier ones, so that a table made from the
    one before is not lost under it. The open part and every text column are checked for secrets."""
    secret = F.lit(False)
    for name, kind in registry.dtypes:
        if kind == "string" and name != extra:
            secret |= has_credential_value(F.col(name), "registry")
    require_none(registry.filter(secret).select("root", F.lit("secret").alias("violation")))
    if extra is not None:
        filled = registry.filter(F.col(extra).isNotNull())
        require_none(reject_secrets(filled, key="root", json=extra, family="registry"))
    registry.write.mode("errorifexists").parquet(f"{path}/{time.time_ns():020d}")


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """The last complete version."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    versions = [f.getPath() for f in files.listStatus(folder) if f.isDirectory()]
    done = [v.toString() for v in versions if files.exists(spark._jvm.org.apache.hadoop.fs.Path(v, "_SUCCESS"))]
    if not done:
        raise ViolationError("the roots table has no complete version")
    return spark.read.parquet(max(done))


def write_inventory(capsules: DataFrame, inventory: DataFrame, path: str) -> None:
    """Capsules and the id inventory as separate tables."""
    capsules.write.mode("errorifexists").parquet(f"{path}/capsules")
    inventory.write.mode("errorifexists").parquet(f"{path}/inventory")
