"""Session settings and durable intermediate results."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def build_session(
    app: str, *, master: str | None = None, conf: dict[str, str] | None = None
) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it. Only a local session, which has one
    machine, gets a temporary folder where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="docwarden-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def run_folder(spark: SparkSession) -> str:
    """This application's own folder below the shared one."""
    return f"{shared_folder(spark)}/docwarden-{spark.sparkContext.applicationId}"


def drop_run_folder(spark: SparkSession) -> None:
    """Remove what this application wrote for its own use; its results must have been read by then."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


HASHED_BYTES = 64 << 20


def prefer_hash_joins(spark: SparkSession) -> None:
    """Let adaptive execution hash the side of a join whose shuffled partitions all hold at most this much,
    as measured, in place of sorting both. It does so only from its own partition size upwards."""
    spark.conf.set("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", str(HASHED_BYTES))


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a result that several later steps read, so that it is computed once and survives the
    loss of executors. What was shuffled for it is removed when it is written; otherwise it would lie on the
    executors' disks until the driver happens to collect its garbage."""
    spark = df.sparkSession
    path = f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"
    held = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if held is None else spark.conf.set(SHUFFLE_CLEANUP, held)
    return spark.read.schema(df.schema).parquet(path)
