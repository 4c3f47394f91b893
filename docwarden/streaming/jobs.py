"""Streaming forms of the same operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docwarden import vocab
from docwarden.operators import audit
from docwarden.operators.preflight import preflight
from docwarden.operators.quality import latest_per_id


def stream_preflight(documents: DataFrame, **options) -> DataFrame:
    """Preflight has no state, so the batch expressions run on a stream unchanged."""
    return preflight(documents, **options)


def stream_dedup(
    events: DataFrame,
    keys: tuple[str, ...] = ("operation_id", "phase"),
    *,
    event_time: str = "ts",
    delay: str = "10 minutes",
) -> DataFrame:
    """Idempotent operation events: a repetition within the watermark is dropped."""
    return events.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(keys))


def stream_outcomes(
    starts: DataFrame,
    ends: DataFrame,
    *,
    deadline_seconds: int = vocab.DEADLINE_SECONDS,
    delay: str = "10 minutes",
) -> DataFrame:
    """Starts joined with their terminal event; a start without one by the deadline comes out as
    ``timed_out`` once the watermark has passed. State is bounded by deadline and delay.

    Both inputs are event streams (operation_id, phase, ts), read separately."""
    keys = ("operation_id", "phase", "ts")
    once = lambda s: stream_dedup(s, keys, delay=delay)
    return audit.join_outcomes(
        audit.first_of_phase(once(starts), ("intended",), "start"),
        audit.first_of_phase(once(ends), vocab.TERMINAL_STATES, "end"),
        deadline_seconds=deadline_seconds,
    )


def stream_lifecycle(
    events: DataFrame, *, deadline_seconds: int = vocab.DEADLINE_SECONDS, delay: str = "10 minutes"
) -> DataFrame:
    """Sessions of operations with all their phases (see :func:`audit.lifecycle_sessions`), each once, when
    the watermark has passed its end. State is one row per open session."""
    return audit.lifecycle_sessions(events.withWatermark("ts", delay), deadline_seconds=deadline_seconds)


def upsert_batch(batch: DataFrame, path: str, batch_id: int, *, run: str = "batch") -> None:
    """Append one micro-batch as the partition of its run and number. A batch that is run again overwrites
    its own partition, so it counts once; another run has partitions of its own."""
    batch.write.mode("overwrite").parquet(f"{path}/run={run}/batch={int(batch_id)}")


def read_upserted(
    spark: SparkSession, path: str, *, key: str = "document_id", order: tuple[str, ...] = ("exported_at",)
) -> DataFrame:
    """The latest record of each id over all batches; of records with the same order value the greatest
    counts. Maxima combine before the shuffle, so an id with very many records is one row per task."""
    rows = spark.read.parquet(path).drop("run", "batch")
    return latest_per_id(rows, key=key, order=(*order, *[c for c in rows.columns if c not in order and c != key]))


def compact(spark: SparkSession, path: str, target: str, **options) -> None:
    """Write the latest records as a table of one batch at ``target``, for a stream to go on from."""
    upsert_batch(read_upserted(spark, path, **options), target, 0, run="compacted")


def stream_upsert(stream: DataFrame, path: str, checkpoint: str):
    """Write a stream of records as a table that :func:`read_upserted` reads with one row per id. The run is
    the query's id, which its checkpoint keeps over restarts."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        run = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "batch"
        upsert_batch(batch, path, batch_id, run=run)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
