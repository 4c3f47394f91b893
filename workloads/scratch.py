"""Folders for stream checkpoints and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from docwarden.session import run_folder


def scratch_folder(spark: SparkSession, name: str) -> str:
    """Below this application's part of the cluster's shared folder."""
    return f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"


def run_stream(stream: DataFrame) -> DataFrame:
    """Process all available input into a table and read that."""
    folder = scratch_folder(stream.sparkSession, "stream")
    running = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", f"{folder}/rows")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")
