"""Incremental batches: new files are taken once, checked against what the sink holds, and appended."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.writers import append_remaining, part


def ingest_available(spark: SparkSession, source: str, sink: str, checkpoint: str, key: str | None, transform: Callable[[DataFrame], DataFrame] | None = None, files_per_batch: int = 1000) -> None:
    """Processes the Parquet files that have arrived since the last run and appends their rows to the sink.

    The checkpoint remembers the files. Without ``key`` each batch is a part of its own, and one that runs again after a failure
    replaces its part, so the sink is never read. With ``key`` only rows with new keys are appended, by a join with the sink's
    key column.
    """
    stream = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def batch(df: DataFrame, number: int) -> None:
        rows = transform(df) if transform else df
        append_remaining(rows, sink, key) if key else part(rows, sink, number, "batch")

    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
