"""Incremental ingest and sessions over Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from mediacat.operators.mutations import incremental


def ingest(files: DataFrame, current: Callable[[], DataFrame], apply: Callable[[DataFrame, int], None], checkpoint: str) -> DataStreamWriter:
    """A writer that hands each batch's new and changed files to ``apply(rows, batch_id)``.

    ``current`` gives the media table as of now; ``apply`` should be idempotent by batch id,
    as a batch may come again after a failure.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        latest = batch.groupBy("file_path").agg(F.max_by(F.struct(*batch.columns), "file_modified_time").alias("f")).select("f.*")
        apply(incremental(latest, current()), batch_id)

    return files.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)


def sessions(events: DataFrame, at: str = "ts", key: str = "user_id", gap: str = "4 hours", late: str = "1 day") -> DataFrame:
    """Sessions by key with their first and last event; the streaming form of the event gap.

    Works on batches too. An event exactly ``gap`` after the last one is in the same session,
    so the window's gap is one microsecond longer.
    """
    timed = events.withColumn(at, F.col(at).cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark(at, late)
    window = F.session_window(at, f"{gap} 1 microsecond")
    return timed.groupBy(key, window.alias("w")).agg(F.count("*").alias("n"), F.min(at).alias("first"), F.max(at).alias("last")).drop("w")
