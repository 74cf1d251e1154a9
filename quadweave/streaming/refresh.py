"""A change stream applied to a graph in micro-batches, and streaming counterparts of reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.commit import first_report


def _timed(df: DataFrame, at: str) -> DataFrame:
    """Event times as timestamps; watermarks don't take those without a zone."""
    return df.withColumn(at, F.col(at).cast("timestamp"))


def first_reports(reports: DataFrame, task: str, at: str, delay: str = "1 hour") -> DataFrame:
    """A stream of task reports without repeats that come within the delay."""
    return _timed(reports, at).withWatermark(at, delay).dropDuplicatesWithinWatermark([task])


def windowed_counts(events: DataFrame, at: str, by: str, length: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Events and their summed value per window and kind; a window is final once the watermark passes it."""
    return (
        _timed(events, at)
        .withWatermark(at, delay)
        .groupBy(F.window(at, length), by)
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select(F.col("window.start").alias("window_start"), by, "n", "total")
    )


def latest_versions(changes: DataFrame, key: str) -> DataFrame:
    """Running number of commits of each key (complete or update mode)."""
    return changes.groupBy(key).agg(F.count("*").alias("version"))


def refresh_stream(changes: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Apply every micro-batch of a change stream by ``apply(batch, number)``.

    A batch may be run again after a failure, so ``apply`` must write its
    result under the batch number.
    """
    writer = changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def last_report_of_batch(batch: DataFrame, task: str, at: str) -> DataFrame:
    """First report per task within one batch (for ``foreachBatch``)."""
    return first_report(batch, task, [F.col(at)])
