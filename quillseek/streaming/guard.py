"""Filters are plain columns and run on streams as they are. Buckets that need all rows don't."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class UnsupportedInStreaming(ValueError):
    pass


def require_batch(df: DataFrame, what: str) -> None:
    if df.isStreaming:
        raise UnsupportedInStreaming(f"{what} needs all rows of its input, which a stream doesn't have")


def windowed_counts(df: DataFrame, time_col: str, duration: str, late: str, by: list[str] = (), slide: str | None = None, session: bool = False) -> DataFrame:
    """Counts for each window of event time; rows later than `late` are left out by the watermark.

    Windows are tumbling, or begin every `slide`, or are sessions that end after `duration`
    without a row of the same `by` (a stream's sessions need one).
    """
    # watermarks need timestamps of an instant; those without a zone are taken in the session's
    held = df.withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, late)
    if session and not by:
        raise UnsupportedInStreaming("sessions need a field that tells them apart")
    window = F.session_window(time_col, duration) if session else F.window(time_col, duration, slide)
    counts = held.groupBy(window.alias("window"), *by).agg(F.count(F.lit(1)).alias("doc_count"))
    ends = [F.col("window.end").alias("end")] if session else []
    return counts.select(F.col("window.start").alias("start"), *ends, *by, "doc_count")
