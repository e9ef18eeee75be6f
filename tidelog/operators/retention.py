"""Retention by age and by size, over segment stats: only sealed segments that every reader could have passed may go."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .log import PARTITION, SEGMENT

#: Fixed value: seven days.
WEEK_MS = 7 * 24 * 3600 * 1000


@dataclass(frozen=True)
class RetentionConfig:
    """None disables a limit."""

    retention_ms: int | None = WEEK_MS
    retention_bytes: int | None = None
    compaction: bool = False


def expired_by_time(segments: DataFrame, retention_ms: int | None, now_ms: int, high_watermark: Column | int) -> DataFrame:
    """Sealed segments created before now_ms - retention_ms that end below the high watermark; others are passed over, so holes may arise."""
    if retention_ms is None:
        return segments.limit(0)
    mark = F.lit(high_watermark) if isinstance(high_watermark, int) else high_watermark
    return segments.where(F.col("sealed") & (F.col("created_ms") < now_ms - retention_ms) & (F.col("max_offset") < mark))


def expired_by_size(segments: DataFrame, retention_bytes: int | None, high_watermark: Column | int) -> DataFrame:
    """Sealed segments, oldest first, as long as the sealed ones that remain exceed the limit; the first that reaches the high watermark stops it.

    The window is over one row per segment, after pre-aggregation.
    """
    if retention_bytes is None:
        return segments.limit(0)
    mark = F.lit(high_watermark) if isinstance(high_watermark, int) else high_watermark
    sealed = segments.where("sealed")
    up_to = Window.partitionBy(*PARTITION).orderBy("segment_base").rowsBetween(Window.unboundedPreceding, 0)
    held = F.max((F.col("max_offset") >= mark).cast("int")).over(up_to)
    remaining = F.sum("size_bytes").over(Window.partitionBy(*PARTITION)) - F.sum("size_bytes").over(up_to) + F.col("size_bytes")
    return sealed.withColumn("_held", held).withColumn("_remaining", remaining).where((F.col("_held") == 0) & (F.col("_remaining") > retention_bytes)).drop("_held", "_remaining")


def retention_summary(expired: DataFrame) -> DataFrame:
    """segments_deleted and bytes_reclaimed in all; zeros if nothing expired."""
    return expired.agg(F.count(F.lit(1)).alias("segments_deleted"), F.coalesce(F.sum("size_bytes"), F.lit(0).cast("long")).alias("bytes_reclaimed"))


def without_segments(log: DataFrame, expired: DataFrame) -> DataFrame:
    """The log without the expired segments' records."""
    return log.join(expired.select(*SEGMENT).distinct(), SEGMENT, "left_anti")


def with_skip(checkpoints: DataFrame, now_ms: int, interval_ms: int) -> DataFrame:
    """Adds skip: retention ran within the interval (0 or null: never ran). A clock that went back counts as no time."""
    last = F.coalesce(F.col("last_retention_run_ms"), F.lit(0).cast("long"))
    passed = F.greatest(F.lit(now_ms).cast("long") - last, F.lit(0).cast("long"))
    return checkpoints.withColumn("skip", (last != 0) & (passed < interval_ms))
