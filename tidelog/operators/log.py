"""Appending to a log and describing its segments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.binary import MAX_RECORD, record_size
from .prefix import running

PARTITION = ["topic", "partition"]
SEGMENT = [*PARTITION, "segment_base"]


def assign_offsets(batch: DataFrame, order: Sequence[str], next_offsets: DataFrame | None = None, block: Column | None = None) -> DataFrame:
    """Adds offset: dense within topic and partition, in the given order, from the partition's next offset (0 if it has none).

    block is an expression that follows the order (a day of the arrival time, for
    instance); it bounds what one task sorts. Without it a partition's batch is
    sorted in one task. The order must be total.
    """
    out = running(batch, PARTITION, order, F.lit(0) if block is None else block, position="offset")
    if next_offsets is None:
        return out
    start = next_offsets.select(*PARTITION, F.col("next_offset").alias("_start"))
    return out.join(start, PARTITION, "left").withColumn("offset", F.col("offset") + F.coalesce("_start", F.lit(0))).drop("_start")


def split_requests(batch: DataFrame, catalog: DataFrame, order: Sequence[str], request: str = "request_id", max_record: int = MAX_RECORD) -> DataFrame:
    """Adds code and accepted to the records of produce requests.

    Unknown topics and partitions: code 10. From a record above max_record on, a
    request's records aren't stored (code 500); those before it stay.
    """
    known = catalog.select(F.col("name").alias("topic"), "partition_count")
    joined = batch.join(known, "topic", "left")
    exists = F.coalesce((F.col("partition") >= 0) & (F.col("partition") < F.col("partition_count")), F.lit(False))
    large = (F.coalesce(F.octet_length("payload"), F.lit(0)) > max_record).cast("int")
    # The first failing place of a request, by an aggregate with partial results, not by a sort of the request.
    place = F.struct(*order)
    failed = joined.where(large == 1).groupBy(request).agg(F.min(place).alias("_failed"))
    out = joined.join(failed, request, "left")
    code = F.when(~exists, 10).when(place >= F.col("_failed"), 500)
    return out.withColumn("code", code).withColumn("accepted", code.isNull()).drop("_failed", "partition_count")


def produce_acks(stored: DataFrame, keys: Sequence[str] = PARTITION) -> DataFrame:
    """base_offset and record_count of each request (or topic and partition)."""
    return stored.groupBy(*keys).agg(F.min("offset").alias("base_offset"), F.count(F.lit(1)).alias("record_count"))


def oversize_records(log: DataFrame, max_record: int = MAX_RECORD) -> DataFrame:
    """Records whose payload is above the limit; a payload of exactly the limit is allowed."""
    return log.where(F.octet_length("payload") > max_record)


def with_segments(log: DataFrame, every: int = 100) -> DataFrame:
    """Adds record_size (if it isn't there) and segment_base: segments of ``every`` offsets."""
    if "record_size" not in log.columns:
        log = log.withColumn("record_size", record_size(F.col("payload")))
    return log.withColumn("segment_base", (F.floor(F.col("offset") / F.lit(every)) * every).cast("long"))


def segment_stats(log: DataFrame, created: str | None = None) -> DataFrame:
    """One row per segment: next_offset, max_offset, record_count, size_bytes, sealed and, with a time column, created_ms.

    The segment with the highest base of a partition is active, all others are
    sealed. Partial aggregation comes before the shuffle; the payload isn't read
    where record_size is stored.
    """
    more = [F.max(F.unix_millis(F.col(created).cast("timestamp"))).alias("created_ms")] if created else []
    stats = log.groupBy(*SEGMENT).agg(F.max("offset").alias("max_offset"), F.count(F.lit(1)).alias("record_count"), F.sum("record_size").alias("size_bytes"), *more)
    top = F.max("segment_base").over(Window.partitionBy(*PARTITION))
    return stats.withColumn("next_offset", F.col("max_offset") + 1).withColumn("sealed", F.col("segment_base") < top)


def partition_stats(log: DataFrame) -> DataFrame:
    """log_start, next_offset (the high watermark), record_count and size_bytes of each partition, from a log or from segment stats."""
    if "max_offset" in log.columns:
        return log.groupBy(*PARTITION).agg(F.min("segment_base").alias("log_start"), F.max("next_offset").alias("next_offset"), F.sum("record_count").alias("record_count"), F.sum("size_bytes").alias("size_bytes"))
    return log.groupBy(*PARTITION).agg(F.min("segment_base").alias("log_start"), (F.max("offset") + 1).alias("next_offset"), F.count(F.lit(1)).alias("record_count"), F.sum("record_size").alias("size_bytes"))


def offset_gaps(segments: DataFrame) -> DataFrame:
    """Ranges of offsets between the end of one segment and the base of the next that hold no record."""
    following = F.lead("segment_base").over(Window.partitionBy(*PARTITION).orderBy("segment_base"))
    return segments.withColumn("gap_end", following).where("gap_end > next_offset").select(*PARTITION, F.col("next_offset").alias("gap_start"), "gap_end", (F.col("gap_end") - F.col("next_offset")).alias("missing"))
