"""Latest-value-per-key compaction with tombstones and a checkpoint that only advances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .log import PARTITION, SEGMENT


def eligible_segments(segments: DataFrame, checkpoints: DataFrame | None, high_watermark: Column | int) -> DataFrame:
    """Sealed segments above the checkpoint (null or absent: all), up to the first of them that reaches the high watermark."""
    mark = F.lit(high_watermark) if isinstance(high_watermark, int) else high_watermark
    out = segments.where("sealed")
    if checkpoints is not None:
        out = out.join(checkpoints.select(*PARTITION, "last_compacted_offset"), PARTITION, "left")
        out = out.where("last_compacted_offset is null or segment_base > last_compacted_offset").drop("last_compacted_offset")
    up_to = Window.partitionBy(*PARTITION).orderBy("segment_base").rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("_held", F.max((F.col("max_offset") >= mark).cast("int")).over(up_to)).where("_held = 0").drop("_held")


def latest_per_key(records: DataFrame) -> DataFrame:
    """The record with the highest offset of each key (of equal ones that which came last), tombstones among them.

    One aggregate with partial results, so a key that most records have is no hot spot.
    """
    best = F.max(F.struct("offset", "ingest_seq", "value")).alias("best")
    return records.groupBy(*PARTITION, "key").agg(best, F.count(F.lit(1)).alias("n_records")).select(*PARTITION, "key", "best.offset", "best.ingest_seq", "best.value", "n_records")


def compact(log: DataFrame, eligible: DataFrame) -> DataFrame:
    """The log after compaction: eligible segments give way to one per partition, named by its first surviving offset; offsets stay."""
    ids = eligible.select(*SEGMENT)
    kept = latest_per_key(log.join(ids, SEGMENT, "left_semi")).drop("n_records")
    base = kept.groupBy(*PARTITION).agg(F.min("offset").alias("segment_base"))
    kept = kept.join(base, PARTITION)
    columns = [*SEGMENT, "offset", "ingest_seq", "key", "value"]
    return log.join(ids, SEGMENT, "left_anti").select(*columns).unionByName(kept.select(*columns))


def compaction_result(log: DataFrame, eligible: DataFrame) -> DataFrame:
    """Per partition: segments_rewritten, records_in, records_kept, records_dropped and highest_compacted (the greatest offset that was read)."""
    rows = log.join(eligible.select(*SEGMENT), SEGMENT, "left_semi")
    per_key = rows.groupBy(*PARTITION, "key").agg(F.count(F.lit(1)).alias("n"), F.max("offset").alias("last"))
    counts = per_key.groupBy(*PARTITION).agg(F.sum("n").alias("records_in"), F.count(F.lit(1)).alias("records_kept"), F.max("last").alias("highest_compacted"))
    segments = eligible.groupBy(*PARTITION).agg(F.count(F.lit(1)).alias("segments_rewritten"))
    return segments.join(counts, PARTITION).withColumn("records_dropped", F.col("records_in") - F.col("records_kept"))


def advance_checkpoints(checkpoints: DataFrame, results: DataFrame) -> DataFrame:
    """Checkpoints with each partition's new last_compacted_offset and error: going back is refused (the old one stays), the same offset is fine."""
    new = results.select(*PARTITION, F.col("highest_compacted").alias("_new"))
    out = checkpoints.join(new, PARTITION, "full")
    back = F.coalesce(F.col("_new") < F.col("last_compacted_offset"), F.lit(False))
    out = out.withColumn("error", F.when(back, F.lit("checkpoint would go back")))
    return out.withColumn("last_compacted_offset", F.when(back, F.col("last_compacted_offset")).otherwise(F.coalesce("_new", "last_compacted_offset"))).drop("_new")


def sound_checkpoints(checkpoints: DataFrame) -> DataFrame:
    """Checkpoints as they are used: a negative offset or time (an invalid mark, such as an unsigned maximum) is reset; corrupt says which."""
    bad = F.coalesce(F.col("last_compacted_offset") < 0, F.lit(False)) | F.coalesce(F.col("last_retention_run_ms") < 0, F.lit(False))
    out = checkpoints.withColumn("corrupt", bad)
    out = out.withColumn("last_compacted_offset", F.when(~F.col("corrupt"), F.col("last_compacted_offset")))
    return out.withColumn("last_retention_run_ms", F.when(F.col("corrupt"), F.lit(0).cast("long")).otherwise(F.coalesce("last_retention_run_ms", F.lit(0).cast("long"))))
