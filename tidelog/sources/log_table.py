"""A log as Parquet files on a shared file system, in batches that count as a whole.

A batch's records are written by Spark below staging/, its segment rows and the
segments that it replaces beside them; then its folder of records is renamed to
log/batch=N. That rename is the commit: nothing of a batch is read before it, by
queries or streams, and a batch that was cut short is written over by the next one
under the same number. Records lie in folders by topic and partition, which reads
prune. One writer per table at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.binary import record_size
from ..operators.log import PARTITION, SEGMENT, assign_offsets, segment_stats
from . import shared

LOG_SCHEMA = "topic string, partition int, segment_base long, offset long, record_size long, payload binary, ingest_ms long, request_id long, batch long"
SEGMENT_SCHEMA = "topic string, partition int, segment_base long, max_offset long, record_count long, size_bytes long, created_ms long, batch long"
#: Segments of batches up to ``upto`` that are deleted or replaced.
DELETED_SCHEMA = "topic string, partition int, segment_base long, upto long, batch long"
#: Offsets of a segment in a table that is written here.
SEGMENT_RECORDS = 100_000
#: A list of at most so many deleted segments is broadcast (some 10 MB).
BROADCAST_SEGMENTS = 100_000


class LogTable:
    def __init__(self, spark: SparkSession, path: str, segment_records: int = SEGMENT_RECORDS) -> None:
        self.spark, self.path, self.segment_records = spark, path.rstrip("/"), segment_records

    def last_batch(self) -> int:
        """The last batch that was committed; -1 if there is none."""
        return max((int(n.split("=")[1]) for n in shared.names(self.spark, f"{self.path}/log") if n.startswith("batch=")), default=-1)

    def _read(self, name: str, schema: str) -> DataFrame:
        last = self.last_batch()
        if last < 0 or not shared.names(self.spark, f"{self.path}/{name}"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}").where(F.col("batch") <= last)

    def live(self, rows: DataFrame) -> DataFrame:
        """Rows (with a segment and a batch) without those of segments that were deleted or replaced since."""
        gone = self._read("deleted", DELETED_SCHEMA).groupBy(*SEGMENT).agg(F.max("upto").alias("_upto"))
        small = gone.count() <= BROADCAST_SEGMENTS
        rows = rows.join(F.broadcast(gone) if small else gone, SEGMENT, "left")
        return rows.where(F.col("_upto").isNull() | (F.col("batch") > F.col("_upto"))).drop("_upto")

    def records(self, topic: str | None = None, partition: int | None = None, start: int | None = None) -> DataFrame:
        """All records of committed batches, without those of deleted segments; those of one topic, partition or from an offset on are pruned and pushed down."""
        rows = self._read("log", LOG_SCHEMA)
        for name, value in (("topic", topic), ("partition", partition)):
            rows = rows if value is None else rows.where(F.col(name) == value)
        return self.live(rows if start is None else rows.where(F.col("offset") >= start))

    def segments(self) -> DataFrame:
        """One row per segment: a segment that several batches wrote to is summed up; the last of a partition is active."""
        rows = self.live(self._read("segments", SEGMENT_SCHEMA))
        stats = rows.groupBy(*SEGMENT).agg(F.max("max_offset").alias("max_offset"), F.sum("record_count").alias("record_count"), F.sum("size_bytes").alias("size_bytes"), F.max("created_ms").alias("created_ms"))
        top = self.next_offsets().select(*PARTITION, "_top")
        return stats.join(top, PARTITION).withColumn("sealed", F.col("segment_base") < F.col("_top")).withColumn("next_offset", F.col("max_offset") + 1).drop("_top")

    def next_offsets(self) -> DataFrame:
        """next_offset (and the active segment) of each partition, from the segments' rows alone; deleted segments count too, so offsets are never used again."""
        return self._read("segments", SEGMENT_SCHEMA).groupBy(*PARTITION).agg((F.max("max_offset") + 1).alias("next_offset"), F.max("segment_base").alias("_top"))

    def append(self, batch: DataFrame, order: list[str], now_ms: int, block: Column | None = None, number: int | None = None) -> int:
        """Stores a batch (topic, partition, payload, the order's columns and perhaps request_id) and returns its number.

        number makes an append idempotent: a batch that is committed already isn't written again.
        """
        last = self.last_batch()
        number = last + 1 if number is None else number
        if number <= last:
            return number
        request = F.col("request_id").cast("long") if "request_id" in batch.columns else F.lit(None).cast("long").alias("request_id")
        rows = assign_offsets(batch, order, self.next_offsets(), block)
        rows = rows.select(*PARTITION, (F.floor(F.col("offset") / self.segment_records) * self.segment_records).cast("long").alias("segment_base"), "offset", record_size(F.col("payload")).alias("record_size"), "payload", F.lit(now_ms).cast("long").alias("ingest_ms"), request)
        self._commit(number, rows, F.lit(now_ms).cast("long"))
        return number

    def replace(self, old: DataFrame, rows: DataFrame, created: Column) -> int:
        """Replaces segments by other records (the log's columns but for batch), or deletes them if there are none, in one commit; returns its number.

        Offsets stay as they are, and are never given again.
        """
        number = self.last_batch() + 1
        gone = old.select(*SEGMENT, F.lit(number - 1).cast("long").alias("upto"))
        gone.write.mode("overwrite").parquet(f"{self.path}/deleted/batch={number}")
        self._commit(number, rows, created)
        return number

    def _commit(self, number: int, rows: DataFrame, created: Column) -> None:
        at = f"{self.path}/staging/batch={number}"
        rows.sortWithinPartitions(*PARTITION, "offset").write.mode("overwrite").partitionBy(*PARTITION).parquet(at)
        written = self.spark.read.schema(LOG_SCHEMA.rsplit(",", 1)[0]).parquet(at)
        stats = segment_stats(written).drop("next_offset", "sealed").join(written.groupBy(*SEGMENT).agg(F.max("ingest_ms").alias("_ingest")), SEGMENT)
        stats.withColumn("created_ms", F.coalesce(created, "_ingest")).drop("_ingest").write.mode("overwrite").parquet(f"{self.path}/segments/batch={number}")
        shared.rename(self.spark, at, f"{self.path}/log/batch={number}")

    def delete_segments(self, expired: DataFrame) -> None:
        """Deletes segments; reads leave them out from then on."""
        self.replace(expired, self.spark.createDataFrame([], LOG_SCHEMA.rsplit(",", 1)[0]), F.lit(None).cast("long"))

    def vacuum(self) -> int:
        """Removes the records of batches that have no live segment; returns of how many. The last batch stays, as its number is the commit."""
        last, there = self.last_batch(), self._read("segments", SEGMENT_SCHEMA).select(*SEGMENT, "batch")
        used = {r["batch"] for r in self.live(there).select("batch").distinct().toLocalIterator()}
        every = [int(n.split("=")[1]) for n in shared.names(self.spark, f"{self.path}/log") if n.startswith("batch=")]
        done = [n for n in every if n not in used and n < last]
        for n in done:
            shared.delete(self.spark, f"{self.path}/log/batch={n}")
        return len(done)
