"""The engine's verbs on one path of a shared file system: topics, produce, fetch, commits, retention and metrics."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import BadPartitionCount, DuplicateTopic, UnknownDescribedPartition, UnknownPartition, UnknownTopic
from .functions.binary import decode_key_value, record_size
from .operators import catalog, compaction, fetch, log, metrics, offsets, retention
from .sources import shared
from .sources.log_table import LogTable

COMMITS = "group string, topic string, partition int, offset long, commit_seq long"


class LogEngine:
    """One writer at a time. Data stays in DataFrames; only answers about one topic or partition come to the driver."""

    def __init__(self, spark: SparkSession, path: str, segment_records: int = 100_000) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.table = LogTable(spark, f"{self.path}/data", segment_records)

    def _rows(self, name: str, schema: str) -> DataFrame:
        where = f"{self.path}/{name}"
        return self.spark.read.schema(schema).parquet(where) if shared.names(self.spark, where) else self.spark.createDataFrame([], schema)

    def topics(self) -> DataFrame:
        return self._rows("topics", "name string, partition_count int")

    def create_topic(self, name: str, partition_count: int) -> None:
        if partition_count <= 0:
            raise BadPartitionCount(f"{name}: a topic needs partitions")
        if not self.topics().where(F.col("name") == name).isEmpty():
            raise DuplicateTopic(name)
        self.spark.createDataFrame([(name, partition_count)], "name string, partition_count int").coalesce(1).write.mode("append").parquet(f"{self.path}/topics")

    def list_topics(self) -> DataFrame:
        return catalog.list_topics(self.topics())

    def describe_topic(self, name: str) -> DataFrame:
        known = self.topics().where(F.col("name") == name)
        if known.isEmpty():
            raise UnknownTopic(name)
        return catalog.describe_partitions(known, self.table.segments())

    def describe_partition(self, topic: str, partition: int) -> DataFrame:
        known = self.topics().where((F.col("name") == topic) & (F.lit(partition) >= 0) & (F.col("partition_count") > partition))
        if known.isEmpty():
            raise UnknownDescribedPartition(f"{topic}/{partition}")
        return catalog.describe_partitions(known, self.table.segments()).where(F.col("partition") == partition)

    def produce(self, batch: DataFrame, order: list[str], number: int | None = None, block: Column | None = None) -> DataFrame:
        """Appends a batch (request_id, topic, partition, payload, order's columns): one row per request, topic and partition with base_offset, record_count and code.

        block is an expression that follows the order and bounds what one task
        sorts of a partition's batch, as in assign_offsets().
        """
        checked = log.split_requests(batch, self.topics(), order)
        rows = checked.where("accepted").select("request_id", "topic", "partition", "payload", *[c for c in order if c != "request_id"])
        number = self.table.append(rows, order, int(time.time() * 1000), block, number)
        keys = ["request_id", *log.PARTITION]
        acks = log.produce_acks(self.table.records().where(F.col("batch") == number), keys)
        codes = checked.groupBy(*keys).agg(F.max("code").alias("code"))
        return codes.join(acks, keys, "left")

    def fetch(self, topic: str, partition: int, offset: int = 0, max_bytes: int = 1 << 20, group: str = "") -> DataFrame:
        """Records from an offset, or from a group's committed position. Unknown topics and partitions are an error, but for a group without a commit."""
        asked = self.spark.createDataFrame([(0, group, topic, partition, offset, max_bytes)], "request_id long, group string, topic string, partition int, offset long, max_bytes long")
        asked = fetch.resolve_requests(asked, offsets.committed_offsets(self.commits()))
        segments = self.table.segments()
        code = catalog.check_partitions(asked, self.topics(), 10).first()
        if code["code"] and code["start"] is not None:
            raise UnknownPartition(f"{topic}/{partition}")
        if code["start"] is None:
            return self.table.records(topic, partition).drop("request_id").limit(0)
        mine = self.table.records(topic, partition, code["start"]).drop("request_id")
        own = segments.where((F.col("topic") == topic) & (F.col("partition") == partition))
        return fetch.fetch_records(mine, asked, own).drop("request_id").orderBy("offset")

    def commits(self) -> DataFrame:
        return self._rows("commits", COMMITS)

    def commit(self, group: str, topic: str, partition: int, offset: int) -> None:
        """Stores a position; unknown topics are allowed, and positions may go back."""
        row = [(group, topic, partition, offset, time.time_ns())]
        self.spark.createDataFrame(row, COMMITS).coalesce(1).write.mode("append").parquet(f"{self.path}/commits")

    def committed(self, group: str, topic: str, partition: int) -> int | None:
        mine = self.commits().where((F.col("group") == group) & (F.col("topic") == topic) & (F.col("partition") == partition))
        row = offsets.committed_offsets(mine).first()
        return row["offset"] if row else None

    def lag(self) -> DataFrame:
        return offsets.consumer_lag(self.commits(), self.table.segments())

    def _marked(self) -> DataFrame:
        """Segments with the high watermark of their partition: its next offset."""
        marks = self.table.next_offsets().select(*log.PARTITION, F.col("next_offset").alias("_mark"))
        return self.table.segments().join(marks, log.PARTITION)

    def _saved(self, df: DataFrame, tag: str) -> DataFrame:
        where = shared.shared_path(self.spark, tag)
        df.write.parquet(where)
        return self.spark.read.schema(df.schema).parquet(where)

    def apply_retention(self, config: retention.RetentionConfig, now_ms: int | None = None, interval_ms: int = 0) -> DataFrame:
        """Deletes expired segments and returns how many and how many bytes; nothing within interval_ms of the last run. The high watermark is each partition's next offset."""
        now_ms = int(time.time() * 1000) if now_ms is None else now_ms
        segments = self._marked()
        last = self._rows("retention_runs", "last_retention_run_ms long").agg(F.max("last_retention_run_ms").alias("last_retention_run_ms"))
        if retention.with_skip(last, now_ms, interval_ms).first()["skip"]:
            return retention.retention_summary(segments.limit(0))
        gone = retention.expired_by_time(segments, config.retention_ms, now_ms, F.col("_mark"))
        left = segments.join(gone.select(*log.SEGMENT), log.SEGMENT, "left_anti")
        gone = self._saved(gone.unionByName(retention.expired_by_size(left, config.retention_bytes, F.col("_mark"))).drop("_mark"), "expired")
        if not gone.isEmpty():
            self.table.delete_segments(gone)
        self.spark.createDataFrame([(now_ms,)], "last_retention_run_ms long").coalesce(1).write.mode("append").parquet(f"{self.path}/retention_runs")
        return retention.retention_summary(gone)

    def compact(self) -> DataFrame:
        """Compacts eligible sealed segments of keyed payloads into one per partition, and returns the counts of compaction_result().

        Of each key the latest record stays, tombstones among them, with its
        offset. Records whose payload has no key can't be compacted and stay. The
        segments are replaced in one commit; only what is sealed and lies above a
        partition's last compacted offset is taken.
        """
        done = self._rows("compactions", "topic string, partition int, last_compacted_offset long").groupBy(*log.PARTITION).agg(F.max("last_compacted_offset").alias("last_compacted_offset"))
        eligible = self._saved(compaction.eligible_segments(self._marked(), done, F.col("_mark")), "eligible")
        stored = self.table.records()
        read = stored.join(eligible.select(*log.SEGMENT), log.SEGMENT, "left_semi").withColumn("_kv", decode_key_value(F.col("payload")))
        keyed = read.where("_kv.key is not null").select(*log.SEGMENT, "offset", "batch", "ingest_ms", "request_id", "payload", F.col("_kv.key").alias("key"))
        kept = keyed.groupBy(*log.PARTITION, "key").agg(F.max(F.struct("offset", "batch", "ingest_ms", "request_id", "payload")).alias("r")).select(*log.PARTITION, "r.*")
        kept = kept.unionByName(read.where("_kv.key is null").select(*log.PARTITION, "offset", "batch", "ingest_ms", "request_id", "payload"))
        base = kept.groupBy(*log.PARTITION).agg(F.min("offset").alias("segment_base"))
        rows = kept.join(base, log.PARTITION).select(*log.SEGMENT, "offset", record_size(F.col("payload")).alias("record_size"), "payload", "ingest_ms", "request_id")
        result = self._saved(compaction.compaction_result(keyed, eligible), "compaction")
        if not eligible.isEmpty():
            self.table.replace(eligible, rows, F.lit(None).cast("long"))
            result.select(*log.PARTITION, F.col("highest_compacted").alias("last_compacted_offset")).write.mode("append").parquet(f"{self.path}/compactions")
        return result

    def metrics_text(self, samples: DataFrame) -> DataFrame:
        """The text export: totals of what is stored, latency samples of the caller, and every group's lag."""
        t = self.table.segments().agg(F.coalesce(F.sum("record_count"), F.lit(0)).alias("n"), F.coalesce(F.sum("size_bytes") - 12 * F.sum("record_count"), F.lit(0)).alias("b"))
        events = t.selectExpr("stack(2, 'messages_produced_total', n, 'bytes_in_total', b) as (name, delta)")
        return metrics.prometheus_lines(events, samples, self.lag()).orderBy("section", "line")

    def ping(self) -> str:
        return "pong"

    def register_views(self) -> None:
        """Makes log, segments, topics and commits known to Spark SQL."""
        for name, df in (("log", self.table.records()), ("segments", self.table.segments()), ("topics", self.topics()), ("commits", self.commits())):
            df.createOrReplaceTempView(name)
