"""One query per operator over the sample logs, each a function of (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import LogEngine
from ..functions import binary, frames
from ..operators import catalog, compaction, fetch, limits, log, metrics, offsets, retention, sparse_index
from ..operators.log import PARTITION, SEGMENT
from ..sources import samples, segment_files, shared
from ..sources.samples import table
from ..streaming import consume

#: Parameters that make the queries tell something on the sample tables.
RATE, RATE_WINDOW_MS = 300, 86_400_000
RETAIN_BYTES, RETENTION_NOW_MS, RETENTION_AGE_MS = 5000, 1_705_881_600_000, 604_800_000
CHECKPOINT = 99
BUILD_EVERY = 25

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _text(rows: DataFrame) -> DataFrame:
    return rows.select("topic", "partition", "offset", F.col("payload").cast("string").alias("payload"))


def _all_partitions(stats: DataFrame, start: int, max_bytes: int) -> DataFrame:
    """A request for each partition of a log."""
    each = stats.select(*PARTITION).distinct()
    return each.select(F.concat_ws("/", *PARTITION).alias("request_id"), F.lit("").alias("group"), *PARTITION, F.lit(start).cast("long").alias("start"), F.lit(max_bytes).cast("long").alias("max_bytes"))


@query
def produce_offsets(spark, sf_dir):
    return samples.event_log(spark, sf_dir).select("event_id", "topic", "partition", "offset", "record_size")


@query
def produce_ack(spark, sf_dir):
    return log.produce_acks(samples.event_log(spark, sf_dir))


@query
def produce_rejects(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    batch = d.select(F.floor(F.col("doc_id") / 10).alias("request_id"), F.col("doc_id").alias("seq"), F.when(F.col("doc_id") % 70 < 10, "nowhere").otherwise(F.col("lang")).alias("topic"), (F.floor(F.col("doc_id") / 10) % 5).cast("int").alias("partition"), F.encode("text", "UTF-8").alias("payload"))
    out = log.split_requests(batch, samples.topics_of(d.select(F.col("lang").alias("topic"))), ["seq"], max_record=10_000)
    return out.groupBy("request_id").agg(F.count_if(F.col("accepted")).alias("stored"), F.count_if(~F.col("accepted")).alias("refused"), F.max("code").alias("code"))


@query
def engine_produce_acks(spark, sf_dir):
    """The engine's own answers to requests of ten documents each, many of them to one partition."""
    d = table(spark, sf_dir, "documents").where("lang is not null")
    engine = LogEngine(spark, shared.shared_path(spark, "engine"))
    for lang in sorted(r["lang"] for r in d.select("lang").distinct().collect()):
        engine.create_topic(lang, 4)
    batch = d.select(F.floor(F.col("doc_id") / 10).alias("request_id"), F.col("doc_id").alias("seq"), F.col("lang").alias("topic"), (F.floor(F.col("doc_id") / 10) % 4).cast("int").alias("partition"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("payload"))
    return engine.produce(batch, ["seq"], block=F.floor(F.col("seq") / 1_000_000)).select("request_id", *PARTITION, "base_offset", "record_count", "code")


@query
def engine_compacted_log(spark, sf_dir):
    """A keyed topic that the engine stores, compacts and reads again."""
    d = table(spark, sf_dir, "documents")
    engine = LogEngine(spark, shared.shared_path(spark, "engine"), segment_records=64)
    engine.create_topic("kept", 3)
    pair = binary.encode_key_value(F.encode(F.concat_ws("/", "lang", "source"), "UTF-8"), F.encode(F.col("doc_id").cast("string"), "UTF-8"))
    engine.produce(d.select(F.lit(1).alias("request_id"), F.col("doc_id").alias("seq"), F.lit("kept").alias("topic"), (F.col("doc_id") % 3).cast("int").alias("partition"), pair.alias("payload")), ["seq"], block=F.floor(F.col("seq") / 1_000_000))
    engine.compact()
    rows = engine.table.records().withColumn("kv", binary.decode_key_value(F.col("payload")))
    return rows.select(*SEGMENT, "offset", F.col("kv.key").cast("string").alias("key"), F.col("kv.value").cast("string").alias("value"))


@query
def oversize_rejects(spark, sf_dir):
    return log.oversize_records(samples.document_log(spark, sf_dir), 10_000).select("topic", "partition", "offset", "record_size")


@query
def fetch_budget(spark, sf_dir):
    return _text(fetch.fetch_all_partitions(samples.event_log(spark, sf_dir), 5, 300))


@query
def fetch_budget_docs(spark, sf_dir):
    return fetch.fetch_all_partitions(samples.document_log(spark, sf_dir), 2, 20_000).select("topic", "partition", "offset", "record_size", F.sha2("payload", 256).alias("payload_sha256"))


@query
def fetch_first_record_exempt(spark, sf_dir):
    return fetch.fetch_all_partitions(samples.document_log(spark, sf_dir), 0, 1).select("topic", "partition", "offset", "record_size")


def _summary(spark, sf_dir, start: int, max_bytes: int, rows: DataFrame | None = None) -> DataFrame:
    rows = samples.event_log(spark, sf_dir) if rows is None else rows
    stats = log.segment_stats(rows)
    return fetch.fetch_summary(rows, _all_partitions(stats, start, max_bytes), stats).drop("request_id", "code")


@query
def fetch_zero_budget(spark, sf_dir):
    return _summary(spark, sf_dir, 5, 0)


@query
def fetch_past_end(spark, sf_dir):
    return _summary(spark, sf_dir, 1_000_000_000, 300)


@query
def fetch_below_start(spark, sf_dir):
    return _summary(spark, sf_dir, 5, 300, samples.event_log(spark, sf_dir).where("segment_base > 0"))


@query
def fetch_across_gap(spark, sf_dir):
    return _summary(spark, sf_dir, 90, 600, samples.event_log(spark, sf_dir).where("segment_base <> 100"))


@query
def fetch_unknown_topic(spark, sf_dir):
    rows = samples.event_log(spark, sf_dir)
    n = table(spark, sf_dir, "nation")
    asked = n.select(F.col("n_nationkey").cast("long").alias("request_id"), F.when(F.col("n_nationkey") % 2 == 0, "click").otherwise(F.col("n_name")).alias("topic"), (F.col("n_nationkey") % 7).cast("int").alias("partition"), F.lit(1).cast("long").alias("start"), F.lit(100).cast("long").alias("max_bytes"))
    return fetch.fetch_summary(rows, asked, catalog=samples.topics_of(rows))


def _group_requests(spark, sf_dir) -> DataFrame:
    """Each group asks for each partition; g9 has never committed."""
    c = samples.event_commits(spark, sf_dir)
    groups = c.select("group", *PARTITION).distinct()
    none = groups.where("group = 'g0'").withColumn("group", F.lit("g9"))
    return groups.unionByName(none).select(F.concat_ws("/", "group", *PARTITION).alias("request_id"), "group", *PARTITION, F.lit(999).cast("long").alias("offset"), F.lit(200).cast("long").alias("max_bytes"))


@query
def group_fetch(spark, sf_dir):
    asked = fetch.resolve_requests(_group_requests(spark, sf_dir), offsets.committed_offsets(samples.event_commits(spark, sf_dir)))
    rows = fetch.fetch_records(samples.event_log(spark, sf_dir), asked)
    return rows.select("request_id", "offset", F.col("payload").cast("string").alias("payload"))


@query
def group_fetch_summary(spark, sf_dir):
    asked = fetch.resolve_requests(_group_requests(spark, sf_dir), offsets.committed_offsets(samples.event_commits(spark, sf_dir)))
    return fetch.fetch_summary(samples.event_log(spark, sf_dir), asked).drop("topic", "partition", "code", "log_start")


@query
def committed_offsets(spark, sf_dir):
    return offsets.committed_offsets(samples.event_commits(spark, sf_dir))


@query
def commit_lookup(spark, sf_dir):
    asked = table(spark, sf_dir, "customer").select(F.concat(F.lit("g"), F.col("c_custkey") % 9).alias("group"), F.lit("view").alias("topic"), (F.col("c_custkey") % 6).cast("int").alias("partition"), "c_custkey")
    return offsets.lookup_commits(asked, samples.event_commits(spark, sf_dir))


@query
def consumer_lag(spark, sf_dir):
    return offsets.consumer_lag(samples.line_commits(spark, sf_dir), samples.line_log(spark, sf_dir))


@query
def slow_consumers(spark, sf_dir):
    return offsets.slow_consumers(samples.line_commits(spark, sf_dir), samples.line_log(spark, sf_dir))


@query
def consumer_checks(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rows = e.select(F.col("user_id").alias("client"), F.col("event_id").alias("seq"), (F.col("event_id") % 700).alias("committed"), (F.col("event_id") % 11_000).alias("high_watermark"))
    return offsets.consumer_checks(rows)


@query
def segment_stats(spark, sf_dir):
    return log.segment_stats(samples.event_log(spark, sf_dir), created="ts")


@query
def log_start_offsets(spark, sf_dir):
    return log.partition_stats(samples.event_log(spark, sf_dir).where("segment_base > 0"))


@query
def offset_gaps(spark, sf_dir):
    return log.offset_gaps(log.segment_stats(samples.event_log(spark, sf_dir).where("segment_base % 300 <> 100")))


@query
def traffic(spark, sf_dir):
    return metrics.traffic(samples.document_log(spark, sf_dir))


@query
def index_build(spark, sf_dir):
    return sparse_index.build_index(samples.event_log(spark, sf_dir), BUILD_EVERY)


def _targets(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("event_type").alias("topic"), (F.col("user_id") % 4).cast("int").alias("partition"), (F.col("event_id") % 700 - 20).alias("target"))


@query
def index_floor_lookup(spark, sf_dir):
    index = sparse_index.build_index(samples.event_log(spark, sf_dir), BUILD_EVERY)
    return sparse_index.lookup_positions(_targets(spark, sf_dir), index)


@query
def segment_lookup(spark, sf_dir):
    stats = log.segment_stats(samples.event_log(spark, sf_dir).where("segment_base <> 100"))
    return sparse_index.containing_segments(_targets(spark, sf_dir), stats)


def _broken_index(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """A log and an index, both written down, of which segments 100 have nothing, 200 an odd file size and 300 an entry out of place."""
    rows = shared.save(samples.event_log(spark, sf_dir).select(*SEGMENT, "offset", "record_size"), "log")
    stats = log.segment_stats(rows)
    index = sparse_index.build_index(rows, BUILD_EVERY).where("segment_base <> 100")
    index = shared.save(index.withColumn("offset", F.when((F.col("segment_base") == 300) & (F.col("offset") == 325), F.lit(299)).otherwise(F.col("offset"))), "index")
    sizes = index.groupBy(*SEGMENT).agg(F.count(F.lit(1)).alias("n")).select(*SEGMENT, (F.col("n") * 16 + F.when(F.col("segment_base") == 200, 3).otherwise(0)).alias("file_bytes"))
    return rows, stats, index, sizes


@query
def index_corruption_status(spark, sf_dir):
    _, stats, index, sizes = _broken_index(spark, sf_dir)
    return sparse_index.index_health(stats, index, sizes)


@query
def index_rebuild(spark, sf_dir):
    rows, stats, index, sizes = _broken_index(spark, sf_dir)
    return sparse_index.rebuild_index(rows, stats, index, sizes, BUILD_EVERY)[0]


@query
def index_rebuild_report(spark, sf_dir):
    rows, stats, index, sizes = _broken_index(spark, sf_dir)
    return sparse_index.rebuild_index(rows, stats, index, sizes, BUILD_EVERY)[1]


def _segments(spark, sf_dir) -> DataFrame:
    return log.segment_stats(samples.event_log(spark, sf_dir), created="ts")


@query
def retention_time(spark, sf_dir):
    return retention.expired_by_time(_segments(spark, sf_dir), RETENTION_AGE_MS, RETENTION_NOW_MS, 250).select(*SEGMENT, "size_bytes")


@query
def retention_size(spark, sf_dir):
    return retention.expired_by_size(_segments(spark, sf_dir), RETAIN_BYTES, 350).select(*SEGMENT, "size_bytes")


@query
def retention_size_held(spark, sf_dir):
    return retention.expired_by_size(_segments(spark, sf_dir), RETAIN_BYTES, 250).select(*SEGMENT, "size_bytes")


@query
def retention_summary(spark, sf_dir):
    return retention.retention_summary(retention.expired_by_size(_segments(spark, sf_dir), RETAIN_BYTES, 350))


@query
def retained_log(spark, sf_dir):
    rows = samples.event_log(spark, sf_dir)
    gone = retention.expired_by_size(log.segment_stats(rows), RETAIN_BYTES, 350)
    return log.partition_stats(retention.without_segments(rows, gone))


@query
def retention_skip(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("partition"), (F.col("n_nationkey") * 10_000).cast("long").alias("last_retention_run_ms"))
    return retention.with_skip(n, 200_000, 60_000)


def _changes(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The key-value log, its segment stats, and those that may be compacted: above the checkpoint of partition 1, below 2000."""
    rows = samples.user_changes(spark, sf_dir)
    stats = log.segment_stats(rows)
    marks = spark.createDataFrame([("users", 1, CHECKPOINT), ("users", 2, None)], "topic string, partition int, last_compacted_offset long")
    return rows, stats, compaction.eligible_segments(stats, marks, 2000)


@query
def compaction_eligible(spark, sf_dir):
    return _changes(spark, sf_dir)[2].select(*SEGMENT, "max_offset")


@query
def compaction_latest(spark, sf_dir):
    out = compaction.latest_per_key(samples.user_changes(spark, sf_dir))
    return out.select(*PARTITION, F.col("key").cast("string").alias("key"), "offset", F.col("value").cast("string").alias("value"), "n_records")


@query
def compaction_tombstones(spark, sf_dir):
    out = compaction.latest_per_key(samples.user_changes(spark, sf_dir)).where("value is null")
    return out.select(*PARTITION, F.col("key").cast("string").alias("key"), "offset")


@query
def compaction_dropped(spark, sf_dir):
    rows, _, eligible = _changes(spark, sf_dir)
    return compaction.compaction_result(rows, eligible)


@query
def compacted_log(spark, sf_dir):
    rows, _, eligible = _changes(spark, sf_dir)
    out = compaction.compact(rows, eligible)
    return out.select(*SEGMENT, "offset", F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


@query
def checkpoint_advance(spark, sf_dir):
    rows, _, eligible = _changes(spark, sf_dir)
    old = spark.createDataFrame([("users", 0, 5), ("users", 1, CHECKPOINT), ("users", 3, 10_000_000), ("others", 0, 7)], "topic string, partition int, last_compacted_offset long")
    return compaction.advance_checkpoints(old, compaction.compaction_result(rows, eligible))


@query
def checkpoint_load(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    rows = n.select(F.col("n_nationkey").cast("long").alias("partition"), F.when(F.col("n_nationkey") % 3 > 0, F.col("n_nationkey") * 10 - 50).cast("long").alias("last_compacted_offset"), F.when(F.col("n_nationkey") % 5 > 0, F.col("n_nationkey") * 1000).cast("long").alias("last_retention_run_ms"))
    return compaction.sound_checkpoints(rows)


@query
def rate_limit(spark, sf_dir):
    return limits.rate_limit(samples.limit_requests(spark, sf_dir), RATE, RATE_WINDOW_MS).select("client", "seq", "bytes", "allowed")


@query
def inflight_limit(spark, sf_dir):
    return limits.inflight_limit(samples.limit_requests(spark, sf_dir)).select("client", "seq", "allowed")


@query
def throttle_counts(spark, sf_dir):
    return limits.throttle_counts(limits.rate_limit(samples.limit_requests(spark, sf_dir), RATE, RATE_WINDOW_MS))


@query
def latency_percentiles(spark, sf_dir):
    return metrics.latency_percentiles(samples.latency_samples(spark, sf_dir))


@query
def metric_counters(spark, sf_dir):
    return metrics.counters(samples.metric_events(spark, sf_dir))


@query
def metric_snapshot(spark, sf_dir):
    return metrics.counter_snapshot(samples.metric_events(spark, sf_dir))


@query
def lag_snapshot(spark, sf_dir):
    c = samples.event_commits(spark, sf_dir)
    return metrics.lag_snapshot(c.select("topic", "partition", "group", F.col("commit_seq").alias("seq"), (100 - F.col("offset")).alias("lag")))


@query
def prometheus_export(spark, sf_dir):
    kinds = {"view": "fetch", "click": "produce"}
    s = samples.latency_samples(spark, sf_dir).where(F.col("kind").isin(*kinds))
    s = s.withColumn("kind", F.when(F.col("kind") == "view", "fetch").otherwise("produce"))
    lags = offsets.consumer_lag(samples.event_commits(spark, sf_dir), samples.event_log(spark, sf_dir))
    return metrics.prometheus_lines(samples.metric_events(spark, sf_dir), s, lags)


def _catalog(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), (F.col("n_nationkey") % 4 + 1).cast("int").alias("partition_count"))


@query
def topics_list(spark, sf_dir):
    return catalog.list_topics(_catalog(spark, sf_dir))


@query
def topic_describe(spark, sf_dir):
    rows = samples.event_log(spark, sf_dir)
    return catalog.describe_topics(samples.topics_of(rows), rows)


@query
def partition_describe(spark, sf_dir):
    rows = samples.event_log(spark, sf_dir)
    topics = samples.topics_of(rows).unionByName(_catalog(spark, sf_dir))
    return catalog.describe_partitions(topics, log.segment_stats(rows))


@query
def partition_checks(spark, sf_dir):
    asked = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("request_id"), F.when(F.col("s_suppkey") % 3 > 0, "NATION_6").otherwise("ATLANTIS").alias("topic"), (F.col("s_suppkey") % 6).cast("int").alias("partition"))
    return catalog.check_partitions(asked, _catalog(spark, sf_dir))


def _asked_topics(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("seq"), F.concat(F.lit("topic"), F.col("c_custkey") % 90).alias("name"), (F.col("c_custkey") % 5).cast("int").alias("partition_count"))


def _existing_topics(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.concat(F.lit("topic"), "n_nationkey").alias("name"), F.lit(1).alias("partition_count"))


@query
def create_topic_conflicts(spark, sf_dir):
    """Every customer is a request."""
    return catalog.check_new_topics(_asked_topics(spark, sf_dir), _existing_topics(spark, sf_dir))


@query
def create_topic_conflicts_all(spark, sf_dir):
    """As create_topic_conflicts, under the name that it had for all customers before."""
    return create_topic_conflicts(spark, sf_dir)


@query
def record_encode(spark, sf_dir):
    rows = samples.event_log(spark, sf_dir)
    return rows.select("event_id", F.lower(F.hex(binary.encode_record(F.col("offset"), F.col("payload")))).alias("record"))


@query
def record_decode(spark, sf_dir):
    return _text(segment_files.decode_segments(segment_files.encode_segments(samples.event_log(spark, sf_dir))))


@query
def index_decode(spark, sf_dir):
    index = sparse_index.build_index(samples.event_log(spark, sf_dir), BUILD_EVERY)
    entry = F.concat(binary.big_endian(F.col("offset"), 8), binary.big_endian(F.col("position"), 8))
    files = index.groupBy(*SEGMENT).agg(F.array_sort(F.collect_list(F.struct("offset", entry.alias("e")))).alias("rows"))
    return segment_files.decode_index(files.select(*SEGMENT, F.aggregate("rows", F.lit(b""), lambda out, x: F.concat(out, x["e"])).alias("content")))


@query
def key_value_codec(spark, sf_dir):
    rows = samples.user_changes(spark, sf_dir)
    rows = rows.select("ingest_seq", binary.encode_key_value(F.col("key"), F.col("value")).alias("payload"))
    kv = binary.decode_key_value(F.col("payload"))
    return rows.select("ingest_seq", F.octet_length("payload").alias("n_bytes"), kv["key"].cast("string").alias("key"), kv["value"].cast("string").alias("value"), binary.segment_file_name(F.col("ingest_seq")).alias("file"))


def _requests(spark, sf_dir) -> DataFrame:
    verbs = F.array(*map(F.lit, sorted(frames.TAGS)))
    c = table(spark, sf_dir, "conversations")
    body = F.encode("text", "UTF-8")
    rows = c.select("conv_id", "turn", "role", F.get(verbs, ((F.col("conv_id") + F.col("turn")) % len(frames.TAGS)).cast("int")).alias("verb"), F.concat(F.lit("g"), F.col("conv_id") % 7).alias("group"), F.col("role").alias("topic"), (F.col("conv_id") % 4).alias("partition"), (F.col("conv_id") * 4_000_000_000).alias("offset"), F.lit(1 << 20).cast("long").alias("max_bytes"), (F.col("turn") + 1).alias("partition_count"), F.array(body, F.encode("role", "UTF-8")).alias("records"))
    return rows.withColumn("frame", frames.encode_request(F.col("verb")))


@query
def request_decode(spark, sf_dir):
    back = frames.decode_requests(_requests(spark, sf_dir).select("conv_id", "turn", "frame"))
    return back.select("conv_id", "turn", "verb", "group", "topic", "partition", "offset", "max_bytes", "partition_count", F.coalesce(F.size("records"), F.lit(-1)).alias("n_records"), F.get("records", F.lit(0)).cast("string").alias("first_record"), "error")


@query
def request_decode_errors(spark, sf_dir):
    cut = _requests(spark, sf_dir).select("conv_id", "turn", F.substring("frame", F.lit(1), F.octet_length("frame") - 1).alias("frame"))
    return frames.decode_requests(cut).select("conv_id", "turn", "error", "code")


@query
def fetch_response_codec(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    lists = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.encode("text", "UTF-8").alias("b")))).alias("rows"))
    sent = lists.select("conv_id", frames.encode_fetch_response(F.transform("rows", lambda r: r["b"]), F.col("conv_id") * 7).alias("frame"))
    return frames.decode_responses(sent).select("conv_id", "kind", "record_count", "next_offset", F.sha2(F.array_join(F.transform("records", lambda r: r.cast("string")), "|"), 256).alias("texts_sha256"))


def _written_log(spark, sf_dir) -> str:
    at = shared.shared_path(spark, "stream")
    samples.event_log(spark, sf_dir).select("topic", "partition", "offset", "payload", "event_id").repartition(8).write.parquet(at)
    return at


@query
def stream_consume(spark, sf_dir):
    """A stream over the log, read to its end in micro-batches; its rows are the log's."""
    out, at = shared.shared_path(spark, "consumed"), _written_log(spark, sf_dir)
    stream = consume.stream_log(spark, at, "topic string, partition int, offset long, payload binary, event_id long", max_files=3)

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    consume.consume(stream, "readers", shared.shared_path(spark, "position"), keep).awaitTermination()
    return _text(spark.read.schema("topic string, partition int, offset long, payload binary").parquet(out))


@query
def stream_rate_limit(spark, sf_dir):
    """The rate limiter with state per client on a stream; its answers are the batch's."""
    at, out = shared.shared_path(spark, "requests"), shared.shared_path(spark, "limited")
    samples.limit_requests(spark, sf_dir).coalesce(1).write.parquet(at)
    stream = spark.readStream.schema("client long, seq long, t_ms long, bytes long, duration_ms long").parquet(at)
    limited = consume.stream_rate_limit(stream, RATE, RATE_WINDOW_MS)
    writer = limited.writeStream.format("parquet").option("path", out).option("checkpointLocation", shared.shared_path(spark, "position")).trigger(availableNow=True)
    writer.start().awaitTermination()
    return spark.read.schema("client long, seq long, allowed boolean").parquet(out)
