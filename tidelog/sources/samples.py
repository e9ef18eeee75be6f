"""Logs, commits, key-value logs and requests made from the star-schema, event, text and chat tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.binary import record_size
from ..operators.log import assign_offsets, with_segments


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _day(column: str) -> Column:
    return F.unix_date(F.to_date(column))


def _ms(column: str) -> Column:
    return F.unix_millis(F.col(column).cast("timestamp"))


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """topic: event_type, partition: user_id mod 4, in order of time; segments of 100."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("topic"), (F.col("user_id") % 4).cast("int").alias("partition"), F.encode("props", "UTF-8").alias("payload"), "ts", "event_id")
    log = assign_offsets(e.withColumn("record_size", record_size(F.col("payload"))), ["ts", "event_id"], block=_day("ts"))
    return with_segments(log)


def document_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """topic: lang, partition: doc_id mod 4, in order of doc_id; segments of 100."""
    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("topic"), (F.col("doc_id") % 4).cast("int").alias("partition"), F.encode("text", "UTF-8").alias("payload"), "doc_id")
    log = assign_offsets(d.withColumn("record_size", record_size(F.col("payload"))), ["doc_id"], block=F.floor(F.col("doc_id") / 100_000))
    return with_segments(log)


#: An order of lineitem without ties.
LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]


def line_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """topic: l_returnflag, one partition each; the payload is the comma-joined keys; segments of 1000."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("topic"), F.lit(0).alias("partition"), F.encode(F.concat_ws(",", "l_orderkey", "l_linenumber", "l_partkey"), "UTF-8").alias("payload"), *LINE_ORDER)
    log = assign_offsets(items.withColumn("record_size", record_size(F.col("payload"))), LINE_ORDER, block=F.floor(F.col("l_orderkey") / 10_000))
    return with_segments(log, every=1000)


def event_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits of five groups; they go back often."""
    e = table(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("g"), F.col("user_id") % 5).alias("group"), F.col("event_type").alias("topic"), (F.col("user_id") % 4).cast("int").alias("partition"), (F.col("event_id") % 50).alias("offset"), F.col("event_id").alias("commit_seq"))


def line_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = line_log(spark, sf_dir)
    return log.select(F.concat(F.lit("g"), F.col("l_suppkey") % 5).alias("group"), "topic", "partition", (F.col("l_orderkey") % (11_000 + 1000 * (F.col("l_suppkey") % 5))).alias("offset"), F.col("offset").alias("commit_seq"))


def user_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key-value log: key user_id, value props, a tombstone for errors; segments of 100."""
    e = table(spark, sf_dir, "events").select(F.lit("users").alias("topic"), (F.col("user_id") % 4).cast("int").alias("partition"), F.encode(F.col("user_id").cast("string"), "UTF-8").alias("key"), F.when(F.col("event_type") != "error", F.encode("props", "UTF-8")).alias("value"), F.col("event_id").alias("ingest_seq"))
    log = assign_offsets(e, ["ingest_seq"], block=F.floor(F.col("ingest_seq") / 100_000))
    sizes = F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0)) + 20
    return with_segments(log.withColumn("record_size", sizes.cast("long")))


def limit_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    size = F.floor("value").cast("long")
    return e.select(F.col("user_id").alias("client"), F.col("event_id").alias("seq"), _ms("ts").alias("t_ms"), size.alias("bytes"), (size * 600_000).alias("duration_ms"))


def latency_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("kind"), F.col("event_id").alias("seq"), F.floor("value").cast("long").alias("nanos"))


#: Which counter the events of a type add to in the sample metrics.
EVENT_COUNTERS = {"click": "messages_fetched_total", "purchase": "bytes_in_total", "signup": "messages_produced_total", "view": "bytes_out_total", "error": "throttled_consumers_total"}


def metric_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    names = F.create_map(*[F.lit(x) for pair in EVENT_COUNTERS.items() for x in pair])
    return e.select(names[F.col("event_type")].alias("name"), F.floor("value").cast("long").alias("delta"))


def topics_of(log: DataFrame) -> DataFrame:
    """A catalog with four partitions for each topic of a log."""
    return log.select(F.col("topic").alias("name")).distinct().withColumn("partition_count", F.lit(4))
