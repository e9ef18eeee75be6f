"""The catalog of topics: creating, listing and describing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .log import partition_stats

#: Error codes of the catalog, the log and frames.
CODES = {"frame": 1, "decode": 2, "storage": 4, "commit": 5, "unknown_partition": 10, "duplicate_topic": 11, "partition_count": 12, "describe_topic": 13, "describe_partition": 14, "internal": 500}


def check_new_topics(requests: DataFrame, topics: DataFrame) -> DataFrame:
    """Adds code (null: created) to requests (seq, name, partition_count): 12 without partitions, 11 for a name that is there or came before."""
    valid = F.coalesce(F.col("partition_count"), F.lit(0)) > 0
    first = F.min(F.when(valid, F.col("seq"))).over(Window.partitionBy("name"))
    out = requests.join(topics.select("name", F.lit(True).alias("_known")), "name", "left").withColumn("_first", first)
    code = F.when(~valid, CODES["partition_count"]).when(F.col("_known") | (F.col("seq") > F.col("_first")), CODES["duplicate_topic"])
    return out.select(*requests.columns, code.cast("int").alias("code"))


def create_topics(requests: DataFrame, topics: DataFrame) -> DataFrame:
    """The catalog with the requests that may be carried out."""
    return topics.select("name", "partition_count").unionByName(check_new_topics(requests, topics).where("code is null").select("name", "partition_count"))


def list_topics(topics: DataFrame) -> DataFrame:
    return topics.select("name", "partition_count").orderBy("name")


def topic_partitions(topics: DataFrame) -> DataFrame:
    """One row per topic and partition, from 0 on."""
    return topics.where("partition_count > 0").select(F.col("name").alias("topic"), "partition_count", F.explode(F.sequence(F.lit(0), F.col("partition_count") - 1)).alias("partition"))


def describe_partitions(topics: DataFrame, log: DataFrame) -> DataFrame:
    """Each partition with log_start, high_watermark, record_count and size_bytes; zeros for one without records. log: records or segment stats."""
    stats = partition_stats(log)
    out = topic_partitions(topics).join(stats, ["topic", "partition"], "left")
    zero = F.lit(0).cast("long")
    return out.select("topic", "partition", F.coalesce("log_start", zero).alias("log_start"), F.coalesce("next_offset", zero).alias("high_watermark"), F.coalesce("record_count", zero).alias("record_count"), F.coalesce("size_bytes", zero).alias("size_bytes"))


def describe_topics(topics: DataFrame, log: DataFrame) -> DataFrame:
    """Each topic with partition_count, high_watermark (of all its partitions), record_count and size_bytes."""
    per = describe_partitions(topics, log).groupBy("topic").agg(F.count(F.lit(1)).cast("int").alias("partition_count"), F.sum("high_watermark").alias("high_watermark"), F.sum("record_count").alias("record_count"), F.sum("size_bytes").alias("size_bytes"))
    return per


def check_partitions(requests: DataFrame, topics: DataFrame, code: int = CODES["describe_partition"]) -> DataFrame:
    """Adds code to requests (topic, partition): null where the catalog has that partition."""
    out = requests.join(topics.select(F.col("name").alias("topic"), F.col("partition_count").alias("_n")), "topic", "left")
    exists = F.coalesce((F.col("partition") >= 0) & (F.col("partition") < F.col("_n")), F.lit(False))
    return out.select(*requests.columns, F.when(~exists, code).cast("int").alias("code"))
