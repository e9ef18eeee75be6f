"""Consumer groups: committed offsets, lag and slow consumers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.binary import saturating_minus
from .log import PARTITION, partition_stats

#: Fixed value: a consumer is slow beyond this lag.
SLOW_LAG = 10_000


def committed_offsets(commits: DataFrame) -> DataFrame:
    """The last commit of each group, topic and partition by commit_seq: the last write wins, also when it goes back."""
    return commits.groupBy("group", *PARTITION).agg(F.max_by("offset", "commit_seq").alias("offset"))


def lookup_commits(requests: DataFrame, commits: DataFrame) -> DataFrame:
    """Adds committed (null if there is none) to rows of group, topic and partition."""
    return requests.join(committed_offsets(commits).withColumnRenamed("offset", "committed"), ["group", *PARTITION], "left")


def consumer_lag(commits: DataFrame, log: DataFrame, threshold: int = SLOW_LAG) -> DataFrame:
    """committed, high_watermark, lag (never below 0) and slow (lag above the threshold) of each group and partition. log: records or segment stats."""
    marks = partition_stats(log).select(*PARTITION, F.col("next_offset").alias("high_watermark"))
    out = committed_offsets(commits).withColumnRenamed("offset", "committed").join(marks, PARTITION, "left")
    out = out.withColumn("high_watermark", F.coalesce("high_watermark", F.lit(0).cast("long")))
    lag = saturating_minus(F.col("high_watermark"), F.col("committed"))
    return out.select("group", *PARTITION, "committed", "high_watermark", lag.alias("lag"), (lag > threshold).alias("slow"))


def slow_consumers(commits: DataFrame, log: DataFrame, threshold: int = SLOW_LAG) -> DataFrame:
    return consumer_lag(commits, log, threshold).where("slow").drop("slow")


def consumer_checks(checks: DataFrame, threshold: int = SLOW_LAG) -> DataFrame:
    """Per client of a history of checks (client, seq, committed, high_watermark): how many, how many slow, and the last one's answer."""
    slow = saturating_minus(F.col("high_watermark"), F.col("committed")) > threshold
    return checks.groupBy("client").agg(F.count(F.lit(1)).alias("n_checks"), F.count_if(slow).alias("n_slow"), F.max_by(slow, "seq").alias("slow_now"))
