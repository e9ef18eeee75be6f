"""Counters, latency percentiles over a ring of samples, lag snapshots and the text export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed value: samples in a ring.
RING = 1024
#: The counters and the gauge, and their help texts.
COUNTERS = {
    "messages_produced_total": "Total number of messages produced",
    "messages_fetched_total": "Total number of messages fetched",
    "bytes_in_total": "Total bytes received (produced)",
    "bytes_out_total": "Total bytes sent (fetched)",
    "active_connections": "Current number of active TCP connections",
    "throttled_consumers_total": "Total number of consumer throttle events",
    "slow_consumers_total": "Total number of slow consumer detections",
    "segments_deleted_total": "Total number of segments deleted by retention",
    "bytes_reclaimed_total": "Total bytes reclaimed by retention and compaction",
    "compaction_runs_total": "Total number of log compaction runs",
    "compaction_skipped_segments_total": "Total number of segments skipped during compaction",
    "retention_noop_runs_total": "Total number of retention runs that deleted no segments",
    "checkpoint_corruption_total": "Total number of corrupted checkpoint files recovered",
    "compaction_segments_rewritten_total": "Total number of segments rewritten during compaction",
    "compaction_records_dropped_total": "Total number of records dropped during compaction",
    "compaction_bytes_rewritten_total": "Total bytes rewritten during compaction",
    "index_rebuilds_total": "Total number of index rebuilds",
    "index_corruptions_detected_total": "Total number of index corruptions detected",
    "index_entries_rebuilt_total": "Total number of index entries rebuilt",
}
GAUGES = {"active_connections"}
LATENCIES = {"fetch": "Fetch", "produce": "Produce"}


def counters(events: DataFrame) -> DataFrame:
    """(name, kind, value) of every known metric, zeros included, from events (name, delta); unknown names and null deltas count for nothing."""
    spark = events.sparkSession
    known = spark.createDataFrame([(n, "gauge" if n in GAUGES else "counter") for n in COUNTERS], "name string, kind string")
    sums = events.groupBy("name").agg(F.sum("delta").alias("value"))
    return F.broadcast(known).join(sums, "name", "left").select("name", "kind", F.coalesce("value", F.lit(0)).cast("long").alias("value"))


def counter_snapshot(events: DataFrame) -> DataFrame:
    """One row with a column per metric."""
    value = lambda n: F.coalesce(F.sum(F.when(F.col("name") == n, F.col("delta"))), F.lit(0)).cast("long").alias(n)
    return events.agg(*[value(n) for n in COUNTERS])


def latency_percentiles(samples: DataFrame, ring: int = RING) -> DataFrame:
    """p50, p95 and p99 of each kind over its last ``ring`` samples by seq, and how many count.

    Zeros take a place in the ring but aren't counted; the rank is the floor of
    n * p / 100, one at least; a kind with nothing else has zeros. The ring is a
    limit per group, so each task hands on at most that many rows of a kind.
    """
    newest = Window.partitionBy("kind").orderBy(F.desc("seq"))
    held = samples.withColumn("_nth", F.row_number().over(newest)).where(F.col("_nth") <= ring)
    lists = held.groupBy("kind").agg(F.sort_array(F.collect_list(F.when(F.col("nanos") > 0, F.col("nanos")))).alias("v"))
    rank = lambda p: F.coalesce(F.when(F.size("v") > 0, F.element_at("v", F.greatest((F.size("v") * p / 100).cast("int"), F.lit(1)))), F.lit(0).cast("long"))
    return lists.select("kind", F.size("v").cast("long").alias("n"), *[rank(p).alias(f"p{p}") for p in (50, 95, 99)])


def lag_snapshot(updates: DataFrame) -> DataFrame:
    """The last lag by seq of each topic, partition and group."""
    return updates.groupBy("topic", "partition", "group").agg(F.max_by("lag", "seq").alias("lag"))


def prometheus_lines(events: DataFrame, samples: DataFrame, lags: DataFrame) -> DataFrame:
    """(section, line): the text export, one row per metric or lag entry, in order of section and line.

    lags: topic, partition, group, lag. Lag entries grow with the consumers, so the
    export is rows, to be written as text, and never one string.
    """
    spark = events.sparkSession
    at = list(COUNTERS)
    info = spark.createDataFrame([(i, n, COUNTERS[n], "gauge" if n in GAUGES else "counter") for i, n in enumerate(at)], "section int, name string, help string, type string")
    values = counters(events).select("name", "value")
    rank = ["p50", "p95", "p99"]
    word = {"p50": "50th", "p95": "95th", "p99": "99th"}
    quantiles = [(len(at) + 3 * i + j, k, f"{k}_latency_ns_{p}", f"{title} latency {word[p]} percentile (ns)", "gauge", p) for i, (k, title) in enumerate(LATENCIES.items()) for j, p in enumerate(rank)]
    parts = latency_percentiles(samples).selectExpr("kind", "stack(3, 'p50', p50, 'p95', p95, 'p99', p99) as (p, value)")
    more = spark.createDataFrame(quantiles, "section int, kind string, name string, help string, type string, p string").join(parts, ["kind", "p"], "left")
    rows = info.join(values, "name").select("section", "name", "help", "type", "value").unionByName(more.select("section", "name", "help", "type", F.coalesce("value", F.lit(0).cast("long")).alias("value")))
    body = F.format_string("# HELP %s %s\n# TYPE %s %s\n%s %d", "name", "help", "name", "type", "name", "value")
    last = len(at) + len(quantiles)
    head = spark.createDataFrame([(last, "# HELP consumer_lag Consumer lag per partition and group\n# TYPE consumer_lag gauge")], "section int, line string")
    entry = F.format_string('consumer_lag{topic="%s",partition="%d",group="%s"} %d', "topic", "partition", "group", "lag")
    return rows.select("section", body.alias("line")).unionByName(head).unionByName(lags.select(F.lit(last + 1).alias("section"), entry.alias("line")))


def traffic(log: DataFrame) -> DataFrame:
    """Messages and payload bytes of each topic and partition."""
    return log.groupBy("topic", "partition").agg(F.count(F.lit(1)).alias("messages"), F.sum(F.octet_length("payload").cast("long")).alias("bytes"))


def ping(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.lit("pong").alias("reply"))
