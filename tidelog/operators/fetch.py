"""Byte-budgeted reads from an offset, or from a group's committed position, for many requests at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .log import PARTITION, SEGMENT, partition_stats, segment_stats

#: Requests are broadcast up to so many rows (some 10 MB); more are joined by a shuffle.
BROADCAST_REQUESTS = 100_000


def resolve_requests(requests: DataFrame, committed: DataFrame) -> DataFrame:
    """Adds start: the committed offset for a request with a group (null if there is none), else the request's offset."""
    known = committed.select("group", *PARTITION, F.col("offset").alias("_committed"))
    out = requests.join(known, ["group", *PARTITION], "left")
    grouped = F.coalesce(F.col("group"), F.lit("")) != ""
    return out.withColumn("start", F.when(grouped, F.col("_committed")).otherwise(F.col("offset"))).drop("_committed")


def _with_status(requests: DataFrame, segments: DataFrame, catalog: DataFrame | None) -> DataFrame:
    """Adds log_start, log_end, status and code. A group without a commit is empty, whether or not the partition exists."""
    stats = partition_stats(segments).select(*PARTITION, "log_start", F.col("next_offset").alias("log_end"))
    out = requests.join(stats, PARTITION, "left")
    if catalog is not None:
        out = out.join(catalog.select(F.col("name").alias("topic"), "partition_count"), "topic", "left")
        exists = F.coalesce((F.col("partition") >= 0) & (F.col("partition") < F.col("partition_count")), F.lit(False))
        out = out.withColumn("_exists", exists).drop("partition_count")
    else:
        out = out.withColumn("_exists", F.col("log_start").isNotNull())
    status = F.when(F.col("start").isNull(), "no_commit").when(~F.col("_exists"), "unknown_partition").when(F.col("start") < F.col("log_start"), "out_of_range").when(F.coalesce(F.col("start") >= F.col("log_end"), F.lit(True)), "at_end").otherwise("ok")
    return out.withColumn("status", status).withColumn("code", F.when(status == "unknown_partition", 10).cast("int")).drop("_exists")


def fetch_records(log: DataFrame, requests: DataFrame, segments: DataFrame | None = None, catalog: DataFrame | None = None) -> DataFrame:
    """The records of each request: request_id and the log's columns.

    A request (request_id, topic, partition, start, max_bytes) gets the longest run
    of records from start on whose sizes sum to at most max_bytes; its first record
    comes always, unless max_bytes is 0. Offsets without records are skipped. Starts
    below the log's start or beyond its end, and unknown partitions, get none.

    Segments that lie wholly beyond the budget are left out by their stats before
    the log is read, so what is joined and sorted for a request is at most its
    budget, a segment at either end, and never a whole partition. log needs
    segment_base and record_size; segments defaults to its stats.
    """
    segments = segment_stats(log) if segments is None else segments
    asked = _with_status(requests, segments, catalog).where("status = 'ok' and max_bytes > 0").select("request_id", *PARTITION, "start", "max_bytes")
    asked = F.broadcast(asked) if requests.limit(BROADCAST_REQUESTS + 1).count() <= BROADCAST_REQUESTS else asked
    # What whole segments hold between the first one and this one: a lower bound of what is read before it.
    sizes = segments.select(*SEGMENT, "max_offset", "size_bytes")
    reach = asked.join(sizes, PARTITION).where("max_offset >= start")
    in_order = Window.partitionBy("request_id").orderBy("segment_base")
    before = F.sum("size_bytes").over(in_order.rowsBetween(Window.unboundedPreceding, -1)) - F.first("size_bytes").over(in_order)
    reach = reach.withColumn("_before", F.coalesce(before, F.lit(0))).where("_before <= max_bytes").select("request_id", *SEGMENT, "start", "max_bytes")
    # The budget is worked out on sizes alone; payloads join what is kept.
    sized = log.select(*SEGMENT, "offset", "record_size").join(reach, SEGMENT).where(F.col("offset") >= F.col("start"))
    w = Window.partitionBy("request_id").orderBy("offset")
    kept = sized.withColumn("_nth", F.row_number().over(w)).withColumn("_sum", F.sum("record_size").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    kept = kept.where((F.col("_nth") == 1) | (F.col("_sum") <= F.col("max_bytes"))).select("request_id", *SEGMENT, "offset")
    return log.join(kept, [*SEGMENT, "offset"]).select("request_id", *[c for c in log.columns if c != "request_id"])


def fetch_summary(log: DataFrame, requests: DataFrame, segments: DataFrame | None = None, catalog: DataFrame | None = None) -> DataFrame:
    """One row per request: status, code, n_records, n_bytes, next_offset and log_start.

    next_offset is the last record's offset + 1, else start; 0 for a group without a commit.
    """
    segments = segment_stats(log) if segments is None else segments
    got = fetch_records(log, requests, segments, catalog).groupBy("request_id").agg(F.count(F.lit(1)).alias("n_records"), F.sum("record_size").alias("n_bytes"), F.max("offset").alias("_last"))
    out = _with_status(requests, segments, catalog).join(got, "request_id", "left")
    zero = F.lit(0).cast("long")
    return out.select("request_id", *PARTITION, "start", "status", "code", F.coalesce("n_records", zero).alias("n_records"), F.coalesce("n_bytes", zero).alias("n_bytes"), F.coalesce(F.col("_last") + 1, F.col("start"), zero).alias("next_offset"), "log_start")


def fetch_all_partitions(log: DataFrame, start: int, max_bytes: int, segments: DataFrame | None = None) -> DataFrame:
    """The same read of every partition of a log; request_id is topic/partition."""
    segments = segment_stats(log) if segments is None else segments
    each = segments.select(*PARTITION).distinct()
    asked = each.select(F.concat_ws("/", "topic", "partition").alias("request_id"), *PARTITION, F.lit(start).cast("long").alias("start"), F.lit(max_bytes).cast("long").alias("max_bytes"))
    return fetch_records(log, asked, segments)
