"""The sparse offset index of segments: building, floor lookup, health and rebuilding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import save
from .log import PARTITION, SEGMENT
from .prefix import floor_lookup

#: Every so many records has an entry; bytes of an entry in a file.
EVERY, ENTRY = 100, 16


def build_index(log: DataFrame, every: int = EVERY) -> DataFrame:
    """(topic, partition, segment_base, offset, position): the byte position in its segment of each segment's first record and of every ``every``-th after it.

    A window covers one segment, and segments have a bounded size.
    """
    w = Window.partitionBy(*SEGMENT).orderBy("offset")
    placed = log.select(*SEGMENT, "offset", "record_size").withColumn("_nth", F.row_number().over(w) - 1)
    placed = placed.withColumn("position", F.sum("record_size").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("record_size"))
    return placed.where(F.col("_nth") % every == 0).select(*SEGMENT, "offset", "position")


def lookup_positions(targets: DataFrame, index: DataFrame, keys: list[str] = PARTITION, target: str = "target") -> DataFrame:
    """Adds position to each target: that of the greatest entry not above it; null below the first entry or without entries."""
    return floor_lookup(targets, index, keys, target, "offset", "position")


def containing_segments(targets: DataFrame, segments: DataFrame, target: str = "target") -> DataFrame:
    """Adds segment_base: the segment with the target between its base and its last offset, else null."""
    bounds = segments.select(*PARTITION, "segment_base", F.struct("segment_base", "max_offset").alias("_segment"))
    found = floor_lookup(targets, bounds, PARTITION, target, "segment_base", "_segment")
    return found.withColumn("segment_base", F.when(F.col(target) <= F.col("_segment.max_offset"), F.col("_segment.segment_base"))).drop("_segment")


def index_health(segments: DataFrame, index: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """status and detail of each segment's index: missing, invalid_size, invalid_entries or healthy.

    sizes has the length of each index file (file_bytes), where there are files:
    one that isn't a multiple of 16 is of invalid size. Entries must lie in the
    segment, from its base on, and rise in offset and position.
    """
    w = Window.partitionBy(*SEGMENT).orderBy("position", "offset")
    base = segments.select(*SEGMENT, "max_offset", "size_bytes")
    entries = index.join(base, SEGMENT).withColumn("_prior", F.lag("offset").over(w)).withColumn("_at", F.lag("position").over(w))
    wrong = (F.col("offset") < F.col("segment_base")) | (F.col("offset") > F.col("max_offset")) | (F.col("position") >= F.col("size_bytes")) | (F.col("_prior") >= F.col("offset")) | (F.col("_at") >= F.col("position"))
    per = entries.groupBy(*SEGMENT).agg(F.count(F.lit(1)).alias("n_entries"), F.count_if(F.coalesce(wrong, F.lit(False))).alias("n_wrong"))
    out = base.join(per, SEGMENT, "left")
    out = out.join(sizes.select(*SEGMENT, "file_bytes"), SEGMENT, "left") if sizes is not None else out.withColumn("file_bytes", F.col("n_entries") * ENTRY)
    status = F.when(F.col("file_bytes").isNull(), "missing").when(F.col("file_bytes") % ENTRY != 0, "invalid_size").when(F.col("n_wrong") > 0, "invalid_entries").otherwise("healthy")
    detail = F.when(status == "invalid_size", F.col("file_bytes")).when(status == "invalid_entries", F.col("n_wrong"))
    return out.select(*SEGMENT, F.coalesce("n_entries", F.lit(0).cast("long")).alias("n_entries"), status.alias("status"), detail.cast("long").alias("detail"))


def rebuild_index(log: DataFrame, segments: DataFrame, index: DataFrame, sizes: DataFrame | None = None, every: int = EVERY) -> tuple[DataFrame, DataFrame]:
    """(index, report): unhealthy segments' entries are built anew from the log, others stay; report has entries, scanned and was_missing of each rebuilt one.

    The list of unhealthy segments is written down first. So Spark knows its size:
    a short one is broadcast, and the log's other records are neither shuffled nor sorted.
    """
    health = index_health(segments, index, sizes)
    broken = save(health.where("status <> 'healthy'").select(*SEGMENT, (F.col("status") == "missing").alias("was_missing")), "broken")
    scanned = log.select(*SEGMENT, "offset", "record_size").join(broken.select(*SEGMENT), SEGMENT, "left_semi")
    fresh = build_index(scanned, every)
    kept = index.join(broken.select(*SEGMENT), SEGMENT, "left_anti")
    entries = fresh.groupBy(*SEGMENT).agg(F.count(F.lit(1)).alias("entries"))
    counts = scanned.groupBy(*SEGMENT).agg(F.count(F.lit(1)).alias("scanned"))
    return kept.select(*SEGMENT, "offset", "position").unionByName(fresh), broken.join(counts, SEGMENT).join(entries, SEGMENT)
