"""Running sums, numbering and floor lookups that no single key can turn into one task.

A window over a whole log partition sorts that partition in one task. Here rows are
also split into blocks by an expression that follows the order (offset ranges, days),
so a window covers one block; what comes before a block is a window over the blocks'
totals, one small row each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Records of a log partition in a block; a block is sorted by one task.
BLOCK = 1_000_000


def offset_block(offset: str = "offset", size: int = BLOCK) -> Column:
    return F.floor(F.col(offset) / F.lit(size)).cast("long")


def running(rows: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, value: str | None = None, position: str = "nth", before: str = "before") -> DataFrame:
    """Adds position (rows before this one within keys) and, with a value column, before (their sum).

    block must not decrease along the order. Rows and block totals are both dealt
    by keys and block, so the rows are shuffled once.
    """
    rows = rows.withColumn("_block", block)
    at = [*keys, "_block"]
    measure = F.col(value) if value else F.lit(0)
    totals = rows.groupBy(*at).agg(F.count(F.lit(1)).alias("_n"), F.sum(measure).alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*at, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_sum0"))
    inside = Window.partitionBy(*at).orderBy(*order)
    rows = rows.withColumn("_nth", F.row_number().over(inside))
    if value:
        rows = rows.withColumn("_in", F.sum(measure).over(inside.rowsBetween(Window.unboundedPreceding, 0)) - measure)
    out = rows.join(totals, at).withColumn(position, (F.col("_nth") - 1 + F.col("_n0")).cast("long"))
    if value:
        out = out.withColumn(before, (F.col("_in") + F.col("_sum0")).cast("long"))
    return out.drop("_block", "_nth", "_in", "_n0", "_sum0")


def floor_lookup(targets: DataFrame, entries: DataFrame, keys: Sequence[str], target: str, entry: str, value: str, size: int = BLOCK) -> DataFrame:
    """Adds to each target the value of the greatest entry not above it (null if there is none).

    Both sides are stacked and sorted by block of ``size``; the last entry of
    earlier blocks comes from a window over one row per block.
    """
    named = {c: f"_t{i}" for i, c in enumerate(targets.columns)}
    left = targets.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], F.col(target).alias("_at"), F.lit(1).alias("_is_target"), F.struct(*[F.col(c).alias(named[c]) for c in targets.columns]).alias("_row"), F.lit(None).cast(entries.schema[value].dataType).alias("_value"))
    right = entries.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], F.col(entry).alias("_at"), F.lit(0).alias("_is_target"), F.lit(None).cast(left.schema["_row"].dataType).alias("_row"), F.col(value).alias("_value"))
    both = left.unionByName(right).withColumn("_block", F.floor(F.col("_at") / F.lit(size)))
    own = [f"_k{i}" for i in range(len(keys))]
    last = both.where("_is_target = 0").groupBy(*own, "_block").agg(F.max_by("_value", "_at").alias("_end"))
    blocks = both.select(*own, "_block").distinct().join(last, [*own, "_block"], "left")
    earlier = Window.partitionBy(*own).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*own, "_block", F.last("_end", ignorenulls=True).over(earlier).alias("_carried"))
    inside = Window.partitionBy(*own, "_block").orderBy("_at", "_is_target").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_found", F.last("_value", ignorenulls=True).over(inside)).where("_is_target = 1").join(blocks, [*own, "_block"], "left")
    return found.select(*[F.col("_row")[named[c]].alias(c) for c in targets.columns], F.coalesce("_found", "_carried").alias(value))
