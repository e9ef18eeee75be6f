"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, save_at, small


def _settled(edges: DataFrame) -> bool:
    """Whether every node points to one that points nowhere."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return ends.where("up > 1 or up = 1 and down = 1").count() == 0


def connected_components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60, rows: int | None = None) -> DataFrame:
    """(node, component) for every node of the links; component is the smallest node that can be reached.

    Each star step points a node's neighbours to the least of them, so the links
    of a component shrink to one star in a logarithmic number of rounds. Every
    round is two shuffles of at most as many rows as there are links, with
    partial minima before them; the rounds' tables are in the shared folder, and
    only a count comes to the driver. Links with a null end
    and links of a node with itself are ignored. rows: how many links there are, if
    that is known.
    """
    spark = links.sparkSession
    x, y = F.col(a), F.col(b)
    edges = links.where(x.isNotNull() & y.isNotNull() & (x != y)).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct()
    edges, path = save_at(edges, "links", rows)
    for _ in range(rounds):
        if _settled(edges):
            break
        rows = edges.count()
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least, least_at = save_at(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least", rows)
        near = small(least)
        large = both.where("v > u").join(near, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large, large_at = save_at(large.unionByName(edges.join(near, "u").where("m < u").select("u", F.col("m").alias("v"))).distinct(), "large", rows)
        low, low_at = save_at(large.groupBy("u").agg(F.min("v").alias("m")), "low", rows)
        ends = large.join(small(low), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges, new = save_at(ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "links", rows)
        for old in (path, least_at, large_at, low_at):
            drop_table(spark, old)
        path = new
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
