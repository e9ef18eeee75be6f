"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Groups are rows with equal texts (told apart by 64 bits of a hash; two texts that
share it would only share a shard). A group of at least 1/BUNDLES of all bytes is
an item of its own (there can be at most BUNDLES of them); smaller groups are
bundled by a hash into BUNDLES items. So the packing itself has at most
2 * BUNDLES items however large the table is, and the rest is partial sums,
joins with that small table and windows within bundles.

Bundles cost little: best fit decreasing leaves shards at most about the size of the
items packed last apart. Those are small groups in any case; as bundles they are about
1/BUNDLES of all bytes, so 40 shards differ by 0.5 % of a shard at most or so, whatever
the sizes of the groups are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import save_at

#: Items of the packing: at most this many large groups and this many bundles.
BUNDLES = 8192
#: Parts of a bundle that are numbered apart, so that a hot group isn't one task.
PARTS = 32


#: A tree of remaining capacities: key (free bytes, bin), left, right, height.
Node = tuple[tuple[int, int], "Node | None", "Node | None", int]


def _height(tree: Node | None) -> int:
    return tree[3] if tree else 0


def _node(key: tuple[int, int], left: Node | None, right: Node | None) -> Node:
    return (key, left, right, 1 + max(_height(left), _height(right)))


def _balanced(key: tuple[int, int], left: Node | None, right: Node | None) -> Node:
    """A node whose sides differ by one in height at most, by rotations."""
    if _height(left) > _height(right) + 1:
        k, a, b, _ = left
        if _height(a) >= _height(b):
            return _node(k, a, _node(key, b, right))
        return _node(b[0], _node(k, a, b[1]), _node(key, b[2], right))
    if _height(right) > _height(left) + 1:
        k, a, b, _ = right
        if _height(b) >= _height(a):
            return _node(k, _node(key, left, a), b)
        return _node(a[0], _node(key, left, a[1]), _node(k, a[2], b))
    return _node(key, left, right)


def _put(tree: Node | None, key: tuple[int, int]) -> Node:
    if tree is None:
        return _node(key, None, None)
    k, left, right, _ = tree
    return _balanced(k, _put(left, key), right) if key < k else _balanced(k, left, _put(right, key))


def _without(tree: Node, key: tuple[int, int]) -> Node | None:
    k, left, right, _ = tree
    if key < k:
        return _balanced(k, _without(left, key), right)
    if key > k:
        return _balanced(k, left, _without(right, key))
    if left is None or right is None:
        return left or right
    least = right
    while least[1]:
        least = least[1]
    return _balanced(least[0], left, _without(right, least[0]))


class Tightest:
    """Remaining capacities in a height-balanced tree: all steps take logarithmic time."""

    def __init__(self) -> None:
        self.tree: Node | None = None

    def add(self, free: int, shard: int) -> None:
        self.tree = _put(self.tree, (free, shard))

    def take(self, size: int) -> tuple[int, int] | None:
        """The bin with the least capacity of at least size, taken out; None if nothing fits."""
        at, found = self.tree, None
        while at:
            found, at = (at[0], at[1]) if at[0][0] >= size else (found, at[2])
        if found:
            self.tree = _without(self.tree, found)
        return found


def pack(sizes: list[tuple[int, int]], capacity: int) -> dict[int, int]:
    """Best fit decreasing: {item: bin} for (item, size); a larger item than capacity has a bin of its own."""
    bins, out, n = Tightest(), {}, 0
    for item, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        found = bins.take(size)
        free, shard = found if found else (max(capacity, size), n)
        n += not found
        out[item] = shard
        bins.add(free - size, shard)
    return out


def pack_into(sizes: list[tuple[int, int]], shards: int) -> dict[int, int]:
    """Packs into at most ``shards`` bins with the least capacity for which best fit decreasing needs no more (by bisection)."""
    if not sizes:
        return {}
    total, largest = sum(s for _, s in sizes), max(s for _, s in sizes)
    low, high = max(largest, -(-total // shards)), max(largest, 2 * -(-total // shards) + largest)
    # An item above the even share fills a bin alone; the others share what bins are left.
    while low < high:
        mid = (low + high) // 2
        if len(set(pack(sizes, mid).values())) <= shards:
            high = mid
        else:
            low = mid + 1
    return pack(sizes, high)


def even_out(sizes: list[tuple[int, int]], shards: int) -> dict[int, int]:
    """Items larger than the even share of what is left get bins of their own; the rest is packed by pack_into()."""
    rest, left, out = sorted(sizes, key=lambda x: (-x[1], x[0])), shards, {}
    total = sum(s for _, s in rest)
    while rest and left > 1 and rest[0][1] * left > total:
        item, size = rest.pop(0)
        out[item] = shards - left
        left, total = left - 1, total - size
    packed = pack_into(rest, left)
    return out | {item: shards - left + shard for item, shard in packed.items()}


def shard_rows(docs: DataFrame, shards: int = 40, overhead: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null), item.

    size is the text's UTF-8 bytes (null: none) plus ``overhead``. Rows with
    equal texts share a shard (null and empty texts are one group). The sizes of
    the shards are near equal: at most 1/BUNDLES of all bytes apart or so, but
    that a group larger than a shard's even share is a shard of its own. Slots
    run from 0 without gaps in each shard, by part and then doc_id. Null keys and
    repeated rows keep a row and a slot each; an empty table gives an empty
    result. Only the two named columns are read.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias("id"), (F.octet_length(body) + F.lit(overhead)).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"),
        F.xxhash64(body).alias("group"), F.xxhash64(F.monotonically_increasing_id()).alias("h"),
    )
    rows, _ = save_at(rows, "rows")
    bundle = F.pmod("group", F.lit(BUNDLES))
    groups = rows.groupBy("group").agg(F.sum("size").alias("bytes"))
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    least = max(1, -(-total // BUNDLES))
    large = [(r["group"], r["bytes"]) for r in groups.where(F.col("bytes") >= least).collect()]
    hot = [g for g, _ in large]
    small = [(r["b"], r["bytes"]) for r in groups.where(F.col("bytes") < least).groupBy(bundle.alias("b")).agg(F.sum("bytes").alias("bytes")).collect()]
    items = [(i, s) for i, (_, s) in enumerate(large)] + [(len(large) + i, s) for i, (_, s) in enumerate(small)]
    put = even_out(items, shards)
    names = [(g, -1) for g in hot] + [(None, b) for b, _ in small]
    table = spark.createDataFrame([(i, *names[i], put[i]) for i, _ in items], "item int, hot long, bundle long, shard int")
    rows = rows.join(F.broadcast(table.where("hot is not null").select("hot", F.col("item").alias("a"), F.col("shard").alias("s"))), F.col("group") == F.col("hot"), "left")
    rows = rows.withColumn("b", bundle).join(F.broadcast(table.where("hot is null").select("bundle", F.col("item").alias("a2"), F.col("shard").alias("s2"))), F.col("b") == F.col("bundle"), "left")
    rows = rows.select("id", "size", "text_crc32", F.coalesce("a", "a2").alias("item"), F.coalesce("s", "s2").alias("shard"), F.pmod("h", F.lit(PARTS)).alias("part"))
    before = rows.groupBy("shard", "item", "part").count()
    before = before.select("shard", "item", "part", (F.sum("count").over(Window.partitionBy("shard").orderBy("item", "part")) - F.col("count")).alias("before"))
    slots = rows.withColumn("nth", F.row_number().over(Window.partitionBy("shard", "item", "part").orderBy("id", "size", "text_crc32")))
    out = slots.join(before, ["shard", "item", "part"])
    return out.select(F.col("id").alias(key), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("nth") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "item")
