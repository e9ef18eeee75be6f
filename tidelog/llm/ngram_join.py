"""Jaccard metric-space join of documents by their word shingles.

Documents are points of a metric space: sets of shingles under the Jaccard
distance. The join is exact and recursive.

1. Equal sets are one point.
2. A point belongs to the region of each of its first n - ceil(t n) + 1 shingles in a
   global order, rare ones first. Two points within the radius meet in the region of
   their first common shingle. Regions with the same members are one region.
3. In every region some members are pivots. A pivot meets all other members but those
   of its component and those that sizes and places rule out; parities of the shingles'
   bits bound these distances from below, and only pairs that may lie within the radius
   are compared by their whole sets. A member within the radius of a pivot is linked to
   it and leaves the region for the Voronoi cell of its nearest pivot. By the triangle
   inequality it can only link to members at most its own distance plus the radius from
   that pivot: the boundary documents in this window that are of other components are
   replicated to the cell. Cells and what is left of the region are the regions of the
   next round, with more pivots, until all that meet in a region are of one component.

What a region broadcasts or sends to the driver is nothing; the only broadcast is
the list of the HOT commonest shingles, of a fixed length, and it changes the
order alone, never the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BROADCAST_IDS, by_ids, drop_table, lean_batches, release, save_at, small, tidy
from .components import connected_components
from .packing import from_planes, pack, planes, unpack
from .shingles import batches_of, lists_of, mix, text_sets

#: At most so many shingles are put last in the order: the commonest, 6 MB.
HOT = 1 << 19
#: A shingle counts as common if so many documents hold it, by counts from AT_LEAST on within slices of SLICE shingles (16 MB).
COMMON, AT_LEAST, SLICE = 8, 2, 2_000_000
#: Bytes of text that a task makes into sets at a time, and rows and bytes of a table that it gets at a time.
PART, ROWS, BATCH = 1_000_000, 2_000, 1_000_000
#: First shingles that a task counts the members of at a time, and that a range of hashes has about.
MEMBERS = 500_000
#: Pivots of a region in the first round; later rounds take MORE times as many.
PIVOTS, MORE = 3, 8


def _common_shingles(docs: DataFrame, text: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the commonest shingles, in order of hash, and the place of each by its count; every text is counted."""

    def counted(flat: np.ndarray) -> pa.RecordBatch:
        flat.sort()
        more = flat[1:][flat[1:] == flat[:-1]]  # a shingle once less than it occurs
        found, count = np.unique(more, return_counts=True)
        often = count + 1 >= AT_LEAST
        return pa.RecordBatch.from_arrays([pa.array(found[often].view(np.int64)), pa.array(count[often] + 1)], names=["token", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, size = np.empty(SLICE, np.uint64), 0
        for batch in batches:
            for part in batches_of(batch, text, PART):
                for s in text_sets(part[text].to_pylist(), k):
                    while len(s):  # a slice is full to the last place; a shingle that a set's other slice has counts there
                        some = s[: SLICE - size]
                        flat[size : size + len(some)] = some
                        s, size = s[len(some) :], size + len(some)
                        if size == SLICE:
                            yield counted(flat)
                            size = 0
        if size:
            yield counted(flat[:size])

    counts = docs.select(text).mapInArrow(tidy(run), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    top = counts.where(F.col("n") >= COMMON).orderBy(F.desc("n"), "token").limit(HOT).toPandas()
    token = top["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(token)
    return token[order], np.lexsort((token, top["n"].to_numpy())).argsort().astype(np.int32)[order]


def _first_shingles(docs: DataFrame, key: str, text: str, k: int, percent: int, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """id, n (shingles of the set), sig (128 bits of the set; null if empty), first (its first shingles in the order)."""
    hot = docs.sparkSession.sparkContext.broadcast(common)

    def order(s: np.ndarray) -> np.ndarray:
        n = len(s)
        most = n - -(-percent * n // 100) + 1
        token, place = hot.value
        if len(token) and n:
            at = np.minimum(np.searchsorted(token, s), len(token) - 1)
            last = token[at] == s
            s = np.concatenate([s[~last], s[last][np.argsort(place[at[last]])]]) if last.any() else s
        return s[:most] if n else s

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batches_of(batch, text, PART):
                sets = list(text_sets(part[text].to_pylist(), k))
                yield pa.RecordBatch.from_arrays([part["id"], pa.array([len(s) for s in sets], pa.int32()), pa.array([_sig(s) for s in sets], pa.binary()), lists_of([order(s) for s in sets])], names=["id", "n", "sig", "first"])

    return docs.select(F.col(key).cast("long").alias("id"), text).mapInArrow(tidy(run), "id long, n int, sig binary, first array<long>")


def _sig(s: np.ndarray) -> bytes | None:
    import xxhash

    return xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None


def _parities(s: np.ndarray) -> bytes:
    """A bit for each class of hashes by their low bits, at least two classes a shingle: whether the set has an odd number of the class."""
    size = max(64, 1 << (2 * len(s) - 1).bit_length())
    odd = np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _folded(bits: np.ndarray, size: int) -> np.ndarray:
    while len(bits) > size:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def _sets(wanted: DataFrame, text: str, k: int) -> DataFrame:
    """node, held (the whole set, packed) and bits (its parities) of rows (node, sig, text) whose text has that set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batches_of(batch, text, PART):
                rows = [(i, pack(s), _parities(s)) for i, sig, s in zip(part["node"].to_pylist(), part["sig"].to_pylist(), text_sets(part[text].to_pylist(), k), strict=True) if _sig(s) == sig]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["node", "held", "bits"])

    return wanted.select("node", "sig", text).mapInArrow(tidy(run), "node long, held binary, bits binary")


def _least_distance(x: bytes, y: bytes, sizes: int) -> float:
    """A lower bound of the distance, by parities: the sets differ at least in as many shingles as their parities do."""
    p, q = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    size = min(len(p), len(q))
    differ = int(np.bitwise_count(_folded(p, size) ^ _folded(q, size)).sum())
    return 2 * differ / (sizes + differ)


def _common(x: bytes, y: bytes) -> int:
    p, q = unpack(x), unpack(y)
    p, q = (p, q) if len(p) <= len(q) else (q, p)
    return int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum())


def _compared(pairs: DataFrame, sets: DataFrame, column: str, whole: bool) -> DataFrame:
    """Saved pairs (a, b, sizes) with common, the shingles of both sets if whole, else with least, a lower bound of the distance.

    A pair's second set moves once; the first, mostly a pivot's, moves once for
    all its pairs, in a join that Spark can split where a pivot has very many.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = zip(batch["x"], batch["y"], batch["sizes"].to_pylist(), strict=True)  # one pair's bytes at a time
            out = pa.array([_common(x.as_py(), y.as_py()) if whole else _least_distance(x.as_py(), y.as_py(), n) for x, y, n in each], pa.int64() if whole else pa.float64())
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], batch["sizes"], out], names=["a", "b", "sizes", "common" if whole else "least"])

    few = pairs.count() <= BROADCAST_IDS // 20
    second = sets.select(F.col("node").alias("b"), F.col(column).alias("y")).join(F.broadcast(pairs) if few else pairs.hint("merge"), "b")
    ends, _ = save_at(pairs.select(F.col("a").alias("node")).distinct(), "ends", pairs.count())
    first = by_ids(sets.select("node", column), ends, "node").select(F.col("node").alias("a"), F.col(column).alias("x"))
    return second.join(first.hint("merge"), "a").select("a", "b", "sizes", "x", "y").mapInArrow(tidy(run), "a long, b long, sizes long, " + ("common long" if whole else "least double"))


def _runs(token: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the tokens in their order, and of each distinct one where it begins in this order and how often it occurs."""
    order = np.argsort(token)
    token = token[order]
    start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
    return order, start, np.diff(start, append=len(token))


def _merged(token: np.ndarray, *columns: np.ndarray) -> list[np.ndarray]:
    """Distinct tokens in order; of each m, low and high are summed and one and least_at are the least."""
    order, start, _ = _runs(token)
    if not len(token):
        return [token, *columns]
    sums = [np.add.reduceat(c[order], start) for c in columns[:3]]
    return [token[order[start]], *sums, *[np.minimum.reduceat(c[order], start) for c in columns[3:]]]


def _members(token: np.ndarray, node: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """token, m, low, high, one, least_at of members that are counted one by one."""
    name = node.view(np.uint64)
    return [token, np.ones(len(token), np.int64), mix(name), mix(~name), node, at.astype(np.int64)]


def _sent(nodes: list[int], sets: list[np.ndarray], bits: int) -> pa.RecordBatch:
    """A row for each range of hashes, by their first bits: tokens with one member, their nodes and places, and what is counted of the others."""
    ends = np.cumsum([len(s) for s in sets])
    begins = np.concatenate([[0], ends[:-1]])

    def owners(where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        of = np.searchsorted(ends, where, side="right")
        return np.array(nodes, np.int64)[of], where - begins[of]

    flat = np.concatenate(sets).view(np.uint64)
    order, start, m = _runs(flat)
    lone = order[start[m == 1]]
    token, (node, place) = flat[lone], owners(lone)
    several = order[np.repeat(m > 1, m)]
    more = np.stack([c.view(np.uint64) for c in _merged(*_members(flat[several], *owners(several)))])
    span = np.arange((1 << bits) + 1).astype(np.uint64)
    cut, also = (np.searchsorted(t >> np.uint64(64 - bits), span) for t in (token, more[0]))
    out = [
        (r, pack(token[i:j]), planes(node[i:j].view(np.uint64)), planes(place[i:j].view(np.uint64)), more[:, k:m].tobytes())
        for r, (i, j, k, m) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), also[:-1].tolist(), also[1:].tolist(), strict=True))
        if i < j or k < m
    ]
    kinds = [pa.int32(), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["span", "tokens", "nodes", "places", "more"])


def _meet(found: pa.Table) -> pa.Table:
    """Of all rows of a range, the tokens with more than one member; those with one are left out before anything is counted."""
    full = [i for i, x in enumerate(found["nodes"]) if x.as_py()[1:5] != bytes(4)]  # rows with tokens of one member
    columns = [np.concatenate([np.zeros(0, np.uint64), *[read(found[c][i].as_py()) for i in full]]) for c, read in (("tokens", unpack), ("nodes", from_planes), ("places", from_planes))]
    table = np.concatenate([np.frombuffer(x.as_py(), np.uint64).reshape(6, -1) for x in found["more"]], axis=1)
    order, start, m = _runs(np.concatenate([columns[0], table[0]]))
    lone = len(columns[0])
    kept = np.sort(order[np.repeat((m > 1) | (order[start] >= lone), m)])  # all but the tokens with one member in all
    one, other = kept[kept < lone], kept[kept >= lone] - lone
    ones = _members(columns[0][one], columns[1][one].view(np.int64), columns[2][one])
    others = [table[i][other] if i in (0, 2, 3) else table[i][other].view(np.int64) for i in range(6)]
    all_of = _merged(*[np.concatenate(c) for c in zip(ones, others, strict=True)])
    return pa.table([pa.array(c.view(np.int64)) for c in all_of], names=["token", "m", "low", "high", "one", "least_at"])


def _shared(points: DataFrame) -> DataFrame:
    """token, m, low, high, one, least_at, as of _same(), of the regions with more than one member.

    A task sends each range of hashes one row: its tokens with one member, their
    nodes and places as packed arrays, and what it has counted of all others. So a
    member moves as some nine bytes, and a common token once a task.
    """
    total = points.agg(F.sum(F.size("first"))).first()[0] or 0
    bits = max(4, (total // MEMBERS).bit_length())

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, sets, size = [], [], 0
        for batch in batches:
            first = batch["first"]
            ends, flat = first.offsets.to_numpy(), first.values.to_numpy()
            for i, node in enumerate(batch["node"].to_pylist()):
                nodes.append(node)
                sets.append(flat[ends[i] : ends[i + 1]])
                size += len(sets[-1])
                if size >= MEMBERS:
                    yield _sent(nodes, sets, bits)
                    nodes, sets, size = [], [], 0
            sets = [np.array(x) for x in sets]  # the batch itself is let go
        if size:
            yield _sent(nodes, sets, bits)

    sent = points.select("node", "first").mapInArrow(tidy(send), "span int, tokens binary, nodes binary, places binary, more binary")
    return sent.groupBy("span").applyInArrow(_meet, "token long, m long, low long, high long, one long, least_at long")


def _regions(points: DataFrame) -> DataFrame:
    """token, node, n, at, own: the members of the regions with more than one member."""
    tokens = _distinct(_shared(points))
    return by_ids(points.select("node", "n", F.posexplode("first").alias("at", "token"), F.lit(True).alias("own")), tokens, "token", "inner")


def _same() -> list[Column]:
    """What regions with the same members have in common, and their least place in the order."""
    name = F.xxhash64("node", "own")
    return [F.count("*").alias("m"), F.sum(name.bitwiseAND(0xFFFFFFFF)).alias("low"), F.sum(F.shiftrightunsigned(name, 32)).alias("high"), F.min("node").alias("one"), F.min("at").alias("least_at")]


def _distinct(regions: DataFrame, rows: int | None = None) -> DataFrame:
    """Of regions with the same members the one whose shingle is first in the order: there its members' pairs have their first common shingle."""
    first = regions.groupBy("m", "low", "high", "one").agg(F.min(F.struct("least_at", "token")).alias("r"))
    return save_at(first.select("r.token"), "tokens", rows)[0]


def similar_documents(docs: DataFrame, k: int = 5, percent: int = 75, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id.

    Two documents link when the Jaccard similarity of their sets of k-word
    shingles is at least percent/100 (percent from 50 to 100; integers, so ties
    are exact). component_id is the smallest doc_id that links lead to. A text
    with fewer than k words is one shingle; null texts and texts without words
    have none and link with nothing. Rows with the same doc_id are nodes of the
    same name; rows with a null doc_id keep null as component_id and join no
    group. Tables without rows give none. Only the two named columns are read.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent must lie between 50 and 100")
    with lean_batches(docs.sparkSession, ROWS, BATCH):
        return _classes(docs, k, percent, key, text)


def _classes(docs: DataFrame, k: int, percent: int, key: str, text: str) -> DataFrame:
    made, made_at = save_at(_first_shingles(docs, key, text, k, percent, _common_shingles(docs, text, k)), "first")
    named = made.where("sig is not null and id is not null")
    points, points_at = save_at(named.groupBy("sig").agg(F.min("id").alias("id")).withColumn("node", F.monotonically_increasing_id()), "points")
    repeated = named.count() != named.select("id").distinct().count()
    few = points.count() <= BROADCAST_IDS // 2
    one = named.join(F.broadcast(points) if few else points.hint("shuffle_hash"), ["id", "sig"])
    region, region_at = save_at(_regions(one.dropDuplicates(["sig"]) if repeated else one), "regions")
    inside, inside_at = save_at(region.select("node").distinct().join(points, "node"), "inside")
    texts = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    wanted = texts.join(F.broadcast(inside) if inside.count() <= BROADCAST_IDS // 2 else inside.hint("shuffle_hash"), "id")
    held = _sets(wanted, "text", k)
    sets, sets_at = save_at(held.dropDuplicates(["node"]) if repeated else held, "sets")

    release(docs.sparkSession)
    component = None
    if repeated:  # Rows with the same doc_id are one node.
        several = named.join(points.select("sig", "node"), "sig").select("id", "node").distinct()
        component = connected_components(several.join(several.groupBy("id").agg(F.min("node").alias("low")), "id"), "node", "low")
    region = _with_component(region, component)
    pivots = PIVOTS
    while not region.isEmpty():
        component, rest = _round(region, sets, component, pivots, percent)
        drop_table(docs.sparkSession, region_at)
        region, region_at = rest
        release(docs.sparkSession)
        pivots *= MORE
    classes = points.select("sig", "node", "id") if component is None else points.join(component, "node", "left").select("sig", F.coalesce("component", "node").alias("node"), "id")
    lowest = classes.groupBy("node").agg(F.min("id").alias("component_id"))
    out, _ = save_at(made.select("id", "n", "sig").join(classes.select("sig", "node").join(lowest, "node").drop("node"), "sig", "left"), "classes")
    for path in (made_at, points_at, inside_at, sets_at, region_at):
        drop_table(docs.sparkSession, path)
    return out.select(F.col("id").alias(key), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))


def _with_component(region: DataFrame, component: DataFrame | None) -> DataFrame:
    return region.withColumn("component", F.col("node")) if component is None else region.join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _unsettled(region: DataFrame, rows: int) -> DataFrame:
    """Regions in which an own member may meet one of another component."""
    open_ones = region.groupBy("token").agg(F.min("component").alias("lowest"), F.max("component").alias("highest"), F.max("own").alias("any"), *_same())
    return by_ids(region, _distinct(open_ones.where("lowest <> highest and any"), rows), "token")


def _round(region: DataFrame, sets: DataFrame, component: DataFrame | None, pivots: int, percent: int) -> tuple[DataFrame, tuple[DataFrame, str]]:
    """Components after one round, and the regions of the next (saved, with the path).

    region: token, node, n, at, own (not a boundary document that was replicated), component.
    """
    spark, radius, rows = region.sparkSession, 1 - percent / 100, region.count()
    # Pivots are own members, those whose component is rarest in the region first.
    often, often_at = save_at(region.groupBy("token", "component").agg(F.count("*").alias("often")), "often", rows)
    ranked = region.where("own").join(small(often), ["token", "component"])
    ranked = ranked.withColumn("nth", F.row_number().over(Window.partitionBy("token").orderBy("often", "node"))).where(F.col("nth") <= pivots)
    chosen, chosen_at = save_at(ranked.select("token", F.col("node").alias("pivot"), F.col("n").alias("pn"), F.col("at").alias("pat"), F.col("component").alias("pc")), "pivots", rows)

    # Members meet the pivots of other components that they may link to, by sizes and by places in the order.
    link = (100 + percent) * F.least(F.col("n") - F.col("at"), F.col("pn") - F.col("pat")) >= percent * (F.col("n") + F.col("pn"))
    centre = small(chosen)
    met = region.join(centre, "token").where(F.col("component") != F.col("pc")).where(link)
    met, met_at = save_at(met.select("token", "node", "own", "n", "at", "pivot", "pn", *_pair("node", "pivot")), "met", rows)
    bounds, bounds_at = _bounds(met, sets)
    close, close_at = save_at(bounds.where(F.col("least") <= radius + 1e-9).select("a", "b", "sizes"), "close", bounds.count())
    known, known_at = save_at(_compared(close, sets, "held", whole=True), "distances")
    either = F.col("sizes") - F.col("common")
    known, near_at = save_at(known.where(F.col("common") * 100 >= either * percent), "links")
    links = known.count()
    linked = known.select("a", "b")
    if links:
        links += 0 if component is None else component.count()
        component = connected_components(linked if component is None else linked.unionByName(component.select(F.col("node").alias("a"), F.col("component").alias("b"))), rows=links)
    of_all = None if component is None else small(component)

    # An own member in some pivot's radius leaves for the cell of the nearest; pivots have met all.
    within = met.where("own").join(small(known).select("a", "b", (1 - F.col("common") / either).alias("d")), ["a", "b"])
    cells = within.groupBy("token", "node", "n", "at").agg(F.min(F.struct("d", "pivot", "pn")).alias("cell"))
    cells, cells_at = save_at(cells.select("token", "node", "n", "at", "cell.*"), "cells", met.count())
    region = _with_component(region.drop("component"), of_all)
    parts = region.drop("component").join(centre.select("token", F.col("pivot").alias("node")), ["token", "node"], "left_anti").join(small(cells).select("token", "node"), ["token", "node"], "left_anti")

    # Windows: boundary documents of other components that a member of the cell may link to, and the members that they may link to.
    paths = [often_at, chosen_at, met_at, bounds_at, close_at, known_at, near_at, cells_at]
    release(spark)
    if not cells.isEmpty():
        centres = cells.groupBy("token", "pivot", "pn").agg((F.max("d") + radius + 1e-9).alias("most"))
        centres = _with_component(centres.withColumnRenamed("pivot", "node"), of_all).select("token", F.col("node").alias("pivot"), "pn", "most", F.col("component").alias("pc"))
        centres, centres_at = save_at(centres, "centres", rows)
        near = region.join(small(centres), "token").where(F.col("component") != F.col("pc")).where(F.least("n", "pn") >= (1 - F.col("most")) * F.greatest("n", "pn"))
        near, nearby_at = save_at(near.select("token", "node", "n", "at", "pivot", "most", *_pair("node", "pivot")), "near", rows)
        least, least_at = _bounds(near, sets)
        window, window_at = save_at(near.join(small(least).drop("sizes"), ["a", "b"]).where(F.col("least") <= F.col("most")), "windows", near.count())
        starts, starts_at = save_at(window.groupBy("token", "pivot").agg(F.min("least").alias("from")), "starts", window.count())
        inner = cells.join(small(starts), ["token", "pivot"]).where(F.col("d") >= F.col("from") - radius - 1e-9)
        name = F.xxhash64("token", "pivot").alias("token")
        parts = parts.unionByName(inner.select(name, "node", "n", "at", F.lit(True).alias("own"))).unionByName(window.select(name, "node", "n", "at", F.lit(False).alias("own")))
        paths += [centres_at, nearby_at, least_at, window_at, starts_at]
    rest = save_at(_unsettled(_with_component(parts, of_all), rows), "regions", rows)
    for path in paths:
        drop_table(spark, path)
    return component, rest


def _pair(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), (F.col("n") + F.col("pn")).cast("long").alias("sizes")]


def _bounds(met: DataFrame, sets: DataFrame) -> tuple[DataFrame, str]:
    """Lower bounds of the distances of the distinct pairs of a saved table, saved, with the path."""
    pairs, pairs_at = save_at(met.select("a", "b", "sizes").distinct(), "pairs", met.count())
    bounds = save_at(_compared(pairs, sets, "bits", whole=False), "bounds", 20 * pairs.count())
    drop_table(met.sparkSession, pairs_at)
    return bounds
