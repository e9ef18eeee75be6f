from __future__ import annotations

import random

from pyspark.sql import functions as F

from tidelog.operators import fetch, log, offsets, sparse_index
from tidelog.operators.prefix import offset_block, running

LOG = "topic string, partition int, segment_base long, offset long, record_size long, payload binary"
ASK = "request_id long, group string, topic string, partition int, start long, max_bytes long"


def made(spark, *segments: tuple[int, list[int]]):
    """A log of one partition: (base, payload sizes) of each segment."""
    rows = [("t", 0, base, base + i, 12 + n, bytes(n)) for base, sizes in segments for i, n in enumerate(sizes)]
    return spark.createDataFrame(rows, LOG)


def read(spark, rows, start: int, budget: int):
    asked = spark.createDataFrame([(1, "", "t", 0, start, budget)], ASK)
    got = sorted(r["offset"] for r in fetch.fetch_records(rows, asked).collect())
    summary = fetch.fetch_summary(rows, asked).first()
    assert summary["n_records"] == len(got)
    return got, summary["next_offset"], summary["status"]


def test_fetch_scenarios(spark):
    gaps = made(spark, (100, [10, 10]), (200, [10, 10]), (300, [10, 10]))
    assert read(spark, gaps, 100, 10_000) == ([100, 101, 200, 201, 300, 301], 302, "ok")
    assert read(spark, gaps, 150, 10_000) == ([200, 201, 300, 301], 302, "ok")
    assert read(spark, gaps, 50, 10_000) == ([], 50, "out_of_range")
    assert read(spark, gaps, 302, 10_000) == ([], 302, "at_end")
    assert read(spark, gaps, 100, 0) == ([], 100, "ok")
    small = made(spark, (100, [4, 4]), (200, [4, 4]))
    assert read(spark, small, 100, 32) == ([100, 101], 102, "ok")
    assert read(spark, small, 102, 32) == ([200, 201], 202, "ok")
    assert read(spark, small, 100, 48) == ([100, 101, 200], 201, "ok")


def test_a_read_never_skips_a_record(spark):
    rows = made(spark, (100, [10, 10, 10]), (103, [10]), (104, [10]))
    assert read(spark, rows, 100, 50) == ([100, 101], 102, "ok")
    assert read(spark, made(spark, (100, [10, 10, 10]), (103, [500])), 100, 50) == ([100, 101], 102, "ok")
    assert read(spark, made(spark, (0, [500, 1])), 0, 1) == ([0], 1, "ok")


def test_fetch_against_a_loop(spark):
    r = random.Random(5)
    rows = made(spark, *[(base, [r.choice([0, 3, 20, 200]) for _ in range(r.randint(1, 9))]) for base in range(0, 200, 10)])
    records = sorted((x["offset"], x["record_size"]) for x in rows.collect())
    asked = [(i, "", "t", 0, r.randint(0, 210), r.choice([0, 1, 60, 500, 5000])) for i in range(40)]
    got: dict[int, list[int]] = {}
    for x in fetch.fetch_records(rows, spark.createDataFrame(asked, ASK)).collect():
        got.setdefault(x["request_id"], []).append(x["offset"])
    for i, _, _, _, start, budget in asked:
        want, used = [], 0
        for offset, size in records if budget else []:
            if offset >= start:
                if want and used + size > budget or not want and False:
                    break
                want.append(offset)
                used += size
        assert sorted(got.get(i, [])) == want, (start, budget)


def test_running_in_blocks(spark):
    rows = spark.createDataFrame([("t", 0, o, o % 7 + 1) for o in range(0, 1000, 3)], "topic string, partition int, offset long, size long")
    out = running(rows, log.PARTITION, ["offset"], offset_block(size=50), "size").orderBy("offset").collect()
    total = 0
    for i, x in enumerate(out):
        assert (x["nth"], x["before"]) == (i, total)
        total += x["size"]


def test_offsets_go_on_and_requests_are_split(spark):
    batch = spark.createDataFrame([("r1", 0, "t", 0, b"ab"), ("r1", 1, "t", 0, b"abcdef"), ("r1", 2, "t", 0, b"a"), ("r2", 3, "t", 9, b"a"), ("r3", 4, "nope", 0, b"a"), ("r4", 5, "t", 0, None)], "request_id string, seq int, topic string, partition int, payload binary")
    out = log.split_requests(batch, spark.createDataFrame([("t", 1)], "name string, partition_count int"), ["seq"], max_record=5)
    assert {(x["seq"], x["code"]) for x in out.collect()} == {(0, None), (1, 500), (2, 500), (3, 10), (4, 10), (5, None)}
    stored = log.assign_offsets(out.where("accepted"), ["seq"], spark.createDataFrame([("t", 0, 40)], "topic string, partition int, next_offset long"))
    assert sorted((x["seq"], x["offset"]) for x in stored.collect()) == [(0, 40), (5, 41)]


def test_last_commit_wins_and_lag_is_never_negative(spark):
    commits = spark.createDataFrame([("g", "t", 0, 200, 1), ("g", "t", 0, 50, 2), ("h", "t", 0, 9, 1), ("h", "gone", 0, 9, 1)], "group string, topic string, partition int, offset long, commit_seq long")
    rows = made(spark, (0, [1] * 20))
    got = {(x["group"], x["topic"]): (x["committed"], x["lag"], x["slow"]) for x in offsets.consumer_lag(commits, rows, threshold=10).collect()}
    assert got == {("g", "t"): (50, 0, False), ("h", "t"): (9, 11, True), ("h", "gone"): (9, 0, False)}


def test_group_without_commit_comes_before_the_existence_check(spark):
    rows = made(spark, (0, [1, 1]))
    asked = spark.createDataFrame([(1, "new", "nowhere", 0, 5, 99), (2, "", "nowhere", 0, 5, 99)], "request_id long, group string, topic string, partition int, offset long, max_bytes long")
    commits = spark.createDataFrame([], "group string, topic string, partition int, offset long")
    out = {x["request_id"]: (x["status"], x["code"], x["next_offset"]) for x in fetch.fetch_summary(rows, fetch.resolve_requests(asked, commits)).collect()}
    assert out == {1: ("no_commit", None, 0), 2: ("unknown_partition", 10, 5)}


def test_index_lookup_and_health(spark):
    index = spark.createDataFrame([("t", 0, 100, 0), ("t", 0, 200, 1500), ("t", 0, 300, 3000)], "topic string, partition int, offset long, position long")
    asked = spark.createDataFrame([("t", 0, x) for x in (50, 99, 100, 150, 250, 300, 1000)] + [("u", 0, 5)], "topic string, partition int, target long")
    got = {(x["topic"], x["target"]): x["position"] for x in sparse_index.lookup_positions(asked, index).collect()}
    assert got == {("t", 50): None, ("t", 99): None, ("t", 100): 0, ("t", 150): 0, ("t", 250): 1500, ("t", 300): 3000, ("t", 1000): 3000, ("u", 5): None}
    rows = made(spark, (0, [5] * 250))
    stats = log.segment_stats(rows)
    none = spark.createDataFrame([], "topic string, partition int, segment_base long, offset long, position long")
    fresh, report = sparse_index.rebuild_index(rows, stats, none)
    assert sorted((x["offset"], x["position"]) for x in fresh.collect()) == [(0, 0), (100, 1700), (200, 3400)]
    assert [(x["scanned"], x["entries"], x["was_missing"]) for x in report.collect()] == [(250, 3, True)]
    assert sparse_index.index_health(stats, fresh).first()["status"] == "healthy"
    odd = stats.select(*log.SEGMENT, F.lit(15).alias("file_bytes"))
    assert [tuple(x)[-2:] for x in sparse_index.index_health(stats, none, odd).collect()] == [("invalid_size", 15)]


def test_rebuild_leaves_healthy_segments_alone(spark):
    rows = log.with_segments(spark.range(40_000).select(F.lit("t").alias("topic"), F.lit(0).alias("partition"), F.col("id").alias("offset"), F.lit(b"x").alias("payload")))
    stats = log.segment_stats(rows)
    index = sparse_index.build_index(rows, 25).where("segment_base <> 100")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100k")
    try:
        fresh, report = sparse_index.rebuild_index(rows, stats, index, every=25)
        assert "SortMergeJoin" not in fresh._jdf.queryExecution().executedPlan().toString()  # the log is neither shuffled nor sorted to find one segment
        assert [tuple(x) for x in report.collect()] == [("t", 0, 100, True, 100, 4)]
        assert fresh.count() == 1600
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
