from __future__ import annotations

import random

from tidelog.operators import catalog, compaction, limits, metrics, retention

SEG = "topic string, partition int, segment_base long, max_offset long, size_bytes long, sealed boolean, created_ms long"
KV = "topic string, partition int, segment_base long, offset long, ingest_seq long, key binary, value binary"


def test_retention(spark):
    segments = spark.createDataFrame([("t", 0, 0, 9, 100, True, 1000), ("t", 0, 10, 19, 100, True, 10), ("t", 0, 20, 29, 100, True, 10), ("t", 0, 30, 35, 100, False, 10)], SEG)
    bases = lambda df: sorted(r["segment_base"] for r in df.collect())
    assert bases(retention.expired_by_size(segments, 300, 25)) == []
    assert bases(retention.expired_by_size(segments, 150, 25)) == [0, 10]
    assert bases(retention.expired_by_size(segments, 0, 25)) == [0, 10]
    assert bases(retention.expired_by_size(segments, None, 25)) == []
    assert bases(retention.expired_by_time(segments, 500, 1000, 25)) == [10]
    assert bases(retention.expired_by_time(segments, None, 1000, 25)) == []
    assert tuple(retention.retention_summary(segments.limit(0)).first()) == (0, 0)


def test_retention_skip(spark):
    marks = spark.createDataFrame([("never", 0), ("now", 1000), ("old", 10), ("none", None), ("ahead", 5000)], "name string, last_retention_run_ms long")
    assert {r["name"]: r["skip"] for r in retention.with_skip(marks, 1000, 100).collect()} == {"never": False, "now": True, "old": False, "none": False, "ahead": True}


def test_latest_per_key(spark):
    rows = spark.createDataFrame([("t", 0, 0, 100, 1, b"k1", b"v1"), ("t", 0, 0, 200, 2, b"k1", b"v2"), ("t", 0, 0, 150, 3, b"k2", b"v3"), ("t", 0, 0, 90, 4, b"k3", b"x"), ("t", 0, 0, 95, 5, b"k3", None), ("t", 0, 0, 7, 6, b"k4", b"a"), ("t", 0, 0, 7, 7, b"k4", b"b")], KV)
    got = {bytes(r["key"]): (r["offset"], r["value"] and bytes(r["value"])) for r in compaction.latest_per_key(rows).collect()}
    assert got == {b"k1": (200, b"v2"), b"k2": (150, b"v3"), b"k3": (95, None), b"k4": (7, b"b")}


def test_eligible_segments_stop_at_the_first_that_is_held(spark):
    segments = spark.createDataFrame([("t", 0, 10 * i, 10 * i + 9, 1, i < 5, 0) for i in range(6)], SEG)
    mark = lambda x: spark.createDataFrame([("t", 0, x)], "topic string, partition int, last_compacted_offset long")
    bases = lambda df: sorted(r["segment_base"] for r in df.collect())
    assert bases(compaction.eligible_segments(segments, None, 35)) == [0, 10, 20]
    assert bases(compaction.eligible_segments(segments, mark(None), 35)) == [0, 10, 20]
    assert bases(compaction.eligible_segments(segments, mark(10), 1000)) == [20, 30, 40]


def test_compaction_replaces_segments(spark):
    rows = spark.createDataFrame([("t", 0, 0, 0, 0, b"a", b"1"), ("t", 0, 0, 1, 1, b"a", b"2"), ("t", 0, 10, 10, 2, b"b", b"3"), ("t", 0, 20, 20, 3, b"a", b"4")], KV)
    eligible = rows.where("segment_base < 20").select("topic", "partition", "segment_base").distinct()
    assert sorted((r["segment_base"], r["offset"]) for r in compaction.compact(rows, eligible).collect()) == [(1, 1), (1, 10), (20, 20)]
    result = compaction.compaction_result(rows, eligible)
    assert result.select("segments_rewritten", "records_in", "records_kept", "records_dropped", "highest_compacted").first()[:] == (2, 3, 2, 1, 10)
    old = spark.createDataFrame([("t", 0, 50)], "topic string, partition int, last_compacted_offset long")
    assert compaction.advance_checkpoints(old, result).first()[2:] == (50, "checkpoint would go back")


def test_rate_limit(spark):
    def allowed(*requests: tuple[int, int], limit: int = 1000, window: int = 100) -> list[bool]:
        rows = spark.createDataFrame([(1, i, t, b) for i, (t, b) in enumerate(requests)], "client long, seq long, t_ms long, bytes long")
        return [r["allowed"] for r in limits.rate_limit(rows, limit, window).orderBy("seq").collect()]

    assert allowed((0, 500), (1, 400)) == [True, True]
    assert allowed((0, 900), (1, 200), (2, 100)) == [True, False, True]
    assert allowed((0, 900), (50, 200), (150, 500)) == [True, False, True]
    assert allowed((0, 1000), (99, 1), (100, 1)) == [True, False, True]


def test_rate_limit_against_a_loop_over_many_clients(spark):
    r = random.Random(3)
    rows = [(r.randint(0, 9), i, r.randint(0, 3000), r.randint(0, 400)) for i in range(1500)]
    got = {x["seq"]: x["allowed"] for x in limits.rate_limit(spark.createDataFrame(rows, "client long, seq long, t_ms long, bytes long"), 900, 250).collect()}
    state: dict[int, tuple[int, int]] = {}
    for c, seq, t, b in sorted(rows, key=lambda x: (x[0], x[2], x[1])):
        start, used = state.get(c, (t, 0))
        if t - start >= 250:
            start, used = t, 0
        assert got[seq] == (used + b <= 900)
        state[c] = (start, used + b * (used + b <= 900))


def test_inflight_limit(spark):
    rows = spark.createDataFrame([(1, 0, 0, 10), (1, 1, 1, 10), (1, 2, 2, 10), (1, 3, 10, 1), (1, 4, 10, 1)], "client long, seq long, t_ms long, duration_ms long")
    assert [r["allowed"] for r in limits.inflight_limit(rows).orderBy("seq").collect()] == [True, True, False, True, False]


def test_percentiles(spark):
    rows = [("same", i, 1000) for i in range(100)] + [("tens", i, 10 * (i + 1)) for i in range(100)] + [("ring", i, i) for i in range(2048)] + [("zero", 0, 0)] + [("three", i, i + 1) for i in range(3)]
    got = {r["kind"]: (r["n"], r["p50"], r["p95"], r["p99"]) for r in metrics.latency_percentiles(spark.createDataFrame(rows, "kind string, seq long, nanos long")).collect()}
    assert got["same"] == (100, 1000, 1000, 1000)
    assert got["tens"] == (100, 500, 950, 990)
    assert got["ring"] == (1024, 1024 + 511, 1024 + 971, 1024 + 1012)
    assert got["zero"] == (0, 0, 0, 0)
    assert got["three"] == (3, 1, 2, 2)


def test_counters_and_export(spark):
    events = spark.createDataFrame([("bytes_in_total", 1024), ("bytes_in_total", 512), ("active_connections", 2), ("active_connections", -1), ("other", 5), ("bytes_out_total", None)], "name string, delta long")
    values = {r["name"]: r["value"] for r in metrics.counters(events).collect()}
    assert len(values) == 19 and (values["bytes_in_total"], values["active_connections"], values["bytes_out_total"]) == (1536, 1, 0)
    lags = spark.createDataFrame([("t", 1, "g", 7)], "topic string, partition int, group string, lag long")
    none = spark.createDataFrame([], "kind string, seq long, nanos long")
    text = "\n".join(r["line"] for r in metrics.prometheus_lines(events, none, lags).orderBy("section", "line").collect())
    assert "# TYPE active_connections gauge\nactive_connections 1" in text
    assert "fetch_latency_ns_p50 0" in text and 'consumer_lag{topic="t",partition="1",group="g"} 7' in text


def test_catalog(spark):
    topics = spark.createDataFrame([("c", 1), ("a", 3)], "name string, partition_count int")
    asked = spark.createDataFrame([(1, "b", 2), (2, "b", 2), (3, "a", 1), (4, "d", 0), (5, "d", 1)], "seq long, name string, partition_count int")
    assert {r["seq"]: r["code"] for r in catalog.check_new_topics(asked, topics).collect()} == {1: None, 2: 11, 3: 11, 4: 12, 5: None}
    assert [r["name"] for r in catalog.list_topics(catalog.create_topics(asked, topics)).collect()] == ["a", "b", "c", "d"]
    assert catalog.topic_partitions(topics).count() == 4


def test_every_customer_asks_for_a_topic(spark):
    sf = "/root/testdata/sf0.01"
    from tidelog.plans.queries import QUERIES

    taken, want = {f"topic{r['n_nationkey']}" for r in spark.read.parquet(f"{sf}/nation.parquet").collect()}, {}
    for key in sorted(r["c_custkey"] for r in spark.read.parquet(f"{sf}/customer.parquet").collect()):
        name = f"topic{key % 90}"
        want[key] = 12 if key % 5 == 0 else 11 if name in taken else None
        if want[key] is None:
            taken.add(name)
    assert {r["seq"]: r["code"] for r in QUERIES["create_topic_conflicts_all"](spark, sf).collect()} == want
