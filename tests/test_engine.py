from __future__ import annotations

import pytest

from tidelog import cli, errors
from tidelog.engine import LogEngine
from tidelog.operators.retention import RetentionConfig
from tidelog.sources import segment_files
from tidelog.streaming import consume

BATCH = "request_id long, seq long, topic string, partition int, payload binary"


def test_verbs_end_to_end(spark, tmp_path):
    engine = LogEngine(spark, f"file://{tmp_path}", segment_records=2)
    assert engine.ping() == "pong"
    engine.create_topic("orders", 2)
    with pytest.raises(errors.DuplicateTopic):
        engine.create_topic("orders", 1)
    with pytest.raises(errors.BadPartitionCount):
        engine.create_topic("none", 0)
    with pytest.raises(errors.UnknownTopic):
        engine.describe_topic("nowhere")
    rows = spark.createDataFrame([(1, i, "orders", 0, b"m%d" % i) for i in range(3)] + [(2, 9, "nowhere", 0, b"x")], BATCH)
    acks = {r["request_id"]: (r["base_offset"], r["record_count"], r["code"]) for r in engine.produce(rows, ["seq"]).collect()}
    assert acks == {1: (0, 3, None), 2: (None, None, 10)}
    engine.produce(rows.where("request_id = 1"), ["seq"])
    assert [(r["offset"], bytes(r["payload"])) for r in engine.fetch("orders", 0, 2).collect()] == [(2, b"m2"), (3, b"m0"), (4, b"m1"), (5, b"m2")]
    with pytest.raises(errors.UnknownPartition):
        engine.fetch("orders", 5)
    assert engine.fetch("orders", 0, 0, group="new").count() == 0
    engine.commit("g", "orders", 0, 5)
    engine.commit("g", "orders", 0, 4)
    assert engine.committed("g", "orders", 0) == 4 and engine.committed("h", "orders", 0) is None
    assert [r["offset"] for r in engine.fetch("orders", 0, 0, group="g").collect()] == [4, 5]
    assert engine.lag().first()["lag"] == 2
    assert cli.run(engine, ["partition", "orders", "0"])["high_watermark"] == 6
    assert cli.run(engine, ["partition", "orders", "7"])["code"] == 14
    assert cli.run(engine, ["list"]) == {"topics": [{"name": "orders", "partition_count": 2}]}
    assert engine.apply_retention(RetentionConfig(retention_ms=None, retention_bytes=30)).first()["segments_deleted"] == 1
    assert engine.describe_partition("orders", 0).first()["log_start"] == 2
    again = engine.table.append(rows.where("request_id = 1").drop("request_id"), ["seq"], 0, number=0)
    assert again == 0 and engine.describe_partition("orders", 0).first()["high_watermark"] == 6
    lines = engine.metrics_text(spark.createDataFrame([], "kind string, seq long, nanos long"))
    assert "messages_produced_total 4" in "\n".join(r["line"] for r in lines.collect())
    engine.register_views()
    assert spark.sql("SELECT count(*) FROM log").first()[0] == 4


def test_segment_files(spark, tmp_path):
    where = tmp_path / "t" / "3"
    where.mkdir(parents=True)
    record = lambda o, p: len(p).to_bytes(4, "big") + o.to_bytes(8, "big") + p
    (where / f"{100:020d}.log").write_bytes(record(100, b"hello") + record(101, b"") + record(102, b"cut short")[:-2])
    (where / f"{200:020d}.log").write_bytes(b"")
    got = [(r["topic"], r["partition"], r["segment_base"], r["offset"], bytes(r["payload"])) for r in segment_files.read_segment_files(spark, str(tmp_path)).collect()]
    assert got == [("t", 3, 100, 100, b"hello"), ("t", 3, 100, 101, b"")]


def test_consumption_goes_on_where_it_stopped(spark, tmp_path):
    engine = LogEngine(spark, f"file://{tmp_path}/log")
    engine.create_topic("t", 1)
    seen: list[int] = []
    commits = f"{tmp_path}/commits"

    def poll():
        stream = consume.stream_log(spark, f"file://{tmp_path}/log/data/log")
        consume.consume(stream, "g", f"{tmp_path}/position", lambda batch, _: seen.extend(r["offset"] for r in batch.collect()), commits).awaitTermination()

    for n in range(2):
        engine.produce(spark.createDataFrame([(1, i, "t", 0, b"x") for i in range(3)], BATCH), ["seq"])
        poll()
        assert sorted(seen) == list(range(3 * n + 3))
    poll()
    assert len(seen) == 6
    assert spark.read.parquet(commits).agg({"offset": "max"}).first()[0] == 6


def test_acks_by_request_and_uncommitted_batches(spark, tmp_path):
    engine = LogEngine(spark, f"file://{tmp_path}")
    engine.create_topic("t", 2)
    rows = [(1, 0, "t", 0, b"a"), (1, 1, "t", 0, b"b"), (2, 2, "t", 0, b"c"), (3, 3, "t", 1, b"d"), (4, 4, "t", 9, b"e")]
    acks = {r["request_id"]: (r["base_offset"], r["record_count"], r["code"]) for r in engine.produce(spark.createDataFrame(rows, BATCH), ["seq"]).collect()}
    assert acks == {1: (0, 2, None), 2: (2, 1, None), 3: (0, 1, None), 4: (None, None, 10)}
    plan = engine.table.records("t", 0, 1)._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "partition" in plan.split("PartitionFilters")[1].split("]")[0] and "GreaterThanOrEqual(offset,1)" in plan
    # A batch that was cut short before its commit is not there, for queries and streams, and is written over.
    (tmp_path / "data/log/batch=0").rename(tmp_path / "data/staging/batch=0")
    assert engine.table.records().count() == 0 and engine.table.segments().count() == 0
    engine.produce(spark.createDataFrame(rows[:1], BATCH), ["seq"])
    assert engine.table.records().count() == 1
    seen: list[int] = []
    stream = consume.stream_log(spark, f"file://{tmp_path}/data/log")
    consume.consume(stream, "g", f"{tmp_path}/position", lambda batch, _: seen.extend(r["offset"] for r in batch.collect()), table=engine.table).awaitTermination()
    assert seen == [0]


def test_compaction_and_retention_are_carried_out(spark, tmp_path):
    engine = LogEngine(spark, f"file://{tmp_path}", segment_records=2)
    engine.create_topic("t", 1)
    pair = lambda k, v: len(k).to_bytes(4, "big") + k + len(v).to_bytes(4, "big") + v
    said = [pair(b"a", b"1"), pair(b"b", b"1"), pair(b"a", b"2"), b"no key", pair(b"b", b""), pair(b"c", b"1")]
    engine.produce(spark.createDataFrame([(1, i, "t", 0, p) for i, p in enumerate(said)], BATCH), ["seq"])
    result = engine.compact().first()
    assert (result["segments_rewritten"], result["records_in"], result["records_kept"], result["highest_compacted"]) == (2, 3, 2, 2)
    left = [(r["offset"], bytes(r["payload"])) for r in engine.fetch("t", 0, 1).collect()]
    assert left == [(1, said[1]), (2, said[2]), (3, said[3]), (4, said[4]), (5, said[5])]
    assert engine.describe_partition("t", 0).first()["high_watermark"] == 6
    assert engine.compact().count() == 0
    engine.produce(spark.createDataFrame([(2, 9, "t", 0, pair(b"a", b"3"))], BATCH), ["seq"])
    assert engine.fetch("t", 0, 6).count() == 1
    config = RetentionConfig(retention_ms=0)
    assert engine.apply_retention(config, now_ms=10**15, interval_ms=1000).first()["segments_deleted"] == 2
    assert engine.apply_retention(config, now_ms=10**15 + 999, interval_ms=1000).first()["segments_deleted"] == 0
    assert [r["offset"] for r in engine.fetch("t", 0, 6).collect()] == [6]
    assert engine.table.vacuum() == 0 or engine.table.records().count() == 1
