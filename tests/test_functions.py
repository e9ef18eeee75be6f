from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.functions import binary, frames


def test_numbers_and_records(spark):
    rows = spark.createDataFrame([(0, b"hello world"), (2**63 - 1, b""), (7, None)], "offset long, payload binary")
    out = rows.select(binary.encode_record(F.col("offset"), F.col("payload")).alias("r"), binary.record_size(F.col("payload")).alias("n")).collect()
    for (offset, payload), r in zip([(0, b"hello world"), (2**63 - 1, b""), (7, b"")], out, strict=True):
        assert bytes(r["r"]) == len(payload).to_bytes(4, "big") + offset.to_bytes(8, "big") + payload
        assert r["n"] == 12 + len(payload)


def test_unsigned_range_and_short_bytes(spark):
    rows = spark.createDataFrame([(bytes([255] * 8),), (bytes(8),), (b"\1",)], "b binary")
    wide = binary.number_at(F.col("b"), 0, 8)
    assert [tuple(r) for r in rows.select(wide.cast("string"), binary.signed_range(wide)).collect()] == [("18446744073709551615", None), ("0", 0), (None, None)]


def test_key_value_payloads(spark):
    rows = spark.createDataFrame([(b"k", b"v"), (b"k", None), (b"", b"x")], "key binary, value binary")
    made = rows.select(binary.encode_key_value(F.col("key"), F.col("value")).alias("p"))
    back = made.select(binary.decode_key_value(F.col("p")).alias("kv")).select("kv.*")
    assert [(bytes(r["key"]), r["value"] and bytes(r["value"])) for r in back.collect()] == [(b"k", b"v"), (b"k", None), (b"", b"x")]
    cut = made.select(binary.decode_key_value(F.substring("p", F.lit(1), F.lit(6))).alias("kv")).select("kv.key").collect()
    assert [r["key"] for r in cut] == [None, None, None]


def test_small_functions(spark):
    row = spark.range(1).select(
        binary.saturating_minus(F.lit(3).cast("long"), F.lit(5).cast("long")), binary.segment_file_name(F.lit(42).cast("long")),
        binary.fill_payload(F.lit(258), 3), binary.valid_text(F.lit(b"\xff")), binary.valid_text(F.lit("é".encode())),
    ).first()
    assert tuple(row) == (0, "00000000000000000042.log", b"\2\2\2", None, "é")


def test_bad_frames(spark):
    bad = [b"", b"\x63", b"\x02\x00\x01g\x00\x09t", b"\x07\x00\x02\xff\xff", b"\x01\x00\x01t\x00\x00\x00\x01\xff\xff\xff\xff", None]
    out = frames.decode_requests(spark.createDataFrame([(x,) for x in bad], "frame binary"))
    assert [r["code"] for r in out.collect()] == [1, 2, 2, 2, 2, 1]


def test_responses_round_trip(spark):
    one = spark.range(1)
    make = {
        "produce": frames.encode_produce_response(F.lit(9), F.lit(3)),
        "commit": frames.encode_flag_response("commit", F.lit(True)),
        "committed": frames.encode_committed_response(F.lit(5)),
        "error": frames.encode_error_response(F.lit(10), F.lit("nö")),
        "metrics": frames.encode_metrics_response(F.lit("a 1\n")),
    }
    got = {k: frames.decode_responses(one.select(v.alias("frame"))).first() for k, v in make.items()}
    assert all(got[k]["kind"] == k for k in make)
    assert (got["produce"]["base_offset"], got["produce"]["record_count"]) == (9, 3)
    assert got["commit"]["success"] and got["committed"]["offset"] == 5
    assert (got["error"]["code"], got["error"]["message"], got["metrics"]["message"]) == (10, "nö", "a 1\n")
    none = frames.decode_responses(one.select(frames.encode_committed_response(F.lit(None).cast("long")).alias("frame"))).first()
    assert none["kind"] == "committed" and none["offset"] is None
