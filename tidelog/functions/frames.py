"""Captured request and response frames as columns: one tag byte, then big-endian fields and length-prefixed strings.

Requests become typed columns by expressions alone; a field that isn't in a
request is null, and a frame that can't be read has a reason in ``error``. Lists in
a frame (records, topics) are walked by a fold over as many steps as the frame says.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .binary import MAX_RECORD, big_endian, number_at, signed_range, valid_text

#: Tags of requests; those of responses are the same, but for error and pong.
TAGS = {"produce": 1, "fetch": 2, "commit": 3, "committed": 4, "create_topic": 5, "list_topics": 6, "describe_topic": 7, "describe_partition": 8, "metrics": 9, "ping": 255}
ERROR_TAG = 254


def _text(value: Column) -> Column:
    body = F.encode(value, "UTF-8")
    return F.concat(big_endian(F.octet_length(body), 2), body)


def _tag(value: int) -> Column:
    return F.lit(bytes([value]))


def _records(records: Column) -> Column:
    one = lambda out, r: F.concat(out, big_endian(F.octet_length(r), 4), r)
    return F.concat(big_endian(F.size(records), 4), F.aggregate(records, F.lit(b""), one))


def encode_request(verb: Column) -> Column:
    """A frame's body from columns verb, group, topic, partition, offset, max_bytes, partition_count and records; null for an unknown verb."""
    c = F.col
    where = F.concat(_text(c("topic")), big_endian(c("partition"), 4))
    forms = {
        "produce": F.concat(where, _records(c("records"))),
        "fetch": F.concat(_text(c("group")), where, big_endian(c("offset"), 8), big_endian(c("max_bytes"), 4)),
        "commit": F.concat(_text(c("group")), where, big_endian(c("offset"), 8)),
        "committed": F.concat(_text(c("group")), where),
        "create_topic": F.concat(_text(c("topic")), big_endian(c("partition_count"), 4)),
        "describe_topic": _text(c("topic")),
        "describe_partition": where,
    }
    out = F.lit(None).cast("binary")
    for name, tag in TAGS.items():
        out = F.when(verb == name, F.concat(_tag(tag), forms[name]) if name in forms else _tag(tag)).otherwise(out)
    return out


def _walk(frame: Column, start: Column, count: Column) -> Column:
    """ARRAY<BINARY> of ``count`` byte strings with 4-byte lengths; null if the frame ends before."""
    # A count beyond the frame's size can't be right; it is cut there, so that no huge sequence is made.
    steps = F.sequence(F.lit(1), F.least(count, F.octet_length(frame)))
    first = F.struct(start.alias("at"), F.array().cast("array<binary>").alias("out"))

    def step(s: Column, _: Column) -> Column:
        n = number_at(frame, s["at"], 4).try_cast("int")
        whole = s["at"] + 4 + n <= F.octet_length(frame)
        item = F.substring(frame, s["at"] + 5, n)
        return F.struct(F.when(whole, s["at"] + 4 + n).alias("at"), F.when(whole, F.array_append(s["out"], item)).alias("out"))

    return F.when(count == 0, F.array().cast("array<binary>")).otherwise(F.aggregate(steps, first, step)["out"])


def decode_requests(frames: DataFrame, frame: str = "frame") -> DataFrame:
    """Adds verb, group, topic, partition, offset, max_bytes, partition_count, records and error to captured frame bodies.

    Empty frames, unknown tags, strings that aren't UTF-8, numbers beyond 2^63 - 1
    and frames that end early have an error and code 2; frames over 10 MiB or
    empty ones code 1. Columns of frames with one of the new names are replaced.
    """
    f = F.col(frame)
    names = F.create_map(*[F.lit(x) for name, tag in TAGS.items() for x in (tag, name)])
    verb = F.element_at(names, number_at(f, 0, 1).try_cast("int"))
    has_group, has_topic = verb.isin("fetch", "commit", "committed"), ~verb.isin("list_topics", "metrics", "ping")
    group_size = F.when(has_group, number_at(f, 1, 2).try_cast("int"))
    topic_at = F.when(has_group, group_size + 3).otherwise(F.when(has_topic, F.lit(1)))
    topic_size = number_at(f, topic_at, 2).try_cast("int")
    rest = topic_at + 2 + topic_size
    bytes_of = lambda at, n: F.when(F.octet_length(f) >= at + n, F.substring(f, at + 1, n))
    out = frames.select(
        *[c for c in frames.columns if c not in ("verb", "group", "topic", "partition", "offset", "max_bytes", "partition_count", "records", "error", "code")],
        verb.alias("verb"),
        valid_text(bytes_of(F.lit(3), group_size)).alias("group"),
        valid_text(bytes_of(topic_at + 2, topic_size)).alias("topic"),
        F.when(verb.isin("produce", "fetch", "commit", "committed", "describe_partition"), signed_range(number_at(f, rest, 4))).alias("partition"),
        F.when(verb.isin("fetch", "commit"), signed_range(number_at(f, rest + 4, 8))).alias("offset"),
        F.when(verb == "fetch", signed_range(number_at(f, rest + 12, 4))).alias("max_bytes"),
        F.when(verb == "create_topic", signed_range(number_at(f, rest, 4))).alias("partition_count"),
        F.when(verb == "produce", _walk(f, rest + 8, number_at(f, rest + 4, 4).try_cast("int"))).alias("records"),
    )
    need = {"produce": "records", "fetch": "max_bytes", "commit": "offset", "committed": "partition", "create_topic": "partition_count", "describe_topic": "topic", "describe_partition": "partition"}
    short = F.lit(False)
    for name, column in need.items():
        short = short | ((F.col("verb") == name) & (F.col(column).isNull() | F.col("topic").isNull()))
    short = short | (has_missing_group := F.col("verb").isin("fetch", "commit", "committed") & F.col("group").isNull())
    size = F.coalesce(F.octet_length(f), F.lit(0))
    error = F.when(size == 0, "empty frame").when(size > MAX_RECORD, "frame too large").when(F.col("verb").isNull(), "unknown request").when(has_missing_group, "no group").when(short, "frame ends early or isn't valid")
    return out.withColumn("error", error).withColumn("code", F.when((size == 0) | (size > MAX_RECORD), 1).when(F.col("error").isNotNull(), 2))


def encode_fetch_response(records: Column, next_offset: Column) -> Column:
    return F.concat(_tag(TAGS["fetch"]), _records(records), big_endian(next_offset, 8))


def encode_produce_response(base_offset: Column, record_count: Column) -> Column:
    return F.concat(_tag(TAGS["produce"]), big_endian(base_offset, 8), big_endian(record_count, 4))


def encode_flag_response(verb: str, success: Column) -> Column:
    """The answer to commit and create_topic."""
    return F.concat(_tag(TAGS[verb]), F.when(success, _tag(1)).otherwise(_tag(0)))


def encode_committed_response(offset: Column) -> Column:
    return F.concat(_tag(TAGS["committed"]), F.when(offset.isNull(), _tag(0)).otherwise(F.concat(_tag(1), big_endian(offset, 8))))


def encode_error_response(code: Column, message: Column) -> Column:
    return F.concat(_tag(ERROR_TAG), big_endian(code, 2), _text(message))


def encode_metrics_response(text: Column) -> Column:
    body = F.encode(text, "UTF-8")
    return F.concat(_tag(TAGS["metrics"]), big_endian(F.octet_length(body), 4), body)


def encode_topics_response(topics: Column) -> Column:
    """topics: ARRAY<STRUCT<name, partition_count>>."""
    one = lambda out, t: F.concat(out, _text(t["name"]), big_endian(t["partition_count"], 4))
    return F.concat(_tag(TAGS["list_topics"]), big_endian(F.size(topics), 4), F.aggregate(topics, F.lit(b""), one))


def encode_topic_response(topic: Column, partitions: Column) -> Column:
    """partitions: ARRAY<STRUCT<partition, high_watermark>>."""
    one = lambda out, p: F.concat(out, big_endian(p["partition"], 4), big_endian(p["high_watermark"], 8))
    count = big_endian(F.size(partitions), 4)
    return F.concat(_tag(TAGS["describe_topic"]), _text(topic), count, count, F.aggregate(partitions, F.lit(b""), one))


def encode_partition_response(topic: Column, partition: Column, high_watermark: Column) -> Column:
    return F.concat(_tag(TAGS["describe_partition"]), _text(topic), big_endian(partition, 4), big_endian(high_watermark, 8))


def decode_responses(frames: DataFrame, frame: str = "frame") -> DataFrame:
    """Adds kind, base_offset, record_count, records, next_offset, success, offset, code and message to response bodies; what a kind lacks is null."""
    f = F.col(frame)
    tag = number_at(f, 0, 1).try_cast("int")
    names = F.create_map(*[F.lit(x) for name, t in [*TAGS.items(), ("error", ERROR_TAG)] for x in (t, name)])
    long = lambda at, width: signed_range(number_at(f, at, width))
    count = number_at(f, 1, 4).try_cast("int")
    flag = number_at(f, 1, 1)
    size = number_at(f, 3, 2).try_cast("int")
    new = {
        "kind": F.element_at(names, tag),
        "base_offset": F.when(tag == 1, long(1, 8)),
        "record_count": F.when(tag == 1, long(9, 4)).when(tag.isin(2, 6), long(1, 4)),
        "records": F.when(tag == 2, _walk(f, F.lit(5), count)),
        "next_offset": F.when(tag == 2, long(F.octet_length(f) - 8, 8)),
        "success": F.when(tag == 3, flag != 0).when(tag == 5, flag == 1),
        "offset": F.when((tag == 4) & (flag != 0), long(2, 8)),
        "code": F.when(tag == ERROR_TAG, long(1, 2)),
        "message": F.when(tag == ERROR_TAG, valid_text(F.substring(f, F.lit(6), size))).when(tag == 9, valid_text(F.substring(f, F.lit(6), count))),
    }
    return frames.select(*[c for c in frames.columns if c not in new], *[v.alias(k) for k, v in new.items()])
