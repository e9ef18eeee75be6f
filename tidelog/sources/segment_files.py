"""Binary segment and index files: reading them as records and entries, and putting segments together as bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.binary import HEADER, encode_record, number_at, signed_range
from ..operators.log import SEGMENT
from ..operators.sparse_index import ENTRY

#: Records of a file are handed on in groups of about so many bytes.
GROUP_BYTES = 8_000_000


def encode_segments(log: DataFrame) -> DataFrame:
    """(topic, partition, segment_base, content): each segment's records in order as the bytes of its file. Segments have a bounded size."""
    rows = log.select(*SEGMENT, F.struct("offset", encode_record(F.col("offset"), F.col("payload")).alias("r")).alias("row"))
    parts = rows.groupBy(*SEGMENT).agg(F.sort_array(F.collect_list("row")).alias("rows"))
    return parts.select(*SEGMENT, F.aggregate("rows", F.lit(b""), lambda out, x: F.concat(out, x["r"])).alias("content"))


def decode_segments(files: DataFrame, content: str = "content") -> DataFrame:
    """The records of files: the other columns, offset and payload. An incomplete record at the end is left out; null content has none.

    Offsets beyond 2^63 - 1 are an error. A record's place depends on all before it,
    so a task walks through a file's headers; files are dealt to tasks by Spark.
    """
    rest = [c for c in files.columns if c not in (content, "offset", "payload")]
    schema = files.select(*rest, F.lit(0).cast("long").alias("offset"), F.lit(b"").alias("payload")).schema

    def walk(data: bytes) -> Iterator[tuple[int, int, int]]:
        at = 0
        while at + HEADER <= len(data):
            size = int.from_bytes(data[at : at + 4], "big")
            if at + HEADER + size > len(data):
                return
            yield int.from_bytes(data[at + 4 : at + HEADER], "big"), at + HEADER, size
            at += HEADER + size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                data = batch[content][i].as_py() or b""
                row = batch.slice(i, 1)
                offsets, bodies, size = [], [], 0

                def out() -> pa.RecordBatch:
                    same = [row[c].take(pa.array(np.zeros(len(offsets), np.int64))) for c in rest]  # noqa: B023
                    return pa.RecordBatch.from_arrays([*same, pa.array(offsets, pa.int64()), pa.array(bodies, pa.binary())], names=[*rest, "offset", "payload"])  # noqa: B023

                for offset, at, n in walk(data):
                    offsets.append(offset)
                    bodies.append(data[at : at + n])
                    size += n
                    if size >= GROUP_BYTES:
                        yield out()
                        offsets, bodies, size = [], [], 0
                if offsets:
                    yield out()

    return files.select(*rest, content).mapInArrow(run, schema)


def read_segment_files(spark: SparkSession, path: str) -> DataFrame:
    """Records of the .log files below .../topic/partition/, each named by its base: topic, partition, segment_base, offset, payload."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.log").option("recursiveFileLookup", "true").load(path)
    part = lambda k: F.element_at(F.split("path", "/"), k)
    return decode_segments(files.select(part(-3).alias("topic"), part(-2).cast("int").alias("partition"), F.regexp_extract(part(-1), r"^(\d+)\.log$", 1).cast("long").alias("segment_base"), "content"))


def decode_index(files: DataFrame, content: str = "content") -> DataFrame:
    """Entries (offset, position) of index files, by expressions; a file whose size isn't a multiple of 16 has none."""
    n = F.octet_length(content)
    at = F.when((n > 0) & (n % ENTRY == 0), F.sequence(F.lit(0), F.floor(n / ENTRY).cast("int") - 1))
    rows = files.select(*[c for c in files.columns if c != content], content, F.explode(at).alias("_i"))
    value = lambda shift: signed_range(number_at(F.col(content), F.col("_i") * ENTRY + shift, 8))
    return rows.select(*[c for c in files.columns if c != content], value(0).alias("offset"), value(8).alias("position"))
