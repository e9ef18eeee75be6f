"""Continuous consumption of a log table, and stateful limits on streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.limits import BYTES, WINDOW_MS, rate_step
from ..sources.log_table import LOG_SCHEMA, LogTable


def stream_log(spark: SparkSession, path: str, schema: str = LOG_SCHEMA, max_files: int = 100) -> DataFrame:
    """A log table's records as a stream of its folder log, where only committed batches are; a poll takes at most max_files new files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).option("recursiveFileLookup", "false").parquet(path)


def consume(stream: DataFrame, group: str, checkpoint: str, process: Callable[[DataFrame, int], None], commits_path: str | None = None, once: bool = True, table: LogTable | None = None) -> StreamingQuery:
    """Reads a stream for a group: each micro-batch goes to process(batch, batch_id), then the positions are committed.

    With table, records of segments that were deleted in the meantime are left out
    (their offsets are passed over).

    The checkpoint folder is the group's position: a new start goes on behind the
    last batch that was processed. Commits (group, topic, partition, offset,
    commit_seq) are written to a folder named by the batch, so a batch that is run
    again replaces its own. With once, what is there is read and the query ends.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        process(batch if table is None else table.live(batch), batch_id)
        if commits_path:
            ends = batch.groupBy("topic", "partition").agg((F.max("offset") + 1).alias("offset"))
            ends = ends.select(F.lit(group).alias("group"), "topic", "partition", "offset", F.lit(batch_id).cast("long").alias("commit_seq"))
            ends.write.mode("overwrite").parquet(f"{commits_path}/batch={batch_id}")

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run)
    return (writer.trigger(availableNow=True) if once else writer).start()


def stream_rate_limit(stream: DataFrame, limit: int = BYTES, window_ms: int = WINDOW_MS) -> DataFrame:
    """Adds allowed to a stream of requests (client, seq, t_ms, bytes); the state of a client is its window and what it used.

    Requests of a client must not come earlier than those of batches before; within
    a batch they are put in order of t_ms and seq.
    """
    schema = "client long, seq long, allowed boolean"

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = tuple(state.get) if state.exists else None
        rows = pd.concat(batches).sort_values(["t_ms", "seq"])
        answers = []
        for t, size in zip(rows["t_ms"].tolist(), rows["bytes"].tolist(), strict=True):
            held, fits = rate_step(held, (t, size), limit, window_ms)
            answers.append(fits)
        state.update(held)
        yield pd.DataFrame({"client": key[0], "seq": rows["seq"], "allowed": answers})

    keyed = stream.select(F.col("client").cast("long"), F.col("seq").cast("long"), F.col("t_ms").cast("long"), F.col("bytes").cast("long")).groupBy("client")
    return keyed.applyInPandasWithState(run, schema, "start long, used long", "append", "NoTimeout")
