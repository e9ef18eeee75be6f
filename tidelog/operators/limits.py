"""Rate and concurrency limits over recorded requests.

Both depend on what was accepted before, so a client's requests are read in order,
with a state of two numbers. Spark deals requests by client and sorts them (spilling
if need be); a task streams through its rows and holds one client's state at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes in a window, the window, and fetches in flight.
BYTES, WINDOW_MS, SLOTS = 10 * 1024 * 1024, 1000, 2

State = tuple[int, int]


def rate_step(state: State | None, row: tuple[int, int], limit: int, window_ms: int) -> tuple[State, bool]:
    """The window starts anew at the first request at or after its end; a request that doesn't fit takes nothing."""
    t, size = row
    start, used = state if state is not None else (t, 0)
    if t - start >= window_ms:
        start, used = t, 0
    fits = used + size <= limit
    return (start, used + size * fits), fits


def _stream(rows: DataFrame, client: str, order: list[str], fields: list[str], step: Callable, first: object, result: str) -> DataFrame:
    """Adds a boolean from step(state, fields) over each client's rows in order."""
    rows = rows.drop(result)
    names = rows.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = object(), first
        for batch in batches:
            out = []
            for who, *values in zip(batch[client].tolist(), *[batch[f].tolist() for f in fields], strict=True):
                if who != last:
                    last, state = who, first
                state, answer = step(state, tuple(map(int, values)))
                out.append(answer)
            batch[result] = pd.array(out, "bool")
            yield batch[[*names, result]]

    schema = rows.withColumn(result, F.lit(True)).schema
    return rows.where(F.col(client).isNotNull()).repartition(client).sortWithinPartitions(client, *order).mapInPandas(run, schema)


def rate_limit(requests: DataFrame, limit: int = BYTES, window_ms: int = WINDOW_MS, created_ms: int | None = None) -> DataFrame:
    """Adds allowed to requests (client, seq, t_ms, bytes), none of them null: a fixed window per client that starts at created_ms or the first request."""
    first = None if created_ms is None else (created_ms, 0)
    return _stream(requests, "client", ["t_ms", "seq"], ["t_ms", "bytes"], lambda s, r: rate_step(s, r, limit, window_ms), first, "allowed")


def inflight_limit(requests: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Adds allowed to requests (client, seq, t_ms, duration_ms): at most ``slots`` accepted ones run at a time; a rejected one holds no slot."""

    def step(ends: tuple[int, ...], row: tuple[int, int]) -> tuple[tuple[int, ...], bool]:
        t, duration = row
        running = tuple(e for e in ends if e > t)
        fits = len(running) < slots
        return (*running, t + duration) if fits else running, fits

    return _stream(requests, "client", ["t_ms", "seq"], ["t_ms", "duration_ms"], step, (), "allowed")


def throttle_counts(limited: DataFrame) -> DataFrame:
    """Requests, throttled ones and accepted bytes of each client."""
    return limited.groupBy("client").agg(F.count(F.lit(1)).alias("n_requests"), F.count_if(~F.col("allowed")).alias("n_throttled"), F.sum(F.when(F.col("allowed"), F.col("bytes")).otherwise(0)).alias("bytes_allowed"))
