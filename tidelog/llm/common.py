"""Small helpers that the training-data operators share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A saved table of a few numbers a row is broadcast up to so many rows (some 2 MB).
BROADCAST_ROWS = 20_000
#: Rows of a few numbers that are worth a task of their own, and tasks that are used at least.
TASK_ROWS, LEAST_TASKS = 100_000, 12
#: A list of at most so many 8-byte ids is broadcast (32 MB); a longer one is joined by a shuffle.
BROADCAST_IDS = 4_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a temporary one, but only in local mode."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tidelog-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def table_path(spark: SparkSession, tag: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/tidelog/{tag}-{uuid.uuid4().hex}"


def save(df: DataFrame, tag: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: this cuts the lineage, and survives lost executors."""
    return save_at(df, tag)[0]


def save_at(df: DataFrame, tag: str, rows: int | None = None) -> tuple[DataFrame, str]:
    """As save(), with the table's path, for drop_table(). Where df comes from so many rows, it is written by as many tasks as these are worth."""
    spark = df.sparkSession
    path = table_path(spark, tag)
    df = df if rows is None else df.coalesce(max(LEAST_TASKS, rows // TASK_ROWS))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_table(spark: SparkSession, path: str) -> None:
    """Deletes a table that save_at() wrote and nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Lets go of the broadcasts and shuffle files of queries that nothing reads any more.

    Spark does so when the driver collects its garbage, which a small driver does
    seldom; until then every executor keeps each broadcast, a join's by two columns
    as a page of some tens of MB.
    """
    gc.collect()
    spark._jvm.System.gc()


def shrink(spark: SparkSession) -> None:
    """Has the executors collect their garbage, and so give back what their heaps have grown by, before Python workers need memory beside them.

    A heap that many short queries have grown is mostly garbage, but a JVM keeps it
    until it collects all of it. There are two tasks for each core; where an executor
    gets none of them, its heap stays as it is, and nothing else changes.
    """
    n = 2 * spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).selectExpr("java_method('java.lang.System', 'gc') AS done").collect()


def small(saved: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A saved table, to be broadcast if its rows are counted and few; a larger one is joined by a shuffle."""
    return F.broadcast(saved) if saved.count() <= most else saved


def by_ids(docs: DataFrame, ids: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """Joins docs with a saved list of distinct ids; the list is broadcast only after its size is checked."""
    small = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if small else ids.hint("shuffle_hash"), key, how)


#: What this worker keeps for later tasks, by operator.
_KEPT: dict[str, dict] = {}


def kept(operator: str) -> dict:
    """What this worker keeps for later tasks of an operator."""
    return _KEPT.setdefault(operator, {})


def forget(operator: str | None) -> None:
    """Lets go of what this worker keeps for other operators: a pipeline's stages share their workers."""
    others = [k for k in _KEPT if k != operator]
    for k in others:
        del _KEPT[k]
    if others:
        gc.collect()
        give_back()


def give_back() -> None:
    """Returns to the system what this process has freed."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator], Iterator], operator: str | None = None) -> Callable[[Iterator], Iterator]:
    """A function of batches that at a task's end returns to the system what its Python worker has freed; an idle worker keeps it otherwise.

    At the beginning the worker lets go of what it keeps for others than the operator.
    """

    def tidied(batches: Iterator) -> Iterator:
        forget(operator)
        yield from run(batches)
        give_back()

    return tidied


@contextmanager
def _settings(spark: SparkSession, **values: str) -> Iterator[None]:
    before = {k: spark.conf.get(k) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Meanwhile Python workers get at most so many rows at a time: an executor holds a batch, and what it has grown from, beside its heap."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(key))
    with _settings(spark, **{key: str(rows if before <= 0 else min(rows, before))}):
        yield


@contextmanager
def lean_batches(spark: SparkSession, rows: int, size: int) -> Iterator[None]:
    """As arrow_rows(), and batches end at so many bytes; scans read a quarter of the rows at a time: columns of long texts and sets grow by doubling, in an executor's heap."""
    scan = "spark.sql.parquet.columnarReaderBatchSize"
    with arrow_rows(spark, rows), _settings(spark, **{"spark.sql.execution.arrow.maxBytesPerBatch": str(size), scan: str(min(rows // 4, int(spark.conf.get(scan))))}):
        yield


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone, letter by letter; for short strings."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
