"""What the operators share: tables kept in the folder that driver and executors share, and names that no input takes.

``spark.checkpoint.dir`` names the folder; only a local master may do without one.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache, wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files

WORD = r"[^\x20\x09-\x0D]+"
#: Paths and catalog tables that this process has made, for ``remove_written``.
_made: list[str] = []
_tables: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    path = files.scratch(spark, name)
    _made.append(path)
    return path


def named_table(name: str) -> str:
    _tables.append(name)
    return name


def remove_written(spark: SparkSession) -> None:
    """Removes all that the operators have kept so far. Results that have not been read or stored by then are lost."""
    while _tables:
        spark.sql(f"DROP TABLE IF EXISTS {_tables.pop()}")
    while _made:
        remove(spark, _made.pop())


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores after it as it takes to be no column of the DataFrame."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


def own(df: DataFrame, *without: str) -> list[Column]:
    """The DataFrame's columns by name, without those named."""
    gone = {c.lower() for c in without}
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns if c.lower() not in gone]


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """The rows, written to the shared folder and read again: lineage ends here and an executor's loss costs nothing."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of what has been written and is no longer referred to."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@lru_cache(maxsize=1)
def _trim():
    """The C library's call that returns freed memory, where it has one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return lambda pad: 0


def give_back() -> None:
    """Returns what this process has freed to the machine. Python workers are kept between tasks, and else so is their largest task's memory."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def lean(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function of ``mapInArrow``, whose worker gives its memory back when a task ends."""

    @wraps(f)
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            give_back()

    return of


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Arrow batches of so many rows while a job over long texts runs: a batch's bytes bound a Python worker's memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def words_in(text: Column) -> Column:
    """How many maximal runs without ASCII white space a text has; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def plan_bytes(df: DataFrame) -> int:
    """The planner's estimate of a DataFrame's bytes; sizes layouts only, never results."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
