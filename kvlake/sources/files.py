"""Paths through Hadoop's file systems, so that any store that Spark reads will do."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrameReader, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only a local master, whose tasks are this machine's, may do without."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if not root and known.isDefined():
        root = known.get()
    if not root:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir is not set: a cluster has to name a folder that all its machines share")
        root = "file://" + tempfile.mkdtemp(prefix="kvlake-")
    if not known.isDefined():
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def reader(spark: SparkSession) -> DataFrameReader:
    """A reader of tables that may be LZ4_RAW, as snapshots and runs are.

    Parquet's dictionary filter fetches a dictionary by pieces of 8 KiB, and its LZ4_RAW decompressor
    fails where a piece is not the whole. So that filter is off; statistics, column indexes and Bloom
    filters still skip what a predicate rules out.
    """
    return spark.read.option("parquet.filter.dictionary.enabled", "false")


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def size(spark: SparkSession, path: str) -> int:
    fs, p = _fs(spark, path)
    return fs.getContentSummary(p).getLength()


def versions(spark: SparkSession, root: str, name: str) -> list[int]:
    """Numbers of the whole tables ``<name>-<number>`` below ``root``: those whose write was committed, the newest last."""
    fs, p = _fs(spark, root)
    if not fs.exists(p):
        return []
    found = [s.getPath() for s in fs.listStatus(p) if s.getPath().getName().startswith(name + "-")]
    return sorted(int(x.getName().rsplit("-", 1)[1]) for x in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS")))
