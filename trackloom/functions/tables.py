"""Tables written to the shared folder: they cut lineage, are computed once and survive lost executors."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def work_root(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where the session names none, a local master gets a temporary one; a cluster has no such folder, so that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='trackloom-')}"
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def work_path(spark: SparkSession, label: str) -> str:
    return f"{work_root(spark)}/trackloom-{label}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, path: str, options: dict[str, str] | None = None) -> DataFrame:
    df.write.option("compression", "zstd").options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table_exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    return write_table(df, work_path(df.sparkSession, label))


def release_memory() -> None:
    """Memory that this Python process has freed goes back to the system, of Arrow's pool and, where libc can, of malloc."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


class Scratch:
    """Tables of one computation in the shared folder; they go when its block ends.

    A computation of many small jobs leaves plans, generated classes, shuffles and broadcasts in the driver, which Spark
    gives up only with the objects that name them; so the block's end also collects those.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root, self.count = spark, work_path(spark, label), 0

    def path(self, label: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count}-{label}"

    def table(self, df: DataFrame, label: str) -> DataFrame:
        return write_table(df, self.path(label))

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        gc.collect()
        release_memory()
        self.spark._jvm.System.gc()
