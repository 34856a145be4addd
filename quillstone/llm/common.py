"""Shared parts of the corpus operators: table access, written intermediates, distributed ranks."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a
    temporary one in local mode, where both are one process."""
    if path := spark.conf.get("spark.checkpoint.dir", None):
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="quillstone-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


class Scratch:
    """Intermediate tables of one run, written as Parquet in the shared folder.

    A lost executor costs only its running tasks, as later stages read these files.
    ``drop`` deletes a table that nothing reads any more; what the result still
    needs goes when the driver's JVM ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/quillstone/{label}-{uuid.uuid4().hex}"
        path, fs = self._fs(self.root)
        fs.deleteOnExit(path)

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str, free: bool = False) -> DataFrame:
        """Write a table and read it back. ``free`` has the driver collect its garbage, on
        which Spark deletes the shuffle files that made the table; else those of a whole
        run of steps may lie on the executors' disks together."""
        kind = df.schema
        df.write.option("compression", "zstd").parquet(self.path(name))
        del df  # else the shuffles of a plan that only this call knows are still in use
        if free:
            self.spark.sparkContext._jvm.System.gc()
        return self.spark.read.schema(kind).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            path, fs = self._fs(self.path(name))
            fs.delete(path, True)


@contextmanager
def collector_paused() -> Iterator[None]:
    """No search for cyclic garbage meanwhile: work that fills large tables makes no cycles, and
    every search would go through all that is new in them, again and again."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def utf8(text: Column) -> Column:
    return F.encode(F.coalesce(text, F.lit("")), "UTF-8")


def prefix_counts(df: DataFrame, within: list[str], bucket: str, name: str) -> DataFrame:
    """One row per (within, bucket): how many rows of ``within`` lie in smaller buckets.

    Only the counts meet in a window, never the rows themselves.
    """
    counts = df.groupBy(*within, bucket).agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(*within).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(*within, bucket, F.coalesce(F.sum("__n").over(w), F.lit(0)).cast("long").alias(name))


def zlib_crc32(data: Column) -> Column:
    return F.crc32(data).cast("long")
