"""Shared plumbing of the corpus operators: working tables and text helpers."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    A local session without that setting, as in tests, gets a folder under its warehouse.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/trajectra-work"
    return found.rstrip("/")


class Scratch:
    """Working tables of one operator call, in a folder of its own under the shared one."""

    #: Folders of this process that are still there, as far as known.
    made: set[str] = set()

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        Scratch.made.add(self.root)

    def keep(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        """Write df once and return the written rows; this cuts lineage and survives lost executors."""
        df.write.options(**options).parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        """Delete working tables that no later plan reads."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        gc.collect()
        jvm.System.gc()  # lets Spark delete the shuffle files of plans that are no longer held

    def close(self) -> None:
        """Delete the whole folder; results that read it must have been written or collected before."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        Scratch.made.discard(self.root)

    @classmethod
    def close_all(cls, spark: SparkSession) -> None:
        """Delete the folders of all operator calls of this process, when nothing that they returned is read any more."""
        for root in sorted(cls.made):
            scratch = cls.__new__(cls)
            scratch.spark, scratch.root = spark, root
            scratch.close()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_key(text: str = "text") -> F.Column:
    """A 64-bit key of a text; equal texts share it, null counts as empty."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df has not, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while f"_{name}" in taken:
        name += "_"
    return f"_{name}"


def release() -> None:
    """Hand freed memory back to the system; a worker that is used again then holds nothing of the last task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def lean(run):
    """A function of batches that leaves no freed memory behind when a partition ends."""

    @wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers (multiply and xor-shift)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word windows of a hashed word sequence; empty if there are fewer words."""
    if len(h) < k:
        return np.empty(0, np.uint64)
    n, out = len(h) - k + 1, np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + mix(h[i : i + n] + np.uint64(i + 1))
    return mix(out)
