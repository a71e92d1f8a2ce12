"""Working tables of iterative operators, in the folder that driver and executors share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession


#: Folders of this process that are still there, as far as known.
_made: set[str] = set()


def clear(spark: SparkSession) -> None:
    """Delete the working folders of this process, when nothing that was read from them is needed any more."""
    for root in sorted(_made):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        _made.discard(root)


def folder(spark: SparkSession, name: str) -> str:
    """A folder of its own under spark.checkpoint.dir."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/trajectra-work"
    root = f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.add(root)
    return root


def working(spark: SparkSession, name: str) -> Callable[[DataFrame, str], DataFrame]:
    """keep(df, step): write df once under spark.checkpoint.dir and return the written rows; by: columns whose values get folders of their own."""
    root = folder(spark, name)

    def keep(df: DataFrame, step: str, by: Sequence[str] = ()) -> DataFrame:
        df.write.partitionBy(*by).parquet(f"{root}/{step}")
        return spark.read.schema(df.schema).parquet(f"{root}/{step}")

    return keep
