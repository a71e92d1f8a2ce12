"""The event-sequence relations on the driver's tables: steps of tasks, vectors of tools, queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(task_id, pos, tool, category): one task an order, one step a line item."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"
    )
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    kind = F.lower("p_type")
    return lines.join(part, lines.l_partkey == part.p_partkey).select(
        F.col("l_orderkey").alias("task_id"), (F.row_number().over(order) - 1).alias("pos"),
        F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_for_"), kind).alias("tool"), kind.alias("category"),
    )


def event_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(task_id, pos, tool, category): one task a user and day, one step an event."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "props")
    task = F.concat_ws("_", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMdd"))
    kind = F.concat(F.lit("k"), (F.get_json_object("props", "$.k").cast("int") % 10).cast("string"))
    e = e.withColumn("task_id", task).withColumn("category", kind)
    order = Window.partitionBy("task_id").orderBy("ts", "event_id")
    return e.select(
        "task_id", (F.row_number().over(order) - 1).alias("pos"),
        F.concat("event_type", F.lit("_for_"), "category").alias("tool"), "category",
    )


def sequences(steps: DataFrame) -> DataFrame:
    """(task_id, seq, num_steps): the steps of each task in order."""
    found = steps.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("pos", "tool"))).alias("_s"))
    return found.select("task_id", F.transform("_s", lambda x: x["tool"]).alias("seq"), F.size("_s").alias("num_steps"))


def numbered(names: DataFrame, key: str, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """(key, n): the distinct names, numbered from 0 in ascending order.

    They are numbered by ranges, so no task of Spark's sees them all; keep(df, name) writes the ranges once.
    """
    dealt = keep(names.select(key).distinct().repartitionByRange(key).withColumn("_part", F.spark_partition_id()), f"numbered-{key}")
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # one row a range
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(key)).cast("long") - 1
    return dealt.withColumn("_place", place).join(F.broadcast(before), "_part").select(key, (F.col("_before") + F.col("_place")).alias("n"))


def tool_vectors(steps: DataFrame, embeddings: DataFrame, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """(tool, vec, community): the n-th tool by name has the vector of n modulo their number; its label is the community."""
    total = embeddings.agg(F.count(F.lit(1)).alias("_vectors"))  # one row
    tools = numbered(steps.select("tool"), "tool", keep).crossJoin(total).withColumn("vec_id", F.expr("n % _vectors"))
    e = embeddings.select("vec_id", F.col("embedding").alias("vec"), F.col("label").alias("community"))
    return tools.join(e, "vec_id").select("tool", "vec", "community")


def queries(steps: DataFrame, embeddings: DataFrame, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """(query_id, task_id, vec, truth, k): every task, the n-th with the vector of n modulo their number."""
    return queries_of(sequences(steps), embeddings, keep)


def queries_of(seqs: DataFrame, embeddings: DataFrame, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """The same of the tasks' sequences."""
    tasks = numbered(seqs.select("task_id"), "task_id", keep).withColumnRenamed("n", "query_id")
    total = embeddings.agg(F.count(F.lit(1)).alias("_vectors"))  # one row
    e = embeddings.select("vec_id", F.col("embedding").alias("vec"))
    return (
        tasks.crossJoin(total).withColumn("vec_id", F.expr("query_id % _vectors")).join(e, "vec_id").join(seqs.hint("merge"), "task_id")
        .select("query_id", "task_id", "vec", F.col("seq").alias("truth"), F.greatest("num_steps", F.lit(3)).alias("k"))
    )
