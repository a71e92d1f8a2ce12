"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is two joins on node ids and is written to the shared folder; the driver sees one
count and one sum a step. Joins on hot nodes are split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _state(edges: DataFrame) -> tuple:
    h = F.pmod(F.xxhash64("u", "v"), F.lit(2**31))
    return tuple(edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(h), F.lit(0))).first())


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, root) of every node of edges (a, b); the root is the least node of the component."""
    now = scratch.keep(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0"
    )
    state, step = _state(now), 0
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("_m", "u").alias("_m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("_m").alias("v")).distinct()
        root = large.groupBy("u").agg(F.min("v").alias("_m"))
        small = (
            large.join(root, "u").where("v <> _m").select(F.col("v").alias("u"), F.col("_m").alias("v"))
            .unionByName(root.select("u", F.col("_m").alias("v"))).distinct()
        )
        step += 1
        now, before, last = scratch.keep(small, f"{name}-{step}"), state, step - 1
        state = _state(now)
        scratch.drop(f"{name}-{last}")
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
