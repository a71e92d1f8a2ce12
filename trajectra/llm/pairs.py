"""Texts of candidate pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def texts_of(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, text), each once, of the given nodes (node) in docs; copies are dropped by each task before they cross the network."""
    once = docs.select("node", "text").groupBy("node").agg(F.first("text").alias("text"))
    return once.join(nodes.select("node").distinct(), "node", "left_semi")


def with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs (a, b, ...) with ta and tb from texts (node, text).

    A node that many pairs share is a skewed join key, which adaptive execution splits.
    """
    side = lambda n: texts.select(F.col("node").alias(n), F.col("text").alias(f"t{n}"))
    return pairs.join(side("a"), "a").join(side("b"), "b")
