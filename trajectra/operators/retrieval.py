"""Retrieval of tools and texts for batches of queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text


#: Rows of a block of vectors.
BLOCK = 1_024


def _packed(rows: DataFrame, name: str, kind: str, label: str) -> DataFrame:
    """Blocks of at most BLOCK rows: their names as an array, and their vectors as one matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, BLOCK):
                part = whole.slice(i, BLOCK)
                x = part.column(1).flatten().to_numpy().astype("<f8")
                names = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
                yield pa.RecordBatch.from_arrays([names, pa.array([x.tobytes()], pa.binary())], names=[label, f"{label}_x"])

    return rows.where("vec IS NOT NULL").select(name, F.col("vec").cast("array<double>").alias("vec")).mapInArrow(run, f"{label} array<{kind}>, {label}_x binary")


def similarities(queries: DataFrame, vectors: DataFrame, size: int | None = None) -> DataFrame:
    """(query_id, tool, sim) of every query and tool; with `size`, at least of each query's `size` most similar tools.

    Blocks of queries meet blocks of tools, and a pair of blocks is one matrix product; what cannot be among a
    query's best of a block does not leave it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                q, v = batch["q"][r].values, batch["v"][r].values
                x, y = (np.frombuffer(batch[c][r].as_py(), "<f8").reshape(len(n), -1) for c, n in (("q_x", q), ("v_x", v)))
                sims = x @ y.T
                if size is not None and 0 < size < len(v):
                    # ties are settled on rounded values, so what is a little below the last stays, too
                    i, j = np.nonzero(sims >= np.partition(sims, -size, axis=1)[:, -size, None] - 1e-8)
                else:
                    i, j = (g.ravel() for g in np.indices(sims.shape))
                for a in range(0, len(i), 200_000):
                    m, n = i[a : a + 200_000], j[a : a + 200_000]
                    yield pa.RecordBatch.from_arrays([q.take(pa.array(m)), v.take(pa.array(n)), pa.array(sims[m, n])], names=["query_id", "tool", "sim"])

    spark = queries.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = queries.select("query_id", "vec").repartition(tasks, "query_id")
    pairs = _packed(dealt, "query_id", "bigint", "q").crossJoin(_packed(vectors.select("tool", "vec"), "tool", "string", "v"))
    return pairs.mapInArrow(run, "query_id long, tool string, sim double")


def blocks_met(a: DataFrame, b: DataFrame, run: Callable, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """(src, dst, score) of what run(names, matrix, names, matrix) gives for each block of a (tool, vec) with each of b.

    Blocks are written first, so Spark knows their size when it chooses how to bring them together; run gives lists of
    names and scores, some at a time.
    """

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                names = [batch[c][r].as_py() for c in "ab"]
                x, y = (np.frombuffer(batch[f"{c}_x"][r].as_py(), "<f8").reshape(len(n), -1) for c, n in zip("ab", names, strict=True))
                for src, dst, score in run(names[0], x, names[1], y):
                    yield pa.RecordBatch.from_arrays([pa.array(src, pa.string()), pa.array(dst, pa.string()), pa.array(score, pa.float64())], names=["src", "dst", "score"])

    left = keep(_packed(a.select("tool", "vec"), "tool", "string", "a"), "blocks-a")
    right = keep(_packed(b.select("tool", "vec"), "tool", "string", "b"), "blocks-b")
    return left.crossJoin(right).mapInArrow(met, "src string, dst string, score double")


def largest(queries: DataFrame, size: Column) -> int:
    """The largest value of an expression over the queries; 0 without any."""
    return queries.agg(F.max(size)).first()[0] or 0


def ranked(scored: DataFrame, by: str = "sim", name: str = "tool") -> DataFrame:
    """Adds rank from 0 by falling score; ties by name."""
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round(by, 9)), name)
    return scored.withColumn("rank", F.row_number().over(w) - 1)


def top_k(queries: DataFrame, vectors: DataFrame, k: int | None = None) -> DataFrame:
    """(query_id, rank, tool, sim): the k nearest tools, or as many as the query's own k."""
    found = ranked(similarities(queries, vectors, largest(queries, F.col("k")) if k is None else k))
    if k is not None:
        return found.where(F.col("rank") < k).select("query_id", "rank", "tool", "sim")
    return found.join(queries.select("query_id", "k"), "query_id").where("rank < k").select("query_id", "rank", "tool", "sim")


def bm25(queries: DataFrame, docs: DataFrame, k: int = 3, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(item_id, rank, doc_id, score): each query's k best texts; a repeated query term counts again.

    Only terms that a query holds are joined, so the postings that meet are those of query terms.
    """
    tokens = docs.where("text IS NOT NULL").select("doc_id", text.tokens(F.col("text")).alias("_t"))
    asked = queries.select("item_id", F.explode(text.tokens(F.col("text"))).alias("term")).groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("qf"))
    length = tokens.select("doc_id", F.size("_t").alias("dl"))
    stats = length.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    words = tokens.select("doc_id", F.size("_t").alias("dl"), F.explode("_t").alias("term"))
    # only terms that a query holds are counted
    words = words.join(asked.select("term").distinct(), "term", "left_semi")
    tf = words.groupBy("doc_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = df.crossJoin(stats).select("term", "avgdl", F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"))
    share = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    weight = tf.join(idf, "term").select("term", "doc_id", (F.col("idf") * share).alias("w"))
    hits = asked.join(weight, "term").groupBy("item_id", "doc_id").agg(F.sum(F.col("qf") * F.col("w")).alias("score"))
    w = Window.partitionBy("item_id").orderBy(F.desc(F.round("score", 9)), "doc_id")
    return hits.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < k).select("item_id", "rank", "doc_id", "score")


def most_frequent(queries: DataFrame, frequency: DataFrame) -> DataFrame:
    """(query_id, rank, tool): the most frequent tools for every query, as many as its k."""
    longest = queries.agg(F.max("k")).first()[0] or 0
    top = frequency.orderBy(F.desc("frequency"), "tool").limit(longest)
    numbered = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("frequency"), "tool")) - 1)
    return queries.select("query_id", "k").join(numbered.select("rank", "tool"), F.col("rank") < F.col("k")).select("query_id", "rank", "tool")


def hashed_tfidf(docs: DataFrame, dims: int = 256):
    """A fitted pipeline that encodes `text` as a unit vector `vec`: hashed terms by inverse document frequency."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer

    stages = [
        RegexTokenizer(inputCol="text", outputCol="_w", pattern=r"\s+"), HashingTF(inputCol="_w", outputCol="_tf", numFeatures=dims),
        IDF(inputCol="_tf", outputCol="_idf"), Normalizer(inputCol="_idf", outputCol="vec"),
    ]
    return Pipeline(stages=stages).fit(docs.where("text IS NOT NULL"))
