"""Evaluation: metrics by prediction, roll-ups, resampling and comparisons."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import digests, metrics, text


def measured(predictions: DataFrame, names: dict | None = None) -> DataFrame:
    """Predictions (query_id, method, p, g) with a column for each metric, and bucket."""
    names = metrics.SET_METRICS | metrics.ORDER_METRICS | metrics.LCS_METRICS if names is None else names
    p, g = F.coalesce("p", F.array().cast("array<string>")), F.coalesce("g", F.array().cast("array<string>"))
    base = predictions.withColumns({"p": p, "g": g}).withColumn("bucket", text.length_bucket(F.size("g")))
    return base.select("query_id", "method", "bucket", *[f(F.col("p"), F.col("g")).alias(n) for n, f in names.items()])


def rollup(rows: DataFrame, values: list[str]) -> DataFrame:
    """(method, bucket, n, mean_*, std_*): by method, and by method and bucket (null: all)."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for v in values:
        aggs += [F.avg(v).alias(f"mean_{v}"), F.stddev_samp(v).alias(f"std_{v}")]
    return rows.groupingSets([[F.col("method"), F.col("bucket")], [F.col("method")]], F.col("method"), F.col("bucket")).agg(*aggs)


def means(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.avg(v).alias(v) for v in values])


def shown_means(rows: DataFrame, methods: list[tuple[str, str]], buckets: list[str], values: list[str], places: int = 6) -> DataFrame:
    """(place, label, bucket, n, values): means of the given methods (name, label) in their order, by the buckets in theirs.

    Other methods and buckets are left out; a method without rows in a bucket has n = 0. Values are rounded row by row first.
    """
    spark = rows.sparkSession
    wanted = [(i * len(buckets) + j, m, label, b) for i, (m, label) in enumerate(methods) for j, b in enumerate(buckets)]
    order = spark.createDataFrame(wanted, "place int, method string, label string, bucket string")  # as long as the two lists
    kept = rows.where(F.col("method").isin([m for m, _ in methods]) & F.col("bucket").isin(buckets))
    found = kept.groupBy("method", "bucket").agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.round(v, places)).alias(v) for v in values])
    return F.broadcast(order).join(found, ["method", "bucket"], "left").select("place", "label", "bucket", F.coalesce("n", F.lit(0)).cast("long").alias("n"), *values)


def paired(rows: DataFrame, a: str, b: str, value: str) -> DataFrame:
    """(query_id, delta): method a less method b on the queries that both have."""
    x = rows.where(F.col("method") == a).select("query_id", F.col(value).alias("_x"))
    y = rows.where(F.col("method") == b).select("query_id", F.col(value).alias("_y"))
    return x.join(y, "query_id").select("query_id", (F.col("_x") - F.col("_y")).alias("delta"))


def _draw(*parts: str | Column) -> Column:
    """A number in 0..2**32 - 1 by md5, that any engine can repeat."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(p) for p in parts])), 1, 8), 16, 10).cast("long")


#: How often an item is drawn into a sample of as many items, by chance of 1 in n: bounds of 0, 1, ... in 65,536ths (Poisson, mean 1).
_DRAWN = [int(65536 * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) + 0.5) for k in range(9)]


def bootstrap(deltas: DataFrame, replicates: int = 10_000, seed: str = "42") -> DataFrame:
    """One row: mean difference, its 95 % interval, p = P(resampled mean <= 0), and whether the interval lies above 0.

    Every replicate takes each difference as often as 16 bits of an md5 of the replicate and the query say, so rows are
    resampled where they lie, in one pass: a task adds up one row's md5 after the other into the sums of all replicates.
    """
    chunks = -(-replicates // 8)
    heads = [f"{seed}:{c}:".encode() for c in range(chunks)]
    # times by the 16 bits as they lie in memory, high byte first
    times = np.searchsorted(np.array(_DRAWN), np.arange(65536).astype(">u2").view("<u2"), side="right").astype(float)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, chunks * 8))
        for batch in batches:
            for i in range(0, len(batch), 32):
                keys, x = [k.encode() for k in batch["key"].iloc[i : i + 32]], batch["delta"].iloc[i : i + 32].to_numpy()
                total += np.stack([x, np.ones(len(x))]) @ times.take(digests.md5(heads, keys).view("<u2").reshape(len(x), -1))
        yield pd.DataFrame({"r": range(replicates), "s": total[0, :replicates], "n": total[1, :replicates]})

    tasks = int(deltas.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # small rows, long work: spread whatever their size
    rows = deltas.select(F.col("query_id").cast("string").alias("key"), F.col("delta").cast("double").alias("delta")).repartition(tasks, "key")
    sums = rows.mapInPandas(run, "r long, s double, n double").groupBy("r").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    means_ = sums.where("n > 0").select((F.col("s") / F.col("n")).alias("m"))
    stats = means_.agg(
        F.percentile("m", F.lit(0.025)).alias("lo"), F.percentile("m", F.lit(0.975)).alias("hi"),
        F.avg((F.round("m", 12) <= 0).cast("double")).alias("p_value"),
    )
    return deltas.agg(F.count(F.lit(1)).alias("n"), F.avg("delta").alias("mean_delta")).crossJoin(stats).withColumn("significant", F.round("lo", 12) > 0)


def random_orders(predictions: DataFrame, shuffles: int = 100, seed: str = "42") -> DataFrame:
    """Predictions with their tools in `shuffles` random orders, by md5: (query_id, method, shuffle, p, g)."""
    many = predictions.withColumn("shuffle", F.explode(F.sequence(F.lit(0), F.lit(shuffles - 1))))
    keyed = F.transform(
        "p", lambda t, i: F.struct(F.md5(F.concat_ws(":", F.lit(seed), F.col("shuffle").cast("string"), F.col("query_id").cast("string"), t, i.cast("string"))).alias("h"), t.alias("t"))
    )
    return many.select("query_id", "method", "shuffle", F.transform(F.array_sort(keyed), lambda x: x["t"]).alias("p"), "g")


def random_order_means(predictions: DataFrame, names: dict[str, Callable], shuffles: int = 100, seed: str = "42") -> DataFrame:
    """(shuffle, means): metrics of the order of common names, over the predictions in each of `shuffles` random orders.

    Whatever their order, predictions with fewer than two common names have 0, so they are only counted.
    """
    p, g = F.col("p"), F.col("g")
    two = predictions.where(F.arrays_overlap(p, g)).where(F.size(metrics.common_ranks(p, g)) >= 2)
    rows = random_orders(two, shuffles, seed).select("shuffle", *[f(p, g).alias(n) for n, f in names.items()])
    sums = rows.groupBy("shuffle").agg(*[F.sum(n).alias(n) for n in names])
    total = predictions.agg(F.count(F.lit(1)).alias("_n")).where("_n > 0")  # one row
    every = predictions.sparkSession.range(shuffles).select(F.col("id").cast("int").alias("shuffle"))
    return every.join(sums, "shuffle", "left").crossJoin(total).select("shuffle", *[(F.coalesce(n, F.lit(0.0)) / F.col("_n")).alias(n) for n in names])


def pareto(points: DataFrame, x: str, y: str, key: str) -> DataFrame:
    """Adds on_frontier: no other point is as good in both values and better in one."""
    a, b = points.alias("a"), points.select(F.col(x).alias("_x"), F.col(y).alias("_y")).alias("b")
    better = (F.col("_x") >= F.col(x)) & (F.col("_y") >= F.col(y)) & ((F.col("_x") > F.col(x)) | (F.col("_y") > F.col(y)))
    beaten = a.join(b, better, "left_semi").select(key).withColumn("_b", F.lit(True))
    return points.join(beaten, key, "left").select(*points.columns, F.col("_b").isNull().alias("on_frontier"))


def best_of(rows: DataFrame, grid: str, value: str) -> DataFrame:
    """The grid point with the greatest value; the least of several."""
    return rows.orderBy(F.desc(F.round(value, 9)), grid).limit(1)


def win_loss(deltas: DataFrame) -> DataFrame:
    """One row: wins, losses and ties."""
    d = F.round("delta", 9)
    return deltas.agg(*[F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(n) for n, c in (("wins", d > 0), ("losses", d < 0), ("ties", d == 0))])


def extremes(deltas: DataFrame, n: int = 5) -> DataFrame:
    """The n greatest gains and losses."""
    top = deltas.where("delta > 0").orderBy(F.desc(F.round("delta", 9)), "query_id").limit(n).withColumn("side", F.lit("gain"))
    low = deltas.where("delta < 0").orderBy(F.round("delta", 9), "query_id").limit(n).withColumn("side", F.lit("loss"))
    return top.unionByName(low)


def k_distribution(truths: DataFrame) -> DataFrame:
    """(k, n, order_dependent): truths by length; those shorter than three are cut by order."""
    return truths.groupBy(F.size("truth").alias("k")).agg(F.count(F.lit(1)).alias("n")).withColumn("order_dependent", F.col("k") < 3)


def set_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: queries whose tools differ as sets between two predictions (query_id, seq), or are missing in one."""
    x = a.select("query_id", F.array_sort(F.array_distinct("seq")).alias("_a"))
    y = b.select("query_id", F.array_sort(F.array_distinct("seq")).alias("_b"))
    return x.join(y, "query_id", "full_outer").agg(F.coalesce(F.sum((~F.col("_a").eqNullSafe(F.col("_b"))).cast("long")), F.lit(0)).alias("violations"))


def link_scores(rows: DataFrame, score: str, label: str) -> DataFrame:
    """One row: AUC by rank sums (ties share ranks), average precision, and F1 at 0.5."""
    g = rows.groupBy(F.round(score, 9).alias("s")).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.count(F.lit(1)).alias("n"))
    up, down = Window.orderBy("s"), Window.orderBy(F.desc("s"))
    r = g.withColumn("_before", F.sum("n").over(up) - F.col("n")).withColumn("_tp", F.sum("pos").over(down)).withColumn("_seen", F.sum("n").over(down))
    return r.agg(
        F.sum(F.col("pos") * (F.col("_before") + (F.col("n") + 1) / 2)).alias("_r"), F.sum("pos").alias("_p"), F.sum("n").alias("_n"),
        F.sum(F.col("pos") * F.col("_tp") / F.col("_seen")).alias("_ap"),
        F.sum(F.when(F.col("s") >= 0.5, F.col("pos")).otherwise(0)).alias("_hit"), F.sum(F.when(F.col("s") >= 0.5, F.col("n")).otherwise(0)).alias("_said"),
    ).select(
        F.coalesce(F.try_divide(F.col("_r") - F.col("_p") * (F.col("_p") + 1) / 2, F.col("_p") * (F.col("_n") - F.col("_p"))), F.lit(0.0)).alias("auc"),
        F.coalesce(F.try_divide("_ap", "_p"), F.lit(0.0)).alias("average_precision"),
        F.coalesce(F.try_divide(2 * F.col("_hit"), F.col("_said") + F.col("_p")), F.lit(0.0)).alias("f1"),
    )


def delta_table(rows: DataFrame, old: str, new: str, values: list[str]) -> DataFrame:
    """(metric, old, new, delta): means of two methods, a row for each metric."""
    means_ = rows.where(F.col("method").isin(old, new)).groupBy("method").agg(*[F.avg(v).alias(v) for v in values])
    long = means_.unpivot("method", values, "metric", "value")
    of = lambda m: F.max(F.when(F.col("method") == m, F.col("value")))
    return long.groupBy("metric").agg(of(old).alias("old"), of(new).alias("new")).withColumn("delta", F.col("new") - F.col("old"))


def lengths(predictions: DataFrame) -> DataFrame:
    """(query_id, method, pred_len, gt_len); null arrays count as empty."""
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    return predictions.select("query_id", "method", F.greatest(size("p"), F.lit(0)).alias("pred_len"), F.greatest(size("g"), F.lit(0)).alias("gt_len"))


def matched_names(lists: DataFrame, vocabulary: DataFrame, k: int) -> DataFrame:
    """(key, rank, tool): the first k names of each list (key, names) that the vocabulary (tool) has, whatever their case.

    Of tools that differ in case only, the least is taken.
    """
    known = vocabulary.groupBy(F.lower("tool").alias("_name")).agg(F.min("tool").alias("tool"))
    named = lists.select("key", F.posexplode("names").alias("_at", "_n")).withColumn("_name", F.lower("_n")).join(known, "_name")
    first = named.groupBy("key", "tool").agg(F.min("_at").alias("_at"))
    rank = F.row_number().over(Window.partitionBy("key").orderBy("_at")) - 1
    return first.withColumn("rank", rank).where(F.col("rank") < k).select("key", "rank", "tool")
