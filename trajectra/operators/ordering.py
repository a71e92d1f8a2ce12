"""Re-ordering of selected tools. Input rows are those of planning.linked, output (query_id, seq)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import descent, planning

#: Tools up to which all orders are compared; more are ordered greedily.
CAP = 8


def by_similarity(rows: DataFrame) -> DataFrame:
    return rows.select("query_id", F.transform("c", lambda x: x["tool"]).alias("seq"))


def by_links(rows: DataFrame) -> DataFrame:
    """From the most similar tool on, the strongest link from the last one; ties by rank."""
    score = lambda x, acc: F.get(x["into"], planning._last(acc))
    return planning.named(planning.greedy(rows, score, F.size("c") - 1))


def by_matrix(cands: DataFrame, scored: DataFrame) -> DataFrame:
    """From the most similar candidate (query_id, tool, sim, rank, k) on, the greatest score (src, dst, score) from the last one; ties by rank."""
    links = scored.select("src", "dst", F.col("score").alias("w"))
    score = lambda x, acc: F.get(x["into"], planning._last(acc))
    return planning.named(planning.greedy(planning.linked(cands, links), score, F.size("c") - 1))


def by_strongest(rows: DataFrame, alpha: float = 0.7) -> DataFrame:
    """alpha * the strongest link from any earlier tool + (1 - alpha) * similarity; similarity alone at first."""
    score = lambda x, acc: alpha * planning._strongest(x, acc) + (1 - alpha) * x["sim"]
    return planning.named(planning.greedy(rows, score, F.size("c") - 1))


@lru_cache(maxsize=CAP + 1)
def _orders(n: int) -> np.ndarray:
    return np.array(list(permutations(range(n))), np.int64).reshape(-1, n)


def best_order(into: np.ndarray, sims: np.ndarray, alpha: float | None) -> list[int]:
    """The first best of all orders, in lexicographic order of ranks.

    into[j, i] is the link from i to j. Without alpha an order scores the sum of ln(link + 1e-9);
    with it, alpha * sum of links + (1 - alpha) * sum of similarity / (place from 1).
    """
    orders = _orders(len(sims))
    if len(sims) < 2:
        return list(range(len(sims)))
    links = into[orders[:, 1:], orders[:, :-1]]
    if alpha is None:
        score = np.log(links + 1e-9).sum(axis=1)
    else:
        score = alpha * links.sum(axis=1) + (1 - alpha) * (sims[orders] / np.arange(1, len(sims) + 1)).sum(axis=1)
    return orders[np.round(score, 9).argmax()].tolist()


def by_permutation(rows: DataFrame, alpha: float | None = None) -> DataFrame:
    """The best of all orders of up to CAP tools; more are ordered greedily by the same terms."""

    @F.pandas_udf("array<int>")
    def ordered(c: pd.Series) -> pd.Series:
        return c.map(lambda x: best_order(np.array([list(t["into"]) for t in x]), np.array([t["sim"] for t in x]), alpha) if len(x) <= CAP else None)

    def score(x: Column, acc: Column) -> Column:
        link = F.get(x["into"], planning._last(acc))
        return link if alpha is None else alpha * link + (1 - alpha) * x["sim"] / (F.size(acc) + 1)

    small = rows.where(F.size("c") <= CAP).select("query_id", "c", ordered("c").alias("ranks"))
    large = planning.greedy(rows.where(F.size("c") > CAP), score, F.size("c") - 1)
    return planning.named(small).unionByName(planning.named(large))


FEATURES = ("sim", "rank", "sum_out", "sum_in", "max_out", "max_in", "position", "size")


def features(rows: DataFrame) -> DataFrame:
    """(query_id, rank, tool, and the eight FEATURES of each candidate among its query's)."""
    return rows.select("query_id", F.explode(feature_array(F.col("c"))).alias("f")).select("query_id", "f.*")


def feature_array(c: Column) -> Column:
    """The features of a query's candidates as an array."""
    n = F.size(c)
    return F.transform(
        c,
        lambda x: F.struct(
            x["rank"].alias("rank"), x["tool"].alias("tool"), x["sim"].alias("sim"),
            (x["rank"] / F.greatest(n - 1, F.lit(1))).alias("f_rank"),
            F.aggregate(F.transform(c, lambda y: F.get(y["into"], x["rank"])), F.lit(0.0), lambda a, v: a + v).alias("sum_out"),
            F.aggregate(x["into"], F.lit(0.0), lambda a, v: a + v).alias("sum_in"),
            F.array_max(F.transform(c, lambda y: F.get(y["into"], x["rank"]))).alias("max_out"),
            F.array_max(x["into"]).alias("max_in"), x["pos"].alias("position"), (n / 10).alias("size"),
        ),
    )



def by_pairs(rows: DataFrame, weights: tuple[float, ...], mask: tuple[int, ...] = (1,) * 8) -> DataFrame:
    """(query_id, pos, tool, score): each tool scores the sum over all tools of sigmoid(weights . feature difference)."""
    f = features(rows)
    names = ["sim", "f_rank", *FEATURES[2:]]
    total = sum((F.col(n) * float(w * m) for n, w, m in zip(names, weights, mask, strict=True)), F.lit(0.0))
    v = f.select("query_id", "rank", "tool", total.alias("v"))
    o = v.select("query_id", F.col("v").alias("o"))
    scored = v.join(o, "query_id").groupBy("query_id", "rank", "tool").agg(F.sum(1 / (1 + F.exp(F.col("o") - F.col("v")))).alias("score"))
    from pyspark.sql import Window

    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "rank")
    return scored.select("query_id", (F.row_number().over(w) - 1).alias("pos"), "tool", "score")


def by_net(rows: DataFrame, fitted) -> DataFrame:
    """(query_id, pos, tool, score): each tool scores the sum over all others of the trained net's probability that it comes before them."""
    names = ["sim", "f_rank", *FEATURES[2:]]
    entry = F.struct("rank", "tool", F.array(*[F.col(n).cast("double") for n in names]).alias("x"))
    per = features(rows).groupBy("query_id").agg(F.array_sort(F.collect_list(entry)).alias("c"))  # a query's candidates

    def run(groups: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in groups:
            for query_id, c in group.itertuples(index=False):
                x = np.stack([t["x"] for t in c])
                n = len(x)
                p = descent.sigmoid(fitted.net.logits(fitted.params, (x[:, None] - x[None]).reshape(n * n, -1))[0]).reshape(n, n)
                score = p.sum(axis=1) - np.diag(p)
                order = np.lexsort((np.arange(n), -np.round(score, 9)))
                yield pd.DataFrame({"query_id": query_id, "pos": range(n), "tool": [c[i]["tool"] for i in order], "score": score[order]})

    return per.mapInPandas(run, "query_id long, pos int, tool string, score double")
