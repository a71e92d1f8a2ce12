"""Approximate nearest neighbours by cosine: multiprobe hashing with p-stable projections.

Vectors are scaled to unit length, so that the largest cosine is the least Euclidean distance. A
table hashes a vector by M functions floor((a . x + b) / w), a normal. A query visits, in each of
L tables, its own bucket and then T - 1 buckets whose hash values are perturbed by one, in the order
of their estimated success: sets of the query's nearest edges by the expected sum of their squared
distances. Candidates of all tables are merged and ranked by exact cosines.

M, L, w and T are chosen on a bounded sample (SAMPLE vectors): the cheapest setting whose recall
among the sample's own neighbours reaches TARGET; where none does, every query is compared with all
vectors. All vectors are indexed, in shards of SHARD vectors with the buckets that each vector is in. A block of QUERIES
queries meets every shard: there, what its buckets hold is merged over all tables first, and then each candidate is
compared once. Shards are of one size however the vectors lie, so no bucket makes a task longer, and a task keeps the best
of its blocks' queries only. Equal vectors are indexed once, with the k + 1 smallest of their ids, which are all that any
query can return. A query that finds fewer than k candidates meets all shards once more, compared with all they hold.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components take no part,
nor do those of another length than the commonest; a null vec_id takes no part; rows that repeat
id and vector count once; rows that share a query's id are its own; equal cosines order by vec_id;
vectors of any length are compared whole; other columns are not looked at, whatever their names; an
empty table returns no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush
from math import fsum, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .common import Scratch, mix

SAMPLE = 4_000
#: Queries of the sample on which settings are compared.
TRIALS = 100
TARGET = 0.95
#: Tables, functions, widths and visits that are tried.
GRID = (2, 4, 8, 16), (2, 4, 8, 12), (0.75, 1.0, 1.5, 2.0), 256
#: Vectors of a shard, queries of a block, and candidate pairs that are gathered at a time.
SHARD, QUERIES, PAIRS = 8_192, 256, 200_000
#: Vectors that may be compared by a product of matrices in the time that one is gathered and compared on its own.
DENSE = 16
#: Costs in vectors compared: of a visit, and of a vector in one more table, shared by the queries.
VISIT, DEAL = 20, 5_000
SEED = 20_240_601


def valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the rows that take part, as doubles."""
    x = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    odd = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    x = x.where(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.coalesce(F.exists("embedding", odd), F.lit(False))
        & F.coalesce(F.exists("embedding", lambda v: v != 0), F.lit(False))
    )
    sizes = x.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    return x.where(F.size("embedding") == (sizes[0]["d"] if sizes else 0))


@lru_cache(maxsize=64)
def perturbations(functions: int, most: int) -> list[tuple[int, ...]]:
    """Sets of edges to cross, as ranks among a query's 2 * functions edges from the nearest on, by expected cost.

    The j-th smallest distance to an edge has a known expectation; ranks r and 2 * functions - 1 - r are
    the two edges of one function, of which one is crossed at most.
    """
    m = functions
    j = np.arange(1, m + 1)
    near = j * (j + 1) / (4 * (m + 1) * (m + 2))
    far = (1 - (m + 1 - j) / (m + 1) + (m + 1 - j) * (m + 2 - j) / (4 * (m + 1) * (m + 2)))
    cost = np.r_[near, far].tolist()
    out, heap = [()], [(cost[0], (0,))]
    while heap and len(out) < most:
        value, chosen = heappop(heap)
        if not any(2 * m - 1 - r in chosen for r in chosen):
            out.append(chosen)
        last = chosen[-1]
        if last + 1 < 2 * m:
            heappush(heap, (value - cost[last] + cost[last + 1], (*chosen[:-1], last + 1)))
            heappush(heap, (value + cost[last + 1], (*chosen, last + 1)))
    return out


class Tables:
    """L hash tables of M functions each, and how many buckets a query visits in each."""

    def __init__(self, dim: int, tables: int, functions: int, width: float, probes: int, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.a = rng.standard_normal((tables, functions, dim))
        self.b = rng.random((tables, functions)) * width
        self.width, self.probes = width, probes
        #: Measured on the sample: recall, and the share of all vectors that a query is compared with, each once.
        self.recall = self.share = 0.0

    def places(self, unit: np.ndarray) -> np.ndarray:
        """(tables, rows, functions): projections in widths; the floor is the hash value."""
        return (np.einsum("tmd,nd->tnm", self.a, unit) + self.b[:, None, :]) / self.width

    @staticmethod
    def key(table: int, codes: np.ndarray) -> np.ndarray:
        h = np.full(codes.shape[:-1], np.uint64(table + 1))
        for m in range(codes.shape[-1]):
            h = mix(h * np.uint64(31) + codes[..., m].astype(np.int64).view(np.uint64))
        return h.view(np.int64)

    def keys(self, places: np.ndarray) -> np.ndarray:
        """(tables, rows): the buckets that vectors at `places` are in."""
        return np.stack([self.key(i, np.floor(p)) for i, p in enumerate(places)])

    @staticmethod
    def sorted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each table, the order of its rows by bucket, and the buckets in that order."""
        order = np.argsort(keys, axis=1, kind="stable")
        return order, np.take_along_axis(keys, order, 1)

    @staticmethod
    def found(visited: list[np.ndarray], held: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """(queries, rows): the candidates of queries that visit buckets (queries, visits) of each table, merged over the tables."""
        mask = np.zeros((len(visited[0]), held[0].shape[1]), bool)
        for seen, order, keys in zip(visited, *held, strict=True):
            low, high = (np.searchsorted(keys, seen.ravel(), side=side) for side in ("left", "right"))
            n = high - low
            row = np.repeat(np.repeat(np.arange(len(seen)), seen.shape[1]), n)
            mask[row, order[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]] = True
        return mask

    def visits(self, place: np.ndarray) -> np.ndarray:
        """(rows, visits, functions): the hash values of the buckets that queries at `place` visit, likeliest first."""
        base = np.floor(place)
        inside, m = place - base, place.shape[-1]
        order = np.argsort(np.concatenate([inside, 1 - inside], axis=1), axis=1, kind="stable")
        sets = perturbations(m, self.probes)
        out = np.repeat(base[:, None, :], len(sets), axis=1)
        for t, chosen in enumerate(sets):
            for r in chosen:
                edge = order[:, r]
                out[np.arange(len(out)), t, edge % m] += np.where(edge < m, -1, 1)
        return out


def fit(sample: np.ndarray, rows: int, k: int = 5) -> Tables | None:
    """The cheapest tables for `rows` unit vectors that reach TARGET on the sample; None if there are none."""
    n, dim = sample.shape
    queries = sample[:TRIALS]
    sims = queries @ sample.T
    sims[np.arange(len(queries)), np.arange(len(queries))] = -np.inf
    k = min(k, n - 1)
    if k < 1:
        return None
    near, best = np.argpartition(-sims, k - 1, axis=1)[:, :k], None
    counts, functions_tried, widths, probes_tried = GRID
    for functions in functions_tried:
        for width in widths:
            t = Tables(dim, counts[-1], functions, width, min(probes_tried, 3**functions))
            places, hit, work = t.places(sample), None, 0.0
            for table in range(counts[-1]):
                keys = t.key(table, np.floor(places[table]))
                values, sizes = np.unique(keys, return_counts=True)
                seen = t.key(table, t.visits(places[table, : len(queries)]))
                at = np.minimum(np.searchsorted(values, seen), len(values) - 1)
                work = work + np.cumsum(np.where(values[at] == seen, sizes[at], 0), axis=1).mean(axis=0) / n
                found = np.logical_or.accumulate(keys[near][:, None, :] == seen[:, :, None], axis=1)
                hit = found if hit is None else hit | found
                if table + 1 in counts:
                    recall = hit.mean(axis=(0, 2))
                    enough = np.flatnonzero(recall >= TARGET)
                    if len(enough):
                        p = int(enough[0])
                        cost = min(work[p], 1.0) * rows + VISIT * (table + 1) * (p + 1) + DEAL * (table + 1)
                        if best is None or cost < best[0]:
                            best = (cost, table + 1, functions, width, p + 1, float(recall[p]), float(work[p]))
    if best is None:
        return None
    t = Tables(dim, *best[1:5])
    t.recall = best[5]
    places = t.places(sample)
    mask = t.found([t.key(i, t.visits(places[i, : len(queries)])) for i in range(len(places))], t.sorted(t.keys(places)))
    t.share = float(mask.mean())
    return t


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cosine(x: np.ndarray, y: np.ndarray) -> float:
    """The cosine in double precision, its sums rounded once."""
    return fsum(x * y) / (sqrt(fsum(x * x)) * sqrt(fsum(y * y)))


_FOUND = "q long, cid long, ids array<long>, score double"


def _shards(classes: DataFrame, tables: Tables | None) -> DataFrame:
    """Shards of at most SHARD vectors: cids, ids, x, and the bucket of each in every table; write them before use."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), SHARD):
                part = batch.iloc[i : i + SHARD]
                x = np.stack(part["embedding"].to_numpy()).astype("<f8")
                keys = tables.keys(tables.places(_unit(x))) if tables else np.empty((0, len(x)), np.int64)
                yield pd.DataFrame({"cids": [part["cid"].to_numpy()], "ids": [part["ids"].tolist()], "x": [x.tobytes()], "keys": [keys.tobytes()]})

    return classes.select("cid", "ids", "embedding").mapInPandas(run, "cids array<long>, ids array<array<long>>, x binary, keys binary")


def _packed(asked: DataFrame) -> DataFrame:
    """Blocks of at most QUERIES queries (cid, embedding): q_uid, q_cids, q_x; write them before use."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), QUERIES):
                part = batch.iloc[i : i + QUERIES]
                x = np.stack(part["embedding"].to_numpy()).astype("<f8")
                yield pd.DataFrame({"q_uid": [uuid.uuid4().hex], "q_cids": [part["cid"].to_numpy()], "q_x": [x.tobytes()]})

    return asked.select("cid", "embedding").mapInPandas(run, "q_uid string, q_cids array<long>, q_x binary")


def _scored(ux: np.ndarray, uy: np.ndarray, mask: np.ndarray | None, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of the k nearest candidates of each query, with all that tie with the last of them about as near."""
    if mask is None or DENSE * int(mask.sum()) >= mask.size:
        sims = ux @ uy.T
        if mask is not None:
            sims[~mask] = -np.inf
    else:
        sims = np.full(mask.shape, -np.inf)
        row, col = np.nonzero(mask)
        for i in range(0, len(row), PAIRS):
            a, b = row[i : i + PAIRS], col[i : i + PAIRS]
            sims[a, b] = np.einsum("ij,ij->i", ux[a], uy[b])
    last = np.partition(sims, -k, axis=1)[:, -k] if sims.shape[1] > k else np.full(len(sims), -2.0)
    return np.nonzero(sims >= np.maximum(last, -2.0)[:, None] - 1e-9)


class _Best:
    """The best candidates of the queries of one block so far."""

    def __init__(self, row, tables: Tables | None, k: int):
        self.uid, self.k, self.found = row.q_uid, k, {int(c): [] for c in row.q_cids}
        self.cids = list(self.found)
        self.x = np.frombuffer(row.q_x, "<f8").reshape(len(self.cids), -1)
        self.unit = _unit(self.x)
        self.visited = [tables.key(i, tables.visits(p)) for i, p in enumerate(tables.places(self.unit))] if tables else None

    def meet(self, shard: _Open) -> None:
        mask = None if self.visited is None else Tables.found(self.visited, shard.held)
        for q, c in zip(*(x.tolist() for x in _scored(self.unit, shard.unit, mask, self.k)), strict=True):
            self.found[self.cids[q]].append((-cosine(self.x[q], shard.x[c]), shard.ids[c][0], int(shard.cids[c]), shard.ids[c]))
        for cid, rows in self.found.items():
            if len(rows) > 4 * self.k:
                self.found[cid] = sorted(rows, key=lambda r: r[:2])[: self.k]

    def rows(self) -> pd.DataFrame:
        out = [(cid, r[2], r[3], -r[0]) for cid, rows in self.found.items() for r in sorted(rows, key=lambda r: r[:2])[: self.k]]
        return pd.DataFrame(out, columns=["q", "cid", "ids", "score"])


class _Open:
    """A shard, opened."""

    def __init__(self, row, tables: Tables | None):
        self.cids, self.ids, self.raw = row.cids, [list(i) for i in row.ids], row.x
        self.x = np.frombuffer(row.x, "<f8").reshape(len(self.cids), -1)
        self.unit = _unit(self.x)
        self.held = tables.sorted(np.frombuffer(row.keys, np.int64).reshape(-1, len(self.cids))) if tables else None


def _met(blocks: DataFrame, shards: DataFrame, tables: Tables | None, k: int) -> DataFrame:
    """The k best candidates of every query in what a task meets; without tables, all vectors are candidates."""

    @common.lean
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best, shard = None, None
        for batch in batches:
            for row in batch.itertuples(index=False):
                if best is None or best.uid != row.q_uid:
                    if best:
                        yield best.rows()
                    best = _Best(row, tables, k)
                if shard is None or shard.raw != row.x:
                    shard = _Open(row, tables)
                best.meet(shard)
        if best:
            yield best.rows()

    return blocks.crossJoin(shards).mapInPandas(run, _FOUND)


def nearest(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """(query_id, rank, vec_id, score) for the queries, whose vec_id is divisible by `every`."""
    scratch = Scratch(vectors.sparkSession, "neighbours")
    rows = valid(vectors).distinct()
    order = Window.partitionBy("embedding").orderBy("vec_id")
    classes = scratch.keep(
        rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k + 1)
        .groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))  # k + 1 ids at most
        .select(F.xxhash64("embedding").alias("cid"), "ids", "embedding"),
        "classes",
    )
    queries = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.xxhash64("embedding").alias("q"))
    asked = classes.join(queries.select(F.col("q").alias("cid")).distinct(), "cid", "left_semi")
    n = classes.count()
    sample = classes.orderBy(F.xxhash64("cid"), "cid").select("embedding").limit(SAMPLE).collect()
    tables = fit(_unit(np.array([r["embedding"] for r in sample])), n, k) if sample else None
    shards = scratch.keep(_shards(classes, tables), "shards")

    def ranked(found: DataFrame) -> DataFrame:
        best = Window.partitionBy("q").orderBy(F.desc("score"), F.col("ids")[0])
        once = found.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k + 1)  # a vector is in one shard
        return once.select("q", "score", "ids")

    tasks = common.partitions(vectors.sparkSession)
    dealt = lambda queries, name: scratch.keep(_packed(queries.repartition(tasks, "cid")), name)
    top = scratch.keep(ranked(_met(dealt(asked, "asked"), shards, tables, k + 1)), "top")
    if tables:
        have = top.groupBy("q").agg(F.sum(F.size("ids")).alias("_have")).where(F.col("_have") > k).select(F.col("q").alias("cid"))
        short = scratch.keep(asked.join(have, "cid", "left_anti"), "short")
        if short.limit(1).count():
            rest = ranked(_met(dealt(short, "asked-again"), shards, None, k + 1))
            top = top.join(have.withColumnRenamed("cid", "q"), "q", "left_semi").unionByName(rest)
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        queries.join(top, "q").select("query_id", "score", F.explode("ids").alias("vec_id"))
        .where("vec_id <> query_id").withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
