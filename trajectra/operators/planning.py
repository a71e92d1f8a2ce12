"""Planning: which tools, in which order, for batches of queries.

A query's candidates are ranked from 0 by similarity. Greedy planners keep one row a query: an
array of candidates, each with the links that reach it from the others, by their ranks; the steps
are folds over that array, so a plan takes one shuffle whatever its length. Ties go to the better
rank, which breaks its own ties by name.
"""

from __future__ import annotations

import heapq
import random
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores
from ..sources import tables
from . import graph, retrieval

#: Edges of a graph that a best-first search may hold in a task.
MAX_EDGES = 5_000_000


def candidates(queries: DataFrame, vectors: DataFrame, size: Column) -> DataFrame:
    """(query_id, tool, sim, rank, k): the best `size` tools (an expression over k) of each query."""
    q = queries.select("query_id", "vec", "k", size.alias("_size"))
    found = retrieval.ranked(retrieval.similarities(q, vectors, retrieval.largest(q, F.col("_size"))))
    return found.join(q.select("query_id", "k", "_size"), "query_id").where("rank < _size").select("query_id", "tool", "sim", "rank", "k")


def own_tools(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """(query_id, tool, sim, rank, k): the distinct tools of each query's truth, ranked among themselves."""
    tools = queries.select("query_id", "vec", "k", F.explode(F.array_distinct("truth")).alias("tool"))
    found = tools.join(vectors.select("tool", F.col("vec").alias("_v")), "tool").withColumn("sim", scores.dot(F.col("vec"), F.col("_v")))
    return retrieval.ranked(found).select("query_id", "tool", "sim", "rank", "k")


def linked(cands: DataFrame, links: DataFrame, positions: DataFrame | None = None) -> DataFrame:
    """One row a query: (query_id, k, c), c an array by rank of structs (rank, tool, sim, pos, into).

    links is (src, dst, w); into[i] is the link from the candidate of rank i, 0 without one.
    """
    a = cands.select("query_id", F.col("rank").alias("_ra"), F.col("tool").alias("src"))
    b = cands.select("query_id", F.col("rank").alias("_rb"), F.col("tool").alias("dst"))
    found = (
        a.join(b, "query_id").join(links.select("src", "dst", "w"), ["src", "dst"])
        .groupBy("query_id", F.col("_rb").alias("rank")).agg(F.map_from_entries(F.collect_list(F.struct("_ra", "w"))).alias("_m"))
    )
    if positions is None:
        cands = cands.withColumn("pos", F.lit(0.5))
    else:
        cands = cands.join(positions.select("tool", F.col("avg_pos").alias("pos")), "tool", "left").withColumn("pos", F.coalesce("pos", F.lit(0.5)))
    sized = cands.join(found, ["query_id", "rank"], "left").withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("query_id")))
    into = F.transform(F.sequence(F.lit(0), (F.col("_n") - 1).cast("int")), lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0.0)))
    rows = sized.select("query_id", "k", F.struct("rank", "tool", "sim", "pos", into.alias("into")).alias("_c"))
    return rows.groupBy("query_id", "k").agg(F.array_sort(F.collect_list("_c")).alias("c"))


def greedy(rows: DataFrame, score: Callable[[Column, Column], Column], steps: Column, start: Column | None = None) -> DataFrame:
    """(query_id, ranks): each step adds the candidate c with the greatest score(c, ranks so far)."""
    c = F.col("c")
    start = F.array(F.lit(0)) if start is None else start

    def step(acc: Column, _: Column) -> Column:
        left = F.filter(c, lambda x: ~F.array_contains(acc, x["rank"]))
        best = F.array_min(F.transform(left, lambda x: F.struct((-F.round(score(x, acc), 9)).alias("s"), x["rank"].alias("r"))))
        return F.when(F.size(left) > 0, F.concat(acc, F.array(best["r"]))).otherwise(acc)

    todo = F.filter(F.sequence(F.lit(1), F.greatest(steps, F.lit(1))), lambda i: i <= steps)
    return rows.select("query_id", "k", "c", F.aggregate(todo, start, step).alias("ranks"))


def named(rows: DataFrame) -> DataFrame:
    """(query_id, seq) of (query_id, c, ranks)."""
    return rows.select("query_id", F.transform("ranks", lambda r: F.get("c", r)["tool"]).alias("seq"))


def steps_of(plans: DataFrame, value: str = "seq") -> DataFrame:
    """(query_id, step, tool)."""
    return plans.select("query_id", F.posexplode(value).alias("step", "tool"))


_last = lambda acc: F.get(acc, F.size(acc) - 1)
_strongest = lambda x, acc: F.coalesce(F.array_max(F.transform(acc, lambda r: F.get(x["into"], r))), F.lit(0.0))


def _adjacency(edges: DataFrame, weight: str) -> dict[str, list[tuple[str, float]]]:
    """The links of each tool, for the tasks; a graph beyond MAX_EDGES edges is refused."""
    rows = edges.select("src", "dst", F.col(weight).alias("w")).limit(MAX_EDGES + 1).collect()
    if len(rows) > MAX_EDGES:
        raise ValueError(f"this planner takes a graph of at most {MAX_EDGES} edges; prune it, or use beam()")
    found: dict[str, list[tuple[str, float]]] = defaultdict(list)
    for r in rows:
        found[r["src"]].append((r["dst"], r["w"]))
    return dict(found)


def grow(sims: dict[str, float], adjacency: dict, k: int, alpha: float) -> list[str]:
    """The most similar tool, then k - 1 times the best of all others; ties by similarity, then by name."""
    order = sorted(sims, key=lambda t: (-round(sims[t], 9), t))
    rank = {t: i for i, t in enumerate(order)}
    own = np.array([sims[t] for t in order])
    strongest, chosen = np.zeros(len(order)), []
    left = np.ones(len(order), bool)
    while len(chosen) < min(k, len(order)):
        score = alpha * strongest + (1 - alpha) * own if chosen else own
        best = int(np.where(left, np.round(score, 9), -np.inf).argmax())
        left[best] = False
        chosen.append(order[best])
        for to, w in adjacency.get(order[best], ()):
            if to in rank:
                strongest[rank[to]] = max(strongest[rank[to]], w)
    return chosen


def select_greedy(queries: DataFrame, vectors: DataFrame, tp: DataFrame, alpha: float = 0.5) -> DataFrame:
    """k tools: the most similar one, then of all others by alpha * the strongest link from any chosen one + (1 - alpha) * similarity."""
    adjacency = _adjacency(tp, "w")
    per = (
        retrieval.similarities(queries, vectors).groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("tool", "sim"))).alias("sims"))
        .join(queries.select("query_id", "k"), "query_id").select("query_id", "k", "sims")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(q, grow(dict(s), adjacency, int(k), alpha)) for q, k, s in zip(batch["query_id"], batch["k"], batch["sims"], strict=True)]
            yield pd.DataFrame(out, columns=["query_id", "seq"])

    return per.mapInPandas(run, "query_id long, seq array<string>")


def hybrid(
    queries: DataFrame, vectors: DataFrame, edges: DataFrame, positions: DataFrame, alpha: float = 0.5, gamma: float = 0.1,
    multiple: int = 3, bridges: bool = True, normalise: bool = False, keep: Callable | None = None,
) -> DataFrame:
    """k tools from max(k + 2, multiple * k) candidates, with bridges between their components.

    A step scores alpha * weight from the last tool (a reverse edge counts half) + (1 - alpha) * similarity
    + gamma * nearness to the tool's mean position. normalise scales links and similarities of a
    query to 0..1 first, as fits learned scores.
    """
    cands = candidates(queries, vectors, F.greatest(F.col("k") + 2, multiple * F.col("k")))
    if bridges:
        cands = with_bridges(cands, edges, queries, vectors, keep)
    both = edges.select("src", "dst", F.col("weight").alias("w")).unionByName(
        edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("weight") * 0.5).alias("w"))
        .join(edges.select("src", "dst"), ["src", "dst"], "left_anti")
    )
    if normalise:
        cands = scaled(cands, "sim", ["query_id"])
        both = scaled(both, "w", ["src"])
    rows = linked(cands, both, positions)

    def score(x: Column, acc: Column) -> Column:
        at = F.size(acc) / F.greatest(F.lit(1), F.col("k") - 1)
        return alpha * F.get(x["into"], _last(acc)) + (1 - alpha) * x["sim"] + gamma * scores.position_score(x["pos"], at)

    return named(greedy(rows, score, F.col("k") - 1))


def scaled(rows: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """The column scaled to 0..1 within the keys; 0.5 where all agree."""
    w = Window.partitionBy(*keys)
    return rows.withColumn(column, scores.min_max(F.col(column), F.min(column).over(w), F.max(column).over(w)))


def with_bridges(cands: DataFrame, edges: DataFrame, queries: DataFrame, vectors: DataFrame, keep: Callable | None = None) -> DataFrame:
    """Candidates and the inner tools of shortest paths between the best tools of successive components.

    keep(df, name) writes a round of labels and reads it back; without it, rounds are checkpointed.
    """
    keep = keep or (lambda df, _: df.checkpoint())
    cands = keep(cands, "candidates")
    inside = (
        cands.select("query_id", F.col("tool").alias("src")).join(edges.select("src", "dst"), "src")
        .join(cands.select("query_id", F.col("tool").alias("dst")), ["query_id", "dst"])
    )
    both = inside.select("query_id", "src", "dst").unionByName(inside.select("query_id", F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    both = keep(both, "links")
    labels, i = cands.select("query_id", "tool", F.col("rank").alias("comp")), 0
    while True:
        near = both.join(labels.withColumnRenamed("tool", "dst"), ["query_id", "dst"]).groupBy("query_id", F.col("src").alias("tool")).agg(F.min("comp").alias("_m"))
        now = labels.join(near, ["query_id", "tool"], "left").select("query_id", "tool", F.least("comp", F.coalesce("_m", "comp")).alias("comp"))
        now = keep(now, f"labels-{i}")
        changed = now.join(labels, ["query_id", "tool", "comp"], "left_anti").limit(1).count()
        labels, i = now, i + 1
        if not changed:
            break
    comps = labels.join(cands.select("query_id", "tool", "rank"), ["query_id", "tool"])
    best = comps.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "comp").orderBy("rank"))).where("_n <= 3")
    order = best.select("query_id", "comp").distinct().withColumn("_next", F.lead("comp").over(Window.partitionBy("query_id").orderBy("comp"))).where("_next IS NOT NULL")
    ends = (
        order.join(best.select("query_id", "comp", F.col("tool").alias("src"), F.col("rank").alias("_ra")), ["query_id", "comp"])
        .join(best.select("query_id", F.col("comp").alias("_next"), F.col("tool").alias("dst"), F.col("rank").alias("_rb")), ["query_id", "_next"])
    )
    ends = keep(ends, "ends")
    paths = graph.paths_between(edges, ends.select("src", "dst").distinct(), keep)
    first = ends.join(paths, ["src", "dst"]).groupBy("query_id", "comp").agg(F.min_by("path", F.struct("_ra", "_rb")).alias("path"))
    inner = first.select("query_id", F.explode(F.slice("path", 2, F.greatest(F.size("path") - 2, F.lit(0)))).alias("tool")).distinct()
    extra = inner.join(cands.select("query_id", "tool"), ["query_id", "tool"], "left_anti")
    scored = (
        extra.join(queries.select("query_id", "vec", "k"), "query_id").join(vectors.select("tool", F.col("vec").alias("_v")), "tool")
        .select("query_id", "tool", scores.dot(F.col("vec"), F.col("_v")).alias("sim"), "k")
    )
    pool = cands.select("query_id", "tool", "sim", "k").unionByName(scored)
    return retrieval.ranked(pool).select("query_id", "tool", "sim", "rank", "k")


def beam(
    queries: DataFrame, vectors: DataFrame, edges: DataFrame, target: int = 4, width: int = 5, entries: int = 5, neighbours: int = 30,
    weights: tuple[float, float, float] = (0.4, 0.4, 0.2), floor: float = 0.05, plans: int = 3, normalise: bool = False,
) -> DataFrame:
    """(query_id, rank, seq, score): the best plans of a level-wise beam search, by mean step score.

    A step scores transition probability, similarity and the share of the path outside the next
    tool's community. A beam is complete at `target` tools, or when no step reaches `floor`.
    """
    wt, ws, wd = weights
    nbr = graph.top_neighbours(edges, neighbours).select(F.col("src").alias("_cur"), F.col("dst").alias("_to"), "transition_prob")
    comm = vectors.select(F.col("tool").alias("_to"), "community")
    reached, asked = vectors.select(F.col("tool").alias("_to"), F.col("vec").alias("_v"), "community"), queries.select("query_id", "vec")
    start = retrieval.top_k(queries, vectors, min(entries, width)).join(comm.withColumnRenamed("_to", "tool"), "tool")
    live = start.select("query_id", F.array("tool").alias("path"), F.array("community").alias("comms"), F.col("sim").alias("cum"))
    done = None
    for _ in range(target - 1):
        grown = (
            live.withColumn("_cur", _last(F.col("path"))).join(asked, "query_id").join(nbr, "_cur").where(~F.array_contains("path", F.col("_to")))
            .join(reached, "_to").withColumn("sim", scores.dot(F.col("vec"), F.col("_v"))).drop("vec", "_v")
        )
        if normalise:
            grown = scaled(scaled(grown, "transition_prob", ["query_id", "path"]), "sim", ["query_id", "path"])
        same = F.size(F.filter("comms", lambda c: c == F.col("community")))
        grown = grown.withColumn("_s", wt * F.col("transition_prob") + ws * F.col("sim") + wd * (1 - same / F.size("path")))
        best = grown.groupBy("query_id", "path").agg(F.max("_s").alias("_best"))
        ended = live.join(best, ["query_id", "path"], "left").where(F.coalesce("_best", F.lit(0.0)) < floor).select("query_id", "path", "cum")
        done = ended if done is None else done.unionByName(ended)
        nxt = grown.select(
            "query_id", F.concat("path", F.array("_to")).alias("path"), F.concat("comms", F.array("community")).alias("comms"),
            (F.col("cum") + F.col("_s")).alias("cum"),
        )
        w = Window.partitionBy("query_id").orderBy(F.desc(F.round("cum", 9)), "path")
        live = nxt.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= width).drop("_n")
    final = done.unionByName(live.select("query_id", "path", "cum")).groupBy("query_id", "path").agg(F.max(F.col("cum") / F.size("path")).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "path")
    ranked = final.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < plans)
    return ranked.select("query_id", "rank", F.col("path").alias("seq"), "score")


def hierarchical(queries: DataFrame, vectors: DataFrame, centroids: DataFrame, meta: DataFrame, positions: DataFrame, target: int = 4) -> DataFrame:
    """(query_id, step, tool, sim): members of the best community, then of its neighbours in the meta-graph (all others if
    it has none) by their centroids' similarity, `target` in all, in the order of their mean positions."""
    q = queries.select("query_id", F.posexplode("vec").alias("dim", "x"))
    comm = q.join(centroids, "dim").groupBy("query_id", "community").agg(F.sum(F.col("x").cast("double") * F.col("value")).alias("csim"))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("csim", 9)), "community")
    comm = comm.withColumn("crank", F.row_number().over(w) - 1)
    near = meta.select(F.col("c1").alias("a"), F.col("c2").alias("b")).unionByName(meta.select(F.col("c2").alias("a"), F.col("c1").alias("b")))
    best = comm.where("crank = 0").select("query_id", F.col("community").alias("a"))
    has = near.select("a").distinct().withColumn("_has", F.lit(True))
    allowed = (
        comm.join(best.join(has, "a", "left"), "query_id").join(near.withColumnRenamed("b", "community").withColumn("_near", F.lit(True)), ["a", "community"], "left")
        .where((F.col("crank") == 0) | F.col("_near").isNotNull() | F.col("_has").isNull())
    )
    sims = retrieval.similarities(queries, vectors).join(vectors.select("tool", "community"), "tool")
    pool = sims.join(allowed.select("query_id", "community", "crank"), ["query_id", "community"])
    order = Window.partitionBy("query_id").orderBy("crank", F.desc(F.round("sim", 9)), "tool")
    chosen = pool.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= target)
    placed = chosen.join(positions.select("tool", "avg_pos"), "tool", "left")
    at = Window.partitionBy("query_id").orderBy(F.round(F.coalesce("avg_pos", F.lit(0.5)), 9), "tool")
    return placed.select("query_id", (F.row_number().over(at) - 1).alias("step"), "tool", "sim")


def step_costs(adjacency: dict, eps: float = 1e-6) -> dict:
    """The links of each tool with what a step along them costs, before the tool reached is looked at."""
    return {t: [(to, 1 / (w + eps)) for to, w in out] for t, out in adjacency.items()}


def search(adjacency: dict, sims: dict, entries: list[str], target: int, max_steps: int = 8, beta: float = 0.3, eps: float = 1e-6, low: float = 0.05, window: int = 3, expansions: int = 1500, costs: dict | None = None) -> list[str]:
    """Best-first search from each entry: the frontier by path cost, the choice by mean similarity; equal costs by path.

    Of each length the path with the best mean similarity is kept; the length nearest to the target
    that there is, in the order target, +1, -1, +2, -2, +3, is returned for the best entry.
    """
    costs = costs or step_costs(adjacency, eps)
    far = {t: beta * (1 - s) for t, s in sims.items()}
    plans = []
    for entry in entries:
        heap, seen, known, best, n = [(0.0, (entry,))], set(), {}, {}, 0
        while heap and n < expansions:
            cost, path = heapq.heappop(heap)
            if path[-1] in seen:
                continue
            seen.add(path[-1])
            n += 1
            near = [sims.get(t, 0.0) for t in path]
            mean = sum(near) / len(near)
            if mean > best.get(len(path), (-2.0,))[0]:
                best[len(path)] = (mean, path)
            if len(path) >= max_steps or (len(near) >= window and max(near[-window:]) < low):
                continue
            for to, c in costs.get(path[-1], ()):
                if to not in seen:
                    longer = cost + c + far.get(to, beta)
                    if longer <= known.get(to, np.inf):  # one that costs more would never be settled
                        known[to] = longer
                        heapq.heappush(heap, (longer, (*path, to)))
        lengths = [target, target + 1, target - 1, target + 2, target - 2, target + 3]
        length = next((x for x in lengths if x in best), max(best, key=lambda x: best[x][0]))
        plans.append(best[length])
    return list(max(plans, key=lambda p: p[0])[1]) if plans else []


def best_first(
    queries: DataFrame, vectors: DataFrame, edges: DataFrame, target: int = 4, entries: int = 5, expansions: int = 1500,
    keep: Callable | None = None, most: int = MAX_EDGES,
) -> DataFrame:
    """(query_id, seq): `search` from each query's best entries.

    A graph of up to `most` edges goes to the tasks, where a query is one call; a larger one is searched in rounds of
    joins, with the same plans. keep(df, name) writes a round and reads it back.
    """
    if edges.limit(most + 1).count() > most:
        return best_first_rounds(queries, vectors, edges, keep or (lambda df, _: df.checkpoint()), target, entries, expansions)
    adjacency = _adjacency(edges, "weight")
    costs = step_costs(adjacency)
    per = _ranked_tools(queries, vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for query_id, order, sims in _one_by_one(batches):
            seq = search(adjacency, dict(zip(order, sims, strict=True)), order[:entries], target, expansions=expansions, costs=costs)
            yield pa.RecordBatch.from_pydict({"query_id": [query_id], "seq": [seq]}, schema=made)

    made = pa.schema([("query_id", pa.int64()), ("seq", pa.list_(pa.string()))])
    return per.mapInArrow(run, "query_id long, seq array<string>")


def _ranked_tools(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """(query_id, tools, sims): all tools of each query, the most similar first; small rows, long work: spread whatever their size."""
    per = retrieval.ranked(retrieval.similarities(queries, vectors)).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "tool", "sim"))).alias("c"))
    tasks = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return per.select("query_id", F.col("c.tool").alias("tools"), F.col("c.sim").alias("sims")).repartition(tasks, "query_id")


def _one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of Arrow batches as Python values, of which there is one at a time."""
    for batch in batches:
        for r in range(batch.num_rows):
            yield tuple(c[r].as_py() for c in batch.columns)


def best_first_rounds(
    queries: DataFrame, vectors: DataFrame, edges: DataFrame, keep: Callable[[DataFrame, str], DataFrame], target: int = 4, entries: int = 5,
    expansions: int = 1500, max_steps: int = 8, beta: float = 0.3, eps: float = 1e-6, low: float = 0.05, window: int = 3,
) -> DataFrame:
    """`search` for a graph of any size: (query_id, seq).

    The heap of `search` settles a tool by its cheapest path over tools settled and expanded before it. Here every round
    makes all tools' paths anew from the paths of the round before, for all queries and entries at once, and keeps the
    `expansions` cheapest; as steps cost more than nothing and paths end at max_steps, this comes to rest at the paths
    that the heap settles.
    """
    near = retrieval.top_k(queries, vectors, entries)
    asked = queries.select("query_id", "vec")
    state = "query_id", F.col("rank").alias("entry"), "tool", F.lit(0.0).alias("cost"), F.array("tool").alias("path"), F.array("sim").alias("sims")
    start = keep(near.select(*state), "entries")
    hop = edges.select(F.col("src").alias("tool"), F.col("dst").alias("_to"), (1 / (F.col("weight") + eps)).alias("_c"))
    reached = vectors.select(F.col("tool").alias("_to"), F.col("vec").alias("_v"))
    order = Window.partitionBy("query_id", "entry").orderBy("cost", "path")
    now, i = start, 0
    while True:
        dull = (F.size("sims") >= window) & (F.array_max(F.slice("sims", -window, window)) < low)
        on = now.where((F.size("path") < max_steps) & ~F.when(F.size("sims") >= window, dull).otherwise(False))
        grown = on.join(hop, "tool").join(asked, "query_id").join(reached, "_to", "left").withColumn("_s", F.coalesce(scores.dot(F.col("vec"), F.col("_v")), F.lit(0.0)))
        grown = grown.select(
            "query_id", "entry", F.col("_to").alias("tool"), (F.col("cost") + F.col("_c") + beta * (1 - F.col("_s"))).alias("cost"),
            F.concat("path", F.array("_to")).alias("path"), F.concat("sims", F.array("_s")).alias("sims"),
        )
        best = start.unionByName(grown).groupBy("query_id", "entry", "tool").agg(F.min(F.struct("cost", "path", "sims")).alias("b")).select("query_id", "entry", "tool", "b.*")
        kept = keep(best.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= expansions).drop("_n"), f"round-{i}")
        columns = ["query_id", "entry", "tool", "cost", "path"]
        same = not kept.join(now, columns, "left_anti").limit(1).count() and not now.join(kept, columns, "left_anti").limit(1).count()
        now, i = kept, i + 1
        if same:
            break
    mean = F.aggregate("sims", F.lit(0.0), lambda a, x: a + x) / F.size("sims")
    of_length = now.groupBy("query_id", "entry", F.size("path").alias("n")).agg(F.min(F.struct((-mean).alias("m"), "cost", "path")).alias("b"))
    # the length nearest to the target, in search's order; without one of those, the best mean
    wanted = F.array(*[F.lit(target + x) for x in (0, 1, -1, 2, -2, 3)])
    place = F.array_position(wanted, F.col("n"))
    choice = F.struct(F.when(place > 0, place).otherwise(F.lit(99)).alias("p"), F.when(place > 0, F.lit(0.0)).otherwise(F.col("b.m")).alias("m"), F.col("b.cost").alias("c"), F.col("b.path").alias("path"), F.col("b.m").alias("mean"))
    plans = of_length.groupBy("query_id", "entry").agg(F.min(choice).alias("x"))
    best = plans.groupBy("query_id").agg(F.min(F.struct("x.mean", "entry", "x.path")).alias("y")).select("query_id", F.col("y.path").alias("seq"))
    return queries.select("query_id").join(best, "query_id", "left").select("query_id", F.coalesce("seq", F.array().cast("array<string>")).alias("seq"))


def random_graph(edges: DataFrame, keep: Callable[[DataFrame, str], DataFrame], seed: str = "42") -> DataFrame:
    """A graph with the same tools, as many edges, drawn from all pairs of them, and weights of 1."""
    tools = tables.numbered(graph.degrees(edges).select("tool"), "tool", keep)
    return graph.drawn_pairs(tools, edges.count(), keep, seed).withColumn("weight", F.lit(1.0))


def with_fallback(plans: DataFrame, queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """Queries without a plan take their most similar tools."""
    top = retrieval.top_k(queries, vectors).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "tool"))).alias("_s"))
    return top.join(plans, "query_id", "left").select(
        "query_id", F.coalesce("seq", F.transform("_s", lambda x: x["tool"])).alias("seq"), F.col("seq").isNull().alias("fallback")
    )


def by_learned(queries: DataFrame, vectors: DataFrame, learned: DataFrame, target: int = 4, times: int = 3) -> DataFrame:
    """(query_id, seq): of the `times` * target most similar tools, from the best one on, the one with the greatest learned score."""
    links = learned.select("src", "dst", F.col("weight").alias("w"))
    rows = linked(candidates(queries, vectors, F.lit(max(target + 2, times * target))), links)
    return named(greedy(rows, lambda x, acc: F.get(x["into"], _last(acc)), F.lit(target - 1)))


def plan(method: str, **inputs) -> DataFrame:
    """One planner by name: best_first (dijkstra), beam, hierarchical (hier), hybrid or greedy."""
    named_as = {"dijkstra": best_first, "best_first": best_first, "beam": beam, "hierarchical": hierarchical, "hier": hierarchical, "hybrid": hybrid, "greedy": select_greedy}
    if method not in named_as:
        raise ValueError(f"no planner named {method!r}")
    return named_as[method](**inputs)


def beam_of(order: list[str], sims: dict, near: dict, community: dict, target: int = 4, width: int = 5, entries: int = 5, weights: tuple = (0.4, 0.4, 0.2), floor: float = 0.05) -> list[str]:
    """The best plan of `beam` for one query; near has the strongest links (to, transition probability) of each tool."""
    wt, ws, wd = weights
    live = [((t,), sims[t]) for t in order[: min(entries, width)]]
    done: dict[tuple, float] = {}
    for _ in range(target - 1):
        grown = []
        for path, cum in live:
            kinds, best = [community[t] for t in path], 0.0
            for to, p in near.get(path[-1], ()):
                if to in sims and to not in path:
                    step = wt * p + ws * sims[to] + wd * (1 - kinds.count(community[to]) / len(path))
                    best = max(best, step)
                    grown.append(((*path, to), cum + step))
            if best < floor:
                done[path] = max(done.get(path, -np.inf), cum / len(path))
        live = sorted(grown, key=lambda x: (-round(x[1], 9), x[0]))[:width]
    for path, cum in live:
        done[path] = max(done.get(path, -np.inf), cum / len(path))
    return list(min(done, key=lambda p: (-round(done[p], 9), p))) if done else []


def hybrid_of(order: list[str], sims: dict, links: dict, at: dict, k: int, multiple: int = 3, alpha: float = 0.5, gamma: float = 0.1) -> list[str]:
    """The plan of `hybrid` without bridges for one query; links has the weights by source and target, a reverse one counts half."""
    left = order[: max(k + 2, multiple * k)]
    chosen = [left.pop(0)] if left else []
    while left and len(chosen) < k:
        place, last = len(chosen) / max(1, k - 1), chosen[-1]

        def score(t: str) -> float:
            link = links.get(last, {}).get(t)  # noqa: B023
            link = links.get(t, {}).get(last, 0.0) * 0.5 if link is None else link  # noqa: B023
            return round(alpha * link + (1 - alpha) * sims[t] + gamma * max(0.0, 1.0 - abs(at.get(t, 0.5) - place)), 9)  # noqa: B023

        best = max(range(len(left)), key=lambda i: (score(left[i]), -i))
        chosen.append(left.pop(best))
    return chosen


#: Values that the parameter search goes through.
BEST_FIRST_GRID = {"beta": (0.1, 0.2, 0.3, 0.4, 0.5), "entries": (3, 5, 8, 10)}
BEAM_GRID = {"wt": (0.2, 0.3, 0.4, 0.5), "ws": (0.3, 0.4, 0.5, 0.6), "width": (3, 5, 8, 10)}
HYBRID_GRID = {"multiple": (2, 3, 4), "alpha": (0.3, 0.4, 0.5, 0.6, 0.7), "gamma": (0.0, 0.05, 0.1, 0.15, 0.2)}


def settings(trials: int = 100, seed: int = 42) -> list[tuple[str, dict]]:
    """(method, parameters) of the three grids; of a grid with more than `trials` settings, that many drawn by the seed."""
    beams = []
    for wt, ws, width in product(*BEAM_GRID.values()):
        wd = round(1 - wt - ws, 3)
        if wd >= 0.05:
            beams.append({"weights": (wt, ws, wd), "width": width})
    grids = {
        "best_first": [dict(zip(BEST_FIRST_GRID, x, strict=True)) for x in product(*BEST_FIRST_GRID.values())], "beam": beams,
        "hybrid": [dict(zip(HYBRID_GRID, x, strict=True)) for x in product(*HYBRID_GRID.values())],
    }
    rng = random.Random(seed)
    return [(m, x) for m, grid in grids.items() for x in (grid if len(grid) <= trials else [grid[i] for i in sorted(rng.sample(range(len(grid)), trials))])]


def shown_setting(parameters: dict) -> str:
    return " ".join(f"{k}={'/'.join(f'{x:g}' for x in v) if isinstance(v, tuple) else f'{v:g}'}" for k, v in parameters.items())


def plans_of_settings(queries: DataFrame, vectors: DataFrame, edges: DataFrame, positions: DataFrame, tried: list[tuple[str, dict]], target: int = 4, neighbours: int = 30) -> DataFrame:
    """(query_id, method, setting, seq): every query's plan by every setting, in one pass over the different vectors.

    A vector's similarities are ranked once and serve all settings and queries with it; only the hybrid planner looks at a
    query's k. The graph goes to the tasks, up to MAX_EDGES edges.
    """
    whole = _adjacency(edges, "weight")
    links = {src: dict(out) for src, out in whole.items()}
    best = graph.top_neighbours(edges, neighbours)
    near, strongest = _adjacency(best, "transition_prob"), _adjacency(best, "weight")
    costs = step_costs(strongest)
    at = {r["tool"]: r["avg_pos"] for r in positions.toLocalIterator()} if positions is not None else {}
    community = {r["tool"]: r["community"] for r in vectors.select("tool", "community").toLocalIterator()}
    # the first query of each vector, and of each vector and k, with the queries that they stand for
    same_k = queries.groupBy("vec", "k").agg(F.collect_list("query_id").alias("ids"))
    asked = same_k.groupBy("vec").agg(F.min(F.array_min("ids")).alias("query_id"), F.collect_list(F.struct("k", "ids")).alias("ks"))
    ranked = _ranked_tools(asked, vectors).join(asked.select("query_id", "ks"), "query_id").select("query_id", "ks", "tools", "sims")
    tasks = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    made = pa.schema([("query_id", pa.int64()), ("method", pa.string()), ("setting", pa.string()), ("seq", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ks, order, values in _one_by_one(batches):
            sims, searched, out = dict(zip(order, values, strict=True)), {}, []
            for method, x in tried:
                if method == "hybrid":
                    found = [(hybrid_of(order, sims, links, at, int(same["k"]), **x), same["ids"]) for same in ks]
                elif method == "beam":
                    seq = beam_of(order, sims, near, community, target, **x)
                    found = [(seq, same["ids"]) for same in ks]
                else:
                    if x["beta"] not in searched:  # each entry's own plan serves all numbers of entries
                        most = max(y["entries"] for m, y in tried if m == "best_first" and y["beta"] == x["beta"])
                        searched[x["beta"]] = [search(strongest, sims, [e], target, beta=x["beta"], costs=costs) for e in order[:most]]
                    mean = lambda p: sum(sims.get(t, 0.0) for t in p) / len(p)  # noqa: E731, B023
                    seq = max(searched[x["beta"]][: x["entries"]], key=mean, default=[])
                    found = [(seq, same["ids"]) for same in ks]
                out += [(i, method, shown_setting(x), seq) for seq, ids in found for i in ids]
            columns = zip(*out, strict=True) if out else ([],) * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, made, strict=True)], schema=made)

    return ranked.repartition(4 * tasks, "query_id").mapInArrow(run, "query_id long, method string, setting string, seq array<string>")
