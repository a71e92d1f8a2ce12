"""The transition graph: counting, weighting, pruning, fusion, communities and graph measures."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores
from . import retrieval


def transitions(steps: DataFrame, skip_weight: float = 0.5) -> DataFrame:
    """(src, dst, count): 1 for the next tool, skip_weight for the next but one, none to itself."""
    w = Window.partitionBy("task_id").orderBy("pos")
    ahead = steps.select("tool", F.lead("tool", 1).over(w).alias("n1"), F.lead("tool", 2).over(w).alias("n2"))
    links = F.array(F.struct(F.col("n1").alias("dst"), F.lit(1.0).alias("c")), F.struct(F.col("n2").alias("dst"), F.lit(skip_weight).alias("c")))
    pairs = ahead.select(F.col("tool").alias("src"), F.explode(links).alias("l")).select("src", "l.dst", "l.c")
    return pairs.where("dst IS NOT NULL AND src <> dst").groupBy("src", "dst").agg(F.sum("c").alias("count"))


def transitions_of(seqs: DataFrame, skip_weight: float = 0.5) -> DataFrame:
    """The same of sequences (seq), which no task has to bring together again."""
    dst = lambda i, ahead, c: F.struct(F.get("seq", i + ahead).alias("dst"), F.lit(c).alias("c"))
    links = F.transform("seq", lambda t, i: F.struct(t.alias("src"), F.array(dst(i, 1, 1.0), dst(i, 2, skip_weight)).alias("to")))
    pairs = seqs.select(F.explode(links).alias("l")).select("l.src", F.explode("l.to").alias("t")).select("src", "t.dst", "t.c")
    return pairs.where("dst IS NOT NULL AND src <> dst").groupBy("src", "dst").agg(F.sum("c").alias("count"))


def weighted(counts: DataFrame) -> DataFrame:
    """Adds pmi, transition_prob and weight = transition_prob * max(0, pmi)."""
    out = counts.groupBy("src").agg(F.sum("count").alias("_out"))
    into = counts.groupBy("dst").agg(F.sum("count").alias("_in"))
    total = out.agg(F.sum("_out").alias("_z"))
    rows = counts.join(out, "src").join(into, "dst").crossJoin(total)  # one row
    pmi = F.ln(F.col("count") * F.col("_z") / (F.col("_out") * F.col("_in")))
    rows = rows.withColumn("pmi", pmi).withColumn("transition_prob", F.col("count") / F.col("_out"))
    return rows.withColumn("weight", F.col("transition_prob") * F.greatest(F.lit(0.0), "pmi")).select(
        "src", "dst", "count", "pmi", "transition_prob", "weight"
    )


def pruned(edges: DataFrame, least_count: float = 3, least_weight: float = 0.01) -> DataFrame:
    return edges.where((F.col("count") >= least_count) & (F.col("weight") >= least_weight))


def top_neighbours(edges: DataFrame, n: int = 30) -> DataFrame:
    """Each source's n heaviest edges; ties by name."""
    w = Window.partitionBy("src").orderBy(F.desc(F.round("weight", 9)), "dst")
    return edges.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def knn(vectors: DataFrame, keep: Callable[[DataFrame, str], DataFrame], top_k: int = 20) -> DataFrame:
    """(src, dst, sim): each tool's top_k most similar others with a similarity above 0; ties by name.

    Blocks of tools meet as matrix products, and what cannot be among a tool's best of a block does not leave it.
    """

    def nearest(src: list, x: np.ndarray, dst: list, y: np.ndarray) -> Iterator[tuple]:
        sims, size = x @ y.T, top_k + 1  # the tool itself may be one of them
        # ties are settled on rounded values, so what is a little below the last stays, too
        least = np.partition(sims, -size, axis=1)[:, -size, None] - 1e-8 if size < len(dst) else np.zeros((len(src), 1))
        i, j = np.nonzero((sims >= least) & (sims > 0))
        for a in range(0, len(i), 200_000):
            m, n = i[a : a + 200_000], j[a : a + 200_000]
            yield [src[k] for k in m], [dst[k] for k in n], sims[m, n]

    sims = retrieval.blocks_met(vectors, vectors, nearest, keep).where("src <> dst").withColumnRenamed("score", "sim")
    w = Window.partitionBy("src").orderBy(F.desc(F.round("sim", 9)), "dst")
    return sims.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= top_k).drop("_n")


def fused(edges: DataFrame, sims: DataFrame, alpha: float = 0.7, threshold: float = 0.6) -> DataFrame:
    """Statistical edges alpha * scaled weight + (1 - alpha) * similarity; others from similarity alone if it reaches the threshold."""
    limits = edges.agg(F.min("weight").alias("_lo"), F.max("weight").alias("_hi"))
    joined = edges.join(sims, ["src", "dst"], "full_outer").crossJoin(limits)  # one row
    scaled = scores.min_max(F.col("weight"), F.col("_lo"), F.col("_hi"))
    stat = F.col("weight").isNotNull()
    sim = F.coalesce("sim", F.lit(0.0))
    return joined.where(stat | (sim >= threshold)).select(
        "src", "dst", F.coalesce("weight", F.lit(0.0)).alias("w_stat"), sim.alias("w_sem"),
        F.when(stat, alpha * scaled + (1 - alpha) * sim).otherwise((1 - alpha) * sim).alias("w_final"),
        F.when(stat, "statistical").otherwise("semantic").alias("edge_source"),
    )


def active(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes (tool) that some edge touches."""
    ends = edges.select(F.col("src").alias("tool")).unionByName(edges.select(F.col("dst").alias("tool"))).distinct()
    return nodes.join(ends, "tool", "left_semi")


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends in nodes (tool)."""
    src, dst = nodes.select(F.col("tool").alias("src")), nodes.select(F.col("tool").alias("dst"))
    return edges.join(src, "src", "left_semi").join(dst, "dst", "left_semi").select(*edges.columns)


def degrees(edges: DataFrame) -> DataFrame:
    """(tool, in_degree, out_degree)."""
    ends = edges.select(F.col("src").alias("tool"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(
        edges.select(F.col("dst").alias("tool"), F.lit(1).alias("i"), F.lit(0).alias("o"))
    )
    return ends.groupBy("tool").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def density(edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, density, mean and greatest out-degree."""
    return degrees(edges).agg(
        F.count(F.lit(1)).alias("n_nodes"), F.sum("out_degree").alias("n_edges"),
        F.coalesce(F.try_divide(F.sum("out_degree").cast("double"), F.count(F.lit(1)) * (F.count(F.lit(1)) - 1)), F.lit(0.0)).alias("density"),
        F.avg("out_degree").alias("avg_degree"), F.max("out_degree").alias("max_out"), F.max("in_degree").alias("max_in"),
    )


def weight_histogram(edges: DataFrame, bins: int = 60) -> DataFrame:
    """(bin, n): edges by equal bins of weight, from 0."""
    limits = edges.agg(F.min("weight").alias("_lo"), F.max("weight").alias("_hi"))
    at = F.floor(scores.min_max(F.col("weight"), F.col("_lo"), F.col("_hi")) * bins)
    return edges.crossJoin(limits).groupBy(F.least(at, F.lit(bins - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def strongest_subgraph(edges: DataFrame, frequency: DataFrame, nodes: int = 600, share: float = 0.05) -> DataFrame:
    """Edges among the most frequent nodes whose weight is at least a share of the greatest."""
    top = frequency.orderBy(F.desc("frequency"), "tool").limit(nodes).select("tool")
    inside = induced(edges, top)
    return inside.crossJoin(inside.agg(F.max("weight").alias("_hi"))).where(F.col("weight") >= share * F.col("_hi")).drop("_hi")


def undirected(edges: DataFrame) -> DataFrame:
    """(u, v, weight) with u < v: the greater of both directions."""
    return edges.groupBy(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).agg(F.max("weight").alias("weight"))


def weak_components(edges: DataFrame, keep=None) -> DataFrame:
    """(tool, component): the least name that can be reached, by least labels and jumps.

    keep(df, name) writes a round and reads it back; without it, rounds are checkpointed.
    """
    keep = keep or (lambda df, _: df.checkpoint())
    both = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(edges.select(F.col("dst").alias("a"), F.col("src").alias("b"))).distinct()
    both = keep(both, "links")
    labels, step = keep(both.select(F.col("a").alias("tool"), F.col("a").alias("component")).distinct(), "labels-0"), 0
    while True:
        near = both.join(labels, both.b == labels.tool).groupBy("a").agg(F.min("component").alias("_m"))
        next_ = labels.join(near, labels.tool == near.a).select("tool", F.least("component", "_m").alias("component"))
        jump = next_.select(F.col("tool").alias("component"), F.col("component").alias("_j"))
        next_ = next_.join(jump, "component").select("tool", F.least("component", "_j").alias("component"))
        step += 1
        now = keep(next_, f"labels-{step}")
        if not now.join(labels, ["tool", "component"], "left_anti").limit(1).count():
            return now
        labels = now


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(tool, community): in each round a node takes its neighbours' heaviest label, its own counting too; ties by the least label."""
    u = undirected(edges)
    both = u.select(F.col("u").alias("a"), F.col("v").alias("b"), "weight").unionByName(u.select(F.col("v").alias("a"), F.col("u").alias("b"), "weight"))
    labels = both.select(F.col("a").alias("tool")).distinct().withColumn("community", F.col("tool"))
    for _ in range(rounds):
        votes = both.join(labels, both.b == labels.tool).groupBy("a", "community").agg(F.sum("weight").alias("_w"))
        best = votes.groupBy("a").agg(F.min(F.struct((-F.round("_w", 9)).alias("w"), "community")).alias("_b"))
        labels = best.select(F.col("a").alias("tool"), F.col("_b.community").alias("community"))
    return labels


def _moved(links: DataFrame, labels: DataFrame, total: float, half: Column) -> DataFrame:
    """labels (tool, community, degree) after the tools of one half have moved to the community that gains most.

    A community gains links - degree * mass / total, mass without the tool itself; ties stay, then go to the least name.
    Of two tools alone in their communities only the one with the greater name moves, so that they don't change places.
    """
    mass = labels.groupBy("community").agg(F.sum("degree").alias("_mass"), F.count(F.lit(1)).alias("_size"))
    at = labels.select(F.col("tool").alias("b"), "community")
    near = links.where(half).where("a <> b").join(at, "b").groupBy(F.col("a").alias("tool"), "community").agg(F.sum("w").alias("_k"))
    own = labels.join(mass.withColumnRenamed("_size", "_alone"), "community").select("tool", F.col("community").alias("_own"), "degree", F.col("_alone") == 1, F.col("_mass").alias("_own_mass"))
    own = own.toDF("tool", "_own", "degree", "_alone", "_own_mass")
    scored = near.join(mass, "community").join(own, "tool")
    stay = F.col("community") == F.col("_own")
    gain = F.col("_k") - F.col("degree") * (F.col("_mass") - F.when(stay, F.col("degree")).otherwise(0)) / total
    allowed = stay | ~F.col("_alone") | (F.col("_size") > 1) | (F.col("community") < F.col("_own"))
    best = scored.where(allowed).withColumn("_g", F.round(gain, 12)).groupBy("tool").agg(
        F.min(F.struct((-F.col("_g")).alias("g"), (~stay).alias("other"), "community")).alias("_b"), F.first("_own").alias("_own"),
        F.first(F.round(-F.col("degree") * (F.col("_own_mass") - F.col("degree")) / total, 12)).alias("_left"),
    )
    # a tool without a link into its own community still may stay there
    goes = best.where((F.col("_b.community") != F.col("_own")) & (-F.col("_b.g") > F.col("_left"))).select("tool", F.col("_b.community").alias("_to"))
    return labels.join(goes, "tool", "left").select("tool", F.coalesce("_to", "community").alias("community"), "degree")


def _quality(links: DataFrame, labels: DataFrame, total: float) -> float:
    """Modularity of links (a, b, w; both directions) under labels."""
    a, b = labels.select(F.col("tool").alias("a"), F.col("community").alias("_a")), labels.select(F.col("tool").alias("b"), F.col("community").alias("_b"))
    inside = links.join(a, "a").join(b, "b").where("_a = _b").agg(F.sum("w").alias("_in"))
    masses = labels.groupBy("community").agg(F.sum("degree").alias("_m")).agg(F.sum(F.col("_m") * F.col("_m")).alias("_m2"))
    row = inside.crossJoin(masses).first()  # one row each
    return (row[0] or 0.0) / total - (row[1] or 0.0) / total**2


def louvain(edges: DataFrame, keep: Callable[[DataFrame, str], DataFrame], least: float = 1e-6) -> DataFrame:
    """(tool, community) of the undirected graph: greedy modularity by moves of alternate halves of the tools, and aggregation.

    In a round one half of the tools, by md5 of name and round, moves at once, then the other. Rounds go on while
    modularity rises by more than `least`; then communities become the tools of the next level, until a level changes
    nothing. A community has the name of one of its members. keep(df, name) writes a step and reads it back; the
    driver sees a sum or two a round.
    """
    u = undirected(edges).where("u <> v")
    links = keep(u.select(F.col("u").alias("a"), F.col("v").alias("b"), F.col("weight").alias("w")).unionByName(u.select(F.col("v"), F.col("u"), "weight").toDF("a", "b", "w")), "links-0")
    member, level, round_ = None, 0, 0
    while True:
        degree = links.groupBy(F.col("a").alias("tool")).agg(F.sum("w").alias("degree"))
        labels = keep(degree.select("tool", F.col("tool").alias("community"), "degree"), f"labels-{level}")
        total = labels.agg(F.sum("degree")).first()[0]
        if member is None:
            member = labels.select("tool", "community")
        if not total:
            return member
        best = start = _quality(links, labels, total)
        while True:
            now = labels
            for half in (0, 1):
                mine = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(round_)), "a")), 1, 1), 16, 10).cast("int") % 2 == half
                now = keep(_moved(links, now, total, mine), f"labels-{level}-{round_}-{half}")
            round_ += 1
            quality = _quality(links, now, total)
            if quality <= best + least:
                break
            labels, best = now, quality
        if best <= start + least:
            return member
        into = labels.select(F.col("tool").alias("community"), F.col("community").alias("_c"))
        level += 1
        member = keep(member.join(into, "community").select("tool", F.col("_c").alias("community")), f"member-{level}")
        a, b = labels.select(F.col("tool").alias("a"), F.col("community").alias("_a")), labels.select(F.col("tool").alias("b"), F.col("community").alias("_b"))
        merged = links.join(a, "a").join(b, "b").groupBy(F.col("_a").alias("a"), F.col("_b").alias("b")).agg(F.sum("w").alias("w"))
        links = keep(merged, f"links-{level}")


def purity(tools: DataFrame) -> DataFrame:
    """Of (tool, category, community): each community's size, categories, commonest category and its share."""
    counts = tools.groupBy("community", "category").agg(F.count(F.lit(1)).alias("_n"))
    top = counts.groupBy("community").agg(
        F.sum("_n").alias("size"), F.count(F.lit(1)).alias("n_categories"),
        F.min(F.struct((-F.col("_n")).alias("n"), "category")).alias("_t"),
    )
    return top.select("community", "size", "n_categories", F.col("_t.category").alias("dominant"), (-F.col("_t.n") / F.col("size")).alias("purity"))


def nmi(tools: DataFrame) -> DataFrame:
    """One row: mutual information of community and category over the mean of their entropies."""
    n = tools.groupBy("community", "category").agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("t"))
    a, b = n.groupBy("community").agg(F.sum("n").alias("a")), n.groupBy("category").agg(F.sum("n").alias("b"))
    entropy = lambda df, c, name: df.crossJoin(total).agg(F.sum(-F.col(c) / F.col("t") * F.ln(F.col(c) / F.col("t"))).alias(name))
    mi = (
        n.join(a, "community").join(b, "category").crossJoin(total)
        .agg(F.sum(F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("t") / (F.col("a") * F.col("b")))).alias("mi"))
    )
    rows = mi.crossJoin(entropy(a, "a", "ha")).crossJoin(entropy(b, "b", "hb"))  # one row each
    return rows.select(F.coalesce(F.try_divide(F.col("mi"), (F.col("ha") + F.col("hb")) / 2), F.lit(1.0)).alias("nmi"))


def modularity(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """One row: weighted modularity of the undirected graph under (tool, community)."""
    u = undirected(edges)
    c = communities.select("tool", "community")
    rows = u.join(c.select(F.col("tool").alias("u"), F.col("community").alias("cu")), "u").join(c.select(F.col("tool").alias("v"), F.col("community").alias("cv")), "v")
    m = rows.agg(F.sum("weight").alias("m"))
    ends = F.array(F.struct(F.col("cu").alias("c"), F.col("weight").alias("d")), F.struct(F.col("cv").alias("c"), F.col("weight").alias("d")))
    deg = rows.select(F.explode(ends).alias("e")).groupBy(F.col("e.c").alias("c")).agg(F.sum("e.d").alias("deg"))
    inside = rows.where("cu = cv").groupBy(F.col("cu").alias("c")).agg(F.sum("weight").alias("inside"))
    per = deg.join(inside, "c", "left").crossJoin(m)  # one row
    return per.agg(F.coalesce(F.sum(F.coalesce("inside", F.lit(0.0)) / F.col("m") - F.pow(F.col("deg") / (2 * F.col("m")), F.lit(2))), F.lit(0.0)).alias("modularity"))


def clustering(edges: DataFrame) -> DataFrame:
    """One row: mean over nodes of the weighted clustering coefficient (cube roots of scaled weights) of the undirected graph."""
    u = undirected(edges)
    scaled = u.crossJoin(u.agg(F.max("weight").alias("_hi"))).select("u", "v", F.cbrt(F.col("weight") / F.col("_hi")).alias("w"))
    both = scaled.unionByName(scaled.select(F.col("v").alias("u"), F.col("u").alias("v"), "w"))
    deg = both.groupBy("u").agg(F.count(F.lit(1)).alias("k"))
    x = scaled.select(F.col("u").alias("a"), F.col("v").alias("b"), F.col("w").alias("w1"))
    y = scaled.select(F.col("u").alias("b"), F.col("v").alias("c"), F.col("w").alias("w2"))
    z = scaled.select(F.col("u").alias("a"), F.col("v").alias("c"), F.col("w").alias("w3"))
    triangles = x.join(y, "b").join(z, ["a", "c"]).select(F.explode(F.array("a", "b", "c")).alias("u"), (F.col("w1") * F.col("w2") * F.col("w3")).alias("t"))
    per = deg.join(triangles.groupBy("u").agg(F.sum("t").alias("t")), "u", "left")
    return per.agg(F.avg(F.coalesce(F.try_divide(2 * F.col("t"), F.col("k") * (F.col("k") - 1)), F.lit(0.0))).alias("avg_clustering"))


def meta_graph(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """(c1, c2, weight): sums of weights between communities, c1 < c2."""
    c = communities.select("tool", "community")
    rows = edges.join(c.select(F.col("tool").alias("src"), F.col("community").alias("a")), "src").join(c.select(F.col("tool").alias("dst"), F.col("community").alias("b")), "dst")
    return rows.where("a <> b").groupBy(F.least("a", "b").alias("c1"), F.greatest("a", "b").alias("c2")).agg(F.sum("weight").alias("weight"))


def meta_nodes(communities: DataFrame, frequency: DataFrame) -> DataFrame:
    """(community, size, label): the label is the most frequent member; ties by name."""
    rows = communities.join(frequency.select("tool", "frequency"), "tool")
    best = rows.groupBy("community").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct((-F.col("frequency")).alias("f"), "tool")).alias("_b"))
    return best.select("community", "size", F.col("_b.tool").alias("label"))


def centroids(steps: DataFrame, vectors: DataFrame, floor: float = 0.01) -> DataFrame:
    """(community, dim, value): unit centroids, members weighted by ln(tasks / tasks with the tool), at least `floor`."""
    df = steps.select("task_id", "tool").distinct().groupBy("tool").agg(F.count(F.lit(1)).alias("_df"))
    n = steps.agg(F.count_distinct("task_id").alias("_n"))
    idf = df.crossJoin(n).select("tool", F.greatest(F.lit(floor), F.ln(F.col("_n") / F.col("_df"))).alias("_w"))  # one row
    parts = vectors.join(idf, "tool").select("community", "_w", F.posexplode("vec").alias("dim", "x"))
    sums = parts.groupBy("community", "dim").agg((F.sum(F.col("_w") * F.col("x").cast("double")) / F.sum("_w")).alias("_v"))
    length = sums.groupBy("community").agg(F.sqrt(F.sum(F.col("_v") * F.col("_v"))).alias("_l"))
    return sums.join(length, "community").select("community", "dim", F.coalesce(F.try_divide("_v", "_l"), F.lit(0.0)).alias("value"))


def shortest_paths(edges: DataFrame, sources: DataFrame, keep: Callable[[DataFrame, str], DataFrame], depth: int | None = None) -> DataFrame:
    """(src, dst, hops, path) from sources (tool), unweighted, of any length or at most `depth` hops; among equals the least path.

    keep(df, name) writes a round and reads it back.
    """
    hop = keep(edges.select(F.col("src").alias("_at"), F.col("dst").alias("_to")).distinct(), "hops")
    start = sources.select(F.col("tool").alias("src"), F.col("tool").alias("dst"), F.lit(0).alias("hops"), F.array("tool").alias("path")).distinct()
    found = last = keep(start, "paths-0")
    h = 0
    while depth is None or h < depth:
        h += 1
        grown = last.join(hop, last.dst == hop._at).select("src", F.col("_to").alias("dst"), F.concat("path", F.array("_to")).alias("path"))
        best = grown.groupBy("src", "dst").agg(F.lit(h).alias("hops"), F.min("path").alias("path"))
        last = keep(best.join(found.select("src", "dst"), ["src", "dst"], "left_anti"), f"paths-{h}")
        if not last.limit(1).count():
            break
        found = found.unionByName(last)
    return found


def paths_between(edges: DataFrame, wanted: DataFrame, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """(src, dst, path) of the wanted pairs (src, dst) that have a path, unweighted, of any length; among equals the least path.

    Sources go on until their wanted ends are found or nothing new can be reached. keep(df, name) writes a round and reads it back.
    """
    hop = keep(edges.select(F.col("src").alias("_at"), F.col("dst").alias("_to")).distinct(), "hops")
    left = keep(wanted.select("src", "dst").distinct(), "wanted")
    last = keep(left.select("src", F.col("src").alias("dst"), F.array("src").alias("path")).distinct(), "paths-0")
    seen, out, h = last.select("src", "dst"), last.join(left, ["src", "dst"]), 0
    while True:
        left = keep(left.join(last, ["src", "dst"], "left_anti"), f"left-{h}")
        live = last.join(left.select("src").distinct(), "src", "left_semi")
        grown = live.join(hop, live.dst == hop._at).select("src", F.col("_to").alias("dst"), F.concat("path", F.array("_to")).alias("path"))
        h += 1
        last = keep(grown.groupBy("src", "dst").agg(F.min("path").alias("path")).join(seen, ["src", "dst"], "left_anti"), f"paths-{h}")
        if not last.limit(1).count():
            return out
        seen, out = seen.unionByName(last.select("src", "dst")), out.unionByName(last.join(wanted.select("src", "dst").distinct(), ["src", "dst"]))


def _spread(start: DataFrame, links: DataFrame, keep: Callable[[DataFrame, str], DataFrame], name: str) -> DataFrame:
    """(tool, label): the least label that reaches each tool of start (tool, label) along links (src, dst)."""
    labels, i = keep(start, f"{name}-0"), 0
    while True:
        sent = links.join(labels.withColumnRenamed("tool", "src"), "src").select(F.col("dst").alias("tool"), "label")
        i += 1
        now = keep(labels.unionByName(sent).groupBy("tool").agg(F.min("label").alias("label")), f"{name}-{i}")
        if not now.join(labels, ["tool", "label"], "left_anti").limit(1).count():
            return now
        labels = now


def strong_components(edges: DataFrame, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """(tool, component): tools that reach one another, named after the least of them.

    Tools without a way in or a way out are alone and go first. Of the rest every tool takes the least name that reaches it;
    what gets back to the tool of that name, within those that took it, is its component. This goes on with what is left.
    """
    links = keep(edges.where("src <> dst").select("src", "dst").distinct(), "links")
    left = keep(edges.select(F.explode(F.array("src", "dst")).alias("tool")).distinct(), "left")
    found, i = None, 0
    while left.limit(1).count():
        inner = links.select(F.col("src").alias("tool")).distinct().join(links.select(F.col("dst").alias("tool")).distinct(), "tool", "left_semi")
        alone = keep(left.join(inner, "tool", "left_anti").select("tool", F.col("tool").alias("component")), f"alone-{i}")
        if not alone.limit(1).count():
            least = _spread(left.select("tool", F.col("tool").alias("label")), links, keep, f"least-{i}")
            a, b = least.select(F.col("tool").alias("src"), F.col("label").alias("_a")), least.select(F.col("tool").alias("dst"), F.col("label").alias("_b"))
            same = keep(links.join(a, "src").join(b, "dst").where("_a = _b").select(F.col("dst").alias("src"), F.col("src").alias("dst")), f"same-{i}")
            back = _spread(least.where("tool = label"), same, keep, f"back-{i}")
            alone = keep(back.select("tool", F.col("label").alias("component")), f"strong-{i}")
        found = alone if found is None else found.unionByName(alone)
        left = keep(left.join(alone, "tool", "left_anti"), f"left-{i}")
        links = keep(induced(links, left), f"links-{i}")
        i += 1
    return found if found is not None else left.select("tool", F.col("tool").alias("component"))


def topological_order(edges: DataFrame, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """(tool, component, cyclic, layer): the longest chain of components that ends in the tool's, of any length.

    Tools on a cycle share a component and a layer; a graph is acyclic if none is cyclic.
    """
    member = keep(strong_components(edges, keep), "member")
    size = member.groupBy("component").agg((F.count(F.lit(1)) > 1).alias("cyclic"))
    a, b = member.select(F.col("tool").alias("src"), F.col("component").alias("_a")), member.select(F.col("tool").alias("dst"), F.col("component").alias("_b"))
    between = edges.select("src", "dst").join(a, "src").join(b, "dst").where("_a <> _b").select(F.col("_a").alias("src"), F.col("_b").alias("dst")).distinct()
    links, left, layers, i = keep(between, "between"), keep(size, "components"), None, 0
    while left.limit(1).count():  # a graph of components has no cycle, so every round takes some
        ready = keep(left.join(links.select(F.col("dst").alias("component")).distinct(), "component", "left_anti").withColumn("layer", F.lit(i)), f"layer-{i}")
        layers = ready if layers is None else layers.unionByName(ready)
        left = keep(left.join(ready, "component", "left_anti"), f"rest-{i}")
        links = keep(links.join(ready.select(F.col("component").alias("src")), "src", "left_anti"), f"between-{i}")
        i += 1
    if layers is None:
        layers = left.withColumn("layer", F.lit(0))
    return member.join(layers, "component").select("tool", "component", "cyclic", "layer")


def largest_communities(communities: DataFrame, top: int = 40) -> DataFrame:
    """(community, size) of the `top` communities with the most tools; ties by community."""
    return communities.groupBy("community").agg(F.count(F.lit(1)).alias("size")).orderBy(F.desc("size"), "community").limit(top)


def community_flow(edges: DataFrame, communities: DataFrame, top: int = 10, least: float = 1.0) -> DataFrame:
    """(c1, c2, weight): sums of weights from c1 to c2 among the `top` largest communities, if of at least `least`."""
    c = communities.join(largest_communities(communities, top), "community").select("tool", "community")
    a, b = c.select(F.col("tool").alias("src"), F.col("community").alias("c1")), c.select(F.col("tool").alias("dst"), F.col("community").alias("c2"))
    sums = edges.join(a, "src").join(b, "dst").where("c1 <> c2").groupBy("c1", "c2").agg(F.sum("weight").alias("weight"))
    return sums.where(F.round("weight", 9) >= least)


def non_edges(nodes: DataFrame, edges: DataFrame, draws: int = 3, seed: str = "42") -> DataFrame:
    """(src, dst): for each edge the first of `draws` random pairs of different nodes that is no edge, if one is; each pair once.

    Draws are by md5 of the edge, so no list of all pairs is made.
    """
    numbered = nodes.select("tool", (F.row_number().over(Window.orderBy("tool")) - 1).cast("long").alias("_i"))
    total = nodes.agg(F.count(F.lit(1)).alias("_total"))  # one row
    number = lambda end: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "_s", "_d", F.col("_j").cast("string"), F.lit(end))), 1, 8), 16, 10).cast("long") % F.col("_total")
    drawn = edges.select(F.col("src").alias("_s"), F.col("dst").alias("_d"), F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("_j"))
    drawn = drawn.crossJoin(total).withColumns({"_u": number("u"), "_v": number("v")}).where("_u <> _v")
    ends = lambda n: numbered.select(F.col("tool").alias(n), F.col("_i").alias(f"_{n}"))
    pairs = drawn.join(ends("src"), F.col("_u") == F.col("_src")).join(ends("dst"), F.col("_v") == F.col("_dst"))
    free = pairs.join(edges.select("src", "dst"), ["src", "dst"], "left_anti")
    return free.groupBy("_s", "_d").agg(F.min_by(F.struct("src", "dst"), "_j").alias("p")).select("p.*").distinct()


def _mixed(number: Column, half: int, seed: str) -> Column:
    """A permutation of the numbers below 4 ** half: four rounds that mix one half of the bits with the md5 of the other."""
    high, low = F.shiftright(number, half), number.bitwiseAND(F.lit((1 << half) - 1))
    for r in range(4):
        drawn = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.lit(str(r)), low.cast("string"))), 1, 8), 16, 10).cast("long")
        high, low = low, (high + drawn) % (1 << half)
    return F.shiftleft(high, half) + low


def drawn_pairs(tools: DataFrame, wanted: int, keep: Callable[[DataFrame, str], DataFrame], seed: str = "42", without: DataFrame | None = None) -> DataFrame:
    """(src, dst): exactly `wanted` different pairs of different tools (tool, n; n from 0 on), none of them in `without`, or all there are.

    Pairs of tools are numbered, and the numbers are gone through in the order of a permutation: no pair comes twice, and no
    list of all pairs is made. What falls outside the numbers or on a pair of `without` is passed over, and draws go on until
    there are enough.
    """
    n_tools, taken = tools.count(), without.count() if without is not None else 0
    total, half = n_tools * (n_tools - 1), 0
    while 4**half < total:
        half += 1
    wanted, domain = min(wanted, total - taken), 4**half
    if wanted <= 0:
        return tools.sparkSession.createDataFrame([], "src string, dst string")
    found, low, high, parts = None, 0, min(domain, int(1.1 * wanted * domain / (total - taken)) + 64), 0
    while low < high:
        drawn = tools.sparkSession.range(low, high).select(F.col("id").alias("i"), _mixed(F.col("id"), half, seed).alias("_p")).where(F.col("_p") < total)
        ends = drawn.select("i", F.floor(F.col("_p") / (n_tools - 1)).alias("_s"), (F.col("_p") % (n_tools - 1)).alias("_d"))
        ends = ends.withColumn("_d", F.col("_d") + (F.col("_d") >= F.col("_s")).cast("long"))
        named = ends.join(tools.select(F.col("tool").alias("src"), F.col("n").alias("_s")), "_s").join(tools.select(F.col("tool").alias("dst"), F.col("n").alias("_d")), "_d")
        named = named.select("i", "src", "dst")
        part = keep(named if without is None else named.join(without.select("src", "dst"), ["src", "dst"], "left_anti"), f"drawn-{parts}")
        found, parts = (part if found is None else found.unionByName(part)), parts + 1
        low, high = high, min(domain, 2 * high) if found.count() < wanted else high
    # the first `wanted`: whole ranges of numbers, then a part of one of about a thousand
    step, left, last = max(1, high // 1024), wanted, None
    for r in found.groupBy(F.floor(F.col("i") / step).alias("b")).agg(F.count(F.lit(1)).alias("n")).orderBy("b").collect():
        if r["n"] > left:
            last = r["b"]
            break
        left -= r["n"]
    if last is None:
        return found.select("src", "dst")
    rest = found.where((F.col("i") >= last * step) & (F.col("i") < (last + 1) * step)).orderBy("i").limit(left)
    return found.where(F.col("i") < last * step).unionByName(rest).select("src", "dst")


def score_histogram(parts: dict[str, DataFrame], bins: int = 20) -> DataFrame:
    """(kind, bin, n): counts of `score` by kind, in bins of 1 / bins from 0 on."""
    out = None
    for kind, rows in parts.items():
        one = rows.select(F.lit(kind).alias("kind"), F.floor(F.round("score", 9) * bins).alias("bin"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("kind", "bin").agg(F.count(F.lit(1)).alias("n"))
