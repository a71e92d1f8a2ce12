"""Link scores of a trained graph encoder: two layers of neighbour means and a decoder of pairs of tools.

A tool's first layer sees its vector and the mean of its predecessors' vectors, taken over all of them by one
aggregation; the second sees the first layer of the tool and the mean of that of `sample` of its predecessors, chosen by
md5. The decoder reads both tools' vectors and their product. A tool with its sampled predecessors is one row
(`neighbourhoods`), examples are blocks of up to BLOCK pairs that hold each of their tools once, and descent.train adds up
the gradients of all blocks.

Pairs with a tool that has no vector are left out; a tool without predecessors has a mean of zeros.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import descent, retrieval

#: Pairs of a block of examples, and predecessors that the second layer looks at.
BLOCK, SAMPLE = 1024, 5


class Encoder:
    """The net: 2 * dims -> hidden -> hidden for a tool, 3 * hidden -> hidden -> hidden / 2 -> 1 for a pair."""

    def __init__(self, dims: int, hidden: int = 64, sample: int = SAMPLE):
        self.dims, self.hidden, self.sample = dims, hidden, sample

    def start(self, rng: np.random.Generator) -> dict:
        h, out = self.hidden, {}
        sizes = {"1": (2 * self.dims, h), "2": (2 * h, h), "3": (3 * h, h), "4": (h, h // 2), "5": (h // 2, 1)}
        for k, (n_in, n_out) in sizes.items():
            out[f"w{k}"], out[f"b{k}"] = descent.layer(rng, n_in, n_out)
        return out

    def tools(self, p: dict, z: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Vectors of tools from z (tool, itself and its sample, 2 * dims) and which of the sample there are."""
        z = z.astype(float)
        one = np.maximum(z @ p["w1"] + p["b1"], 0)
        share = there / np.maximum(there.sum(axis=1, keepdims=True), 1)
        both = np.concatenate([one[:, 0], np.einsum("ms,msh->mh", share, one[:, 1:])], axis=1)
        two = np.maximum(both @ p["w2"] + p["b2"], 0)
        return two, (z, one, share, both)

    def pairs(self, p: dict, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Logits of pairs of tools' vectors."""
        x = np.concatenate([u, v, u * v], axis=1)
        three = np.maximum(x @ p["w3"] + p["b3"], 0)
        four = np.maximum(three @ p["w4"] + p["b4"], 0)
        return (four @ p["w5"] + p["b5"])[:, 0], (x, three, four)

    def _read(self, row) -> tuple[np.ndarray, np.ndarray]:
        z = np.frombuffer(row.z, np.float32).reshape(-1, 1 + self.sample, 2 * self.dims)
        return z, np.frombuffer(row.there, np.uint8).reshape(-1, self.sample).astype(float)

    def forward(self, p: dict, row) -> tuple[np.ndarray, tuple]:
        two, inner = self.tools(p, *self._read(row))
        src, dst = np.asarray(row.src), np.asarray(row.dst)
        logit, outer = self.pairs(p, two[src], two[dst])
        return logit, (two, inner, outer, src, dst)

    def backward(self, p: dict, held: tuple, slope: np.ndarray) -> dict:
        two, (z, one, share, both), (x, three, four), src, dst = held
        g, h = {}, self.hidden

        def through(k: str, inputs: np.ndarray, d: np.ndarray) -> np.ndarray:
            """The gradient of layer k, and what goes on to its inputs."""
            g[f"w{k}"], g[f"b{k}"] = inputs.T @ d, d.sum(axis=0)
            return d @ p[f"w{k}"].T

        d = through("5", four, slope[:, None]) * (four > 0)
        d = through("4", three, d) * (three > 0)
        d = through("3", x, d)
        d_two = np.zeros_like(two)
        np.add.at(d_two, src, d[:, :h] + d[:, 2 * h :] * two[dst])
        np.add.at(d_two, dst, d[:, h : 2 * h] + d[:, 2 * h :] * two[src])
        d = through("2", both, d_two * (two > 0))
        d_one = np.concatenate([d[:, None, :h], share[:, :, None] * d[:, None, h:]], axis=1) * (one > 0)
        through("1", z.reshape(-1, z.shape[2]), d_one.reshape(-1, h))
        return g


def neighbourhoods(vectors: DataFrame, edges: DataFrame, sample: int = SAMPLE, seed: str = "42") -> DataFrame:
    """(tool, z, near): z is a tool's vector and its predecessors' mean, near those of `sample` of its predecessors."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    x = vectors.select("tool", F.col("vec").cast("array<double>").alias("vec"))
    links = edges.select("src", "dst").distinct()
    of = links.join(x.withColumnRenamed("tool", "src"), "src")
    means = of.groupBy(F.col("dst").alias("tool")).agg(vector_to_array(Summarizer.mean(array_to_vector("vec"))).alias("_m"))
    mean = F.coalesce("_m", F.transform("vec", lambda _: F.lit(0.0)))
    z = x.join(means, "tool", "left").select("tool", F.concat("vec", mean).cast("array<float>").alias("z"))
    order = Window.partitionBy("dst").orderBy(F.md5(F.concat_ws(":", F.lit(seed), "dst", "src")), "src")
    chosen = links.join(x.select(F.col("tool").alias("src")), "src", "left_semi").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= sample)
    near = chosen.join(z.withColumnRenamed("tool", "src"), "src").groupBy(F.col("dst").alias("tool")).agg(F.array_sort(F.collect_list(F.struct("_n", "z"))).alias("_s"))
    return z.join(near, "tool", "left").select("tool", "z", F.coalesce(F.transform("_s", lambda s: s["z"]), F.array().cast("array<array<float>>")).alias("near"))


def _stacked(z: list, near: list, sample: int) -> tuple[np.ndarray, np.ndarray]:
    out, there = np.zeros((len(z), 1 + sample, len(z[0])), np.float32), np.zeros((len(z), sample), np.uint8)
    for i, (own, others) in enumerate(zip(z, near, strict=True)):
        out[i, 0] = own
        for j, x in enumerate(others):
            out[i, 1 + j], there[i, j] = x, 1
    return out, there


def examples(pairs: DataFrame, nodes: DataFrame, keep: Callable[[DataFrame, str], DataFrame], sample: int = SAMPLE, size: int = BLOCK, batches: int = 1) -> DataFrame:
    """Blocks of the pairs (src, dst, label, part), each with the rows of its tools in nodes (of `neighbourhoods`) once."""
    known = nodes.select("tool")
    rows = pairs.join(known.withColumnRenamed("tool", "src"), "src", "left_semi").join(known.withColumnRenamed("tool", "dst"), "dst", "left_semi")
    rows = rows.select("src", "dst", "label", "part").repartitionByRange("part", "src", "dst").sortWithinPartitions("part", "src", "dst")

    def cut(groups: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list] = {}
        n = 0

        def block(part: str) -> pd.DataFrame:
            nonlocal n
            src, dst, label, at = zip(*held.pop(part), strict=True)
            n += 1
            return pd.DataFrame({"block": [f"{at[0]}-{n}"], "part": [part], "batch": [n % batches], "src": [list(src)], "dst": [list(dst)], "label": [list(label)]})

        for group in groups:
            for src, dst, label, part, at in group.itertuples(index=False):
                held.setdefault(part, []).append((src, dst, float(label), at))
                if len(held[part]) == size:
                    yield block(part)
        for part in list(held):
            yield block(part)

    schema = "block string, part string, batch int, src array<string>, dst array<string>, label array<double>"
    blocks = keep(rows.withColumn("_at", F.spark_partition_id()).mapInPandas(cut, schema), "pairs")
    wanted = blocks.select("block", F.explode(F.array_distinct(F.concat("src", "dst"))).alias("tool"))
    held = wanted.join(nodes, "tool").groupBy("block").agg(F.collect_list(F.struct("tool", "z", "near")).alias("tools"))  # 2 * size tools at most

    def packed(groups: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in groups:
            for row in group.itertuples(index=False):
                place = {t["tool"]: i for i, t in enumerate(row.tools)}
                z, there = _stacked([t["z"] for t in row.tools], [t["near"] for t in row.tools], sample)
                src, dst = ([place[t] for t in side] for side in (row.src, row.dst))
                yield pd.DataFrame({"part": [row.part], "batch": [row.batch], "label": [row.label], "src": [src], "dst": [dst], "z": [z.tobytes()], "there": [there.tobytes()]})

    schema = "part string, batch int, label array<double>, src array<int>, dst array<int>, z binary, there binary"
    return keep(blocks.join(held, "block").mapInPandas(packed, schema), "examples")


def fit(
    pairs: DataFrame, vectors: DataFrame, edges: DataFrame, keep: Callable[[DataFrame, str], DataFrame], hidden: int = 64,
    sample: int = SAMPLE, batches: int = 1, **how,
) -> tuple[descent.Fitted, DataFrame]:
    """A trained encoder, and (tool, vec): all tools' vectors by it. `how` goes to descent.train."""
    nodes = keep(neighbourhoods(vectors, edges, sample), "nodes")
    first = nodes.select(F.size("z").alias("n")).first()
    net = Encoder(first["n"] // 2 if first else 1, hidden, sample)
    fitted = descent.train(examples(pairs, nodes, keep, sample, batches=batches), net, batches=batches, **how)
    return fitted, keep(encoded(fitted, nodes), "encoded")


def encoded(fitted: descent.Fitted, nodes: DataFrame) -> DataFrame:
    """(tool, vec) of every tool of nodes."""

    def run(groups: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net, p = fitted.net, fitted.params
        for group in groups:
            for i in range(0, len(group), BLOCK):
                part = group.iloc[i : i + BLOCK]
                two, _ = net.tools(p, *_stacked(list(part["z"]), list(part["near"]), net.sample))
                yield pd.DataFrame({"tool": part["tool"], "vec": list(two)})

    return nodes.mapInPandas(run, "tool string, vec array<double>")


def scores(fitted: descent.Fitted, pairs: DataFrame, vectors: DataFrame, least: float = 0.0) -> DataFrame:
    """(src, dst, score) of given pairs by the vectors of `encoded`, above `least`."""

    def run(groups: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in groups:
            if len(group):
                logit, _ = fitted.net.pairs(fitted.params, np.stack(group["_u"]), np.stack(group["_v"]))
                score = descent.sigmoid(logit)
                out = pd.DataFrame({"src": group["src"], "dst": group["dst"], "score": score})
                yield out[score > least]

    u = vectors.select(F.col("tool").alias("src"), F.col("vec").alias("_u"))
    v = vectors.select(F.col("tool").alias("dst"), F.col("vec").alias("_v"))
    both = pairs.select("src", "dst").distinct().join(u, "src").join(v, "dst").select("src", "dst", "_u", "_v")
    return both.mapInPandas(run, "src string, dst string, score double")


def all_scores(fitted: descent.Fitted, vectors: DataFrame, keep: Callable[[DataFrame, str], DataFrame], least: float = 0.01) -> DataFrame:
    """(src, dst, score) of all pairs of different tools that score more than `least`, block by block; at 0 and below the whole matrix."""

    def run(src: list, u: np.ndarray, dst: list, v: np.ndarray) -> Iterator[tuple]:
        for name, x in zip(src, u, strict=True):
            score = descent.sigmoid(fitted.net.pairs(fitted.params, np.broadcast_to(x, v.shape), v)[0])
            some = [j for j in np.flatnonzero(score > least).tolist() if dst[j] != name]
            yield [name] * len(some), [dst[j] for j in some], score[some]

    return retrieval.blocks_met(vectors, vectors, run, keep)
