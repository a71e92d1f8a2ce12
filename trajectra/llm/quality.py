"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of a document are counts over its whole text; the trees are trained here, by
numpy, on a bounded sample of labelled rows (`max_rows`), and flattened into arrays that
score all documents of a batch at once, level by level.

Edge cases: a null text counts as empty and gets the score of the empty text; labels with a
null id or value are left out; a document labelled more than once takes the mean, 0.5 counting
as 1; without any usable label every score is 0.5; repeated rows are scored alike, and ties are
scored alike; texts of any length are described whole; of the input's columns only doc_id and text
are looked at, and one with the name of the output is replaced; an empty table returns no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Rows a model may be fitted on, taken in the order of a hash of doc_id.
MAX_TRAIN_ROWS = 20_000
THRESHOLD = 0.7

_B = np.arange(256)
_CLASSES = [
    (_B >= 65) & (_B <= 90),
    (_B >= 97) & (_B <= 122),
    (_B >= 48) & (_B <= 57),
    np.isin(_B, list(b".,;:?'\"()-")),
    np.isin(_B, list(b"!")),
    np.isin(_B, list(b"#$%&*|<>{}[]=+_/\\~^@`")),
    (_B == 32) | (_B == 9),
    _B == 10,
    _B >= 128,
]
_MASKS = np.array(_CLASSES, float)


def statistics(text: str | None) -> list[float]:
    """Numbers that describe a whole text; all of them are finite, the empty text included."""
    text = text or ""
    raw, words, lines = text.encode(), text.split(), text.split("\n")
    n, w = max(1, len(raw)), max(1, len(words))
    shares = (_MASKS @ np.bincount(np.frombuffer(raw, np.uint8), minlength=256)) / n
    counts = Counter(words)
    twins = sum(map(eq, words, words[1:]))
    pairs = len(set(zip(words, words[1:], strict=False)))
    ends = sum(line.rstrip()[-1:] in ".!?" for line in lines if line.strip())
    full = max(1, sum(1 for line in lines if line.strip()))
    return [
        *shares,
        np.log1p(len(words)),
        len(text) / w,
        len(counts) / w,
        twins / w,
        pairs / w,
        max(counts.values(), default=0) / w,
        sum(c for c in counts.values() if c == 1) / w,
        len(set(lines)) / len(lines),
        np.log1p(len(lines)),
        len(words) / len(lines),
        ends / full,
        sum(1 for x in words if x[-1:] in "!#$%&*|") / w,
        sum(1 for x in words if len(x) > 1 and x.isupper()) / w,
    ]


@dataclass
class Forest:
    """Trees flattened into arrays: row t holds tree t, children of node i are 2i+1 and 2i+2."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        at, trees = np.zeros((len(x), len(self.feature)), np.int64), np.arange(len(self.feature))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = 2 * at + 1 + (x[rows, self.feature[trees, at]] > self.threshold[trees, at])
        return self.base + self.value[trees, at].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit_forest(
    x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15,
    bins: int = 64, least: float = 5.0, ridge: float = 1.0,
) -> Forest:
    """Boost complete trees on the logistic loss; splits are searched in histograms of `bins` quantiles."""
    nodes, inner = 2 ** (depth + 1) - 1, 2**depth - 1
    forest = Forest(
        np.zeros((trees, nodes), np.int64), np.full((trees, nodes), np.inf), np.zeros((trees, nodes)), 0.0, depth
    )
    if not len(y) or y.min() == y.max():
        forest.base = 0.0 if not len(y) else float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
        return forest
    f = x.shape[1]
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(f)]
    code = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(f)], axis=1)
    flat = code + bins * np.arange(f)
    forest.base = float(np.log(y.mean() / (1 - y.mean())))
    margin = np.full(len(y), forest.base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h, at = p - y, p * (1 - p), np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            slot = ((at - first)[:, None] * (f * bins) + flat).ravel()
            size = width * f * bins
            gs = np.bincount(slot, np.repeat(g, f), size).reshape(width, f, bins).cumsum(axis=2)
            hs = np.bincount(slot, np.repeat(h, f), size).reshape(width, f, bins).cumsum(axis=2)
            ga, ha = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + ridge) + (ga - gs) ** 2 / (ha - hs + ridge) - ga**2 / (ha + ridge)
            gain[(hs < least) | (ha - hs < least)] = -1
            for j in range(f):
                gain[:, j, len(cuts[j]) :] = -1
            best = gain.reshape(width, -1).argmax(axis=1)
            for k in range(width):
                j, b = divmod(int(best[k]), bins)
                if gain[k, j, b] > 1e-9:
                    forest.feature[t, first + k], forest.threshold[t, first + k] = j, cuts[j][b]
            at = 2 * at + 1 + (x[np.arange(len(x)), forest.feature[t, at]] > forest.threshold[t, at])
        leaf = at - inner
        gl, hl = np.bincount(leaf, g, 2**depth), np.bincount(leaf, h, 2**depth)
        forest.value[t, inner:] = -rate * gl / (hl + ridge)
        margin += forest.value[t, at]
    return forest


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Rows that no model learns from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_TRAIN_ROWS) -> Forest:
    """Fit on at most `max_rows` labelled rows that are not held out.

    The sample is bounded by that parameter, so it may be broadcast to the documents and its
    statistics (a few hundred bytes a row) fetched.
    """
    marked = (
        labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("double").alias("_y"))
        .where(F.col("_id").isNotNull() & F.col("_y").isNotNull() & ~held_out("_id"))
        .groupBy("_id").agg((F.avg("_y") >= 0.5).cast("double").alias("_y"))
        .orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    )

    @F.pandas_udf("array<double>")
    def described(texts: pd.Series) -> pd.Series:
        return texts.map(statistics)

    rows = (
        docs.select(F.col("doc_id").alias("_id"), "text")
        .join(F.broadcast(marked), "_id")
        .select("_id", "_y", described("text").alias("_x"))
        .orderBy(F.xxhash64("_id"), "_id", "_x").limit(max_rows).collect()
    )
    if not rows:
        return fit_forest(np.empty((0, 1)), np.empty(0))
    return fit_forest(np.array([r["_x"] for r in rows]), np.array([r["_y"] for r in rows]))


def score(docs: DataFrame, forest: Forest, text: str = "text", out: str = "score") -> DataFrame:
    """Add the score of every whole text as column `out`."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        try:
            for texts in batches:
                found = np.empty(len(texts))
                for i in range(0, len(texts), 512):
                    x = np.array([statistics(t) for t in texts.iloc[i : i + 512]])
                    found[i : i + len(x)] = forest.score(x)
                yield pd.Series(found)
        finally:
            common.release()

    return docs.withColumn(out, scored(F.col(text)))
