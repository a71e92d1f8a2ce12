"""Metrics against values worked out by hand; the last rows pin the rules for repeats."""

import pytest
from pyspark.sql import functions as F

from trajectra.functions import metrics

#: prediction, truth, then p@K, r@K, f1@K, hit, jaccard, set p, r, f1, LCS, LCS-R, overlap, ordered, transition, first, tau-b
ROWS = """
abcd bdac 1 1 1 1 1 1 1 1 2 .5 .5 .5 .666667 0 0
abc abc 1 1 1 1 1 1 1 1 3 1 1 1 1 1 1
cba abc 1 1 1 1 1 1 1 1 1 .333333 .333333 0 0 0 -1
acb abc 1 1 1 1 1 1 1 1 2 .666667 .666667 .666667 .5 1 .333333
xyz abc 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0
- ab 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0
abd ab 1 1 1 1 .666667 .666667 1 .8 2 1 .666667 1 1 1 1
aba ab 1 1 1 1 1 1 1 1 2 1 .666667 .333333 0 1 0
ab aba .666667 1 .8 1 1 1 1 1 2 .666667 .666667 0 .5 1 -1
a a 1 1 1 1 1 1 1 1 1 1 1 0 0 1 0
"""
FUNCTIONS = [
    metrics.precision_at, metrics.recall_at, metrics.f1_at, metrics.hit_rate, metrics.jaccard, metrics.set_precision,
    metrics.set_recall, metrics.set_f1, metrics.lcs, metrics.lcs_recall, metrics.ordered_overlap, metrics.ordered_precision,
    metrics.transition_accuracy, metrics.first_accuracy, metrics.kendall_tau,
]


def test_by_hand(spark):
    rows = [r.split() for r in ROWS.strip().split("\n")]
    df = spark.createDataFrame([([] if r[0] == "-" else list(r[0]), list(r[1]), i) for i, r in enumerate(rows)], "p array<string>, g array<string>, i int")
    found = df.select("i", *[f(F.col("p"), F.col("g")).cast("double").alias(f.__name__) for f in FUNCTIONS]).orderBy("i").collect()
    for row, want in zip(found, rows, strict=True):
        assert list(row)[1:] == pytest.approx([float(x) for x in want[2:]], abs=1e-6), want[:2]
