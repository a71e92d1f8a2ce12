"""Distributed descent, the pairwise net, the graph encoder and the link data set, against plain code."""

import math
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajectra.operators import descent, evaluation, links, ordering, training
from trajectra.sources import tables
from trajectra.sources.working import working


def _slopes(net, params, row):
    """The gradient by differences."""
    size = sum(v.size for v in params.values())
    flat, out = descent._flat(params), np.zeros(size)
    for i in range(size):
        for sign in (1, -1):
            moved = flat.copy()
            moved[i] += sign * 1e-5
            out[i] += sign * descent.sums(net, descent._shaped(moved, params), row)[size] / 2e-5
    return out


def test_gradients():
    rng = np.random.default_rng(0)
    encoder = links.Encoder(4, 6, 3)
    tools, pairs = 7, 12
    of_links = SimpleNamespace(
        z=rng.normal(size=(tools, 4, 8)).astype(np.float32).tobytes(), there=rng.integers(0, 2, (tools, 3)).astype(np.uint8).tobytes(),
        src=rng.integers(0, tools, pairs), dst=rng.integers(0, tools, pairs), label=rng.integers(0, 2, pairs), part="train",
    )
    of_pairs = SimpleNamespace(x=rng.normal(size=(9, 8)).tobytes(), label=rng.integers(0, 2, 9), part="train")
    for net, row in ((encoder, of_links), (training.PairNet(8, (6, 5)), of_pairs)):
        params = {k: v + rng.normal(0, 0.1, v.shape) for k, v in net.start(rng).items()}
        got = descent.sums(net, params, row)
        assert np.allclose(got[: sum(v.size for v in params.values())], _slopes(net, params, row), atol=1e-6)


def test_area():
    assert descent.area(np.array([0, 0, 2]), np.array([1, 1, 0])) == 1.0
    assert descent.area(np.array([1, 0, 1]), np.array([1, 0, 1])) == 0.5
    assert descent.area(np.array([0, 0]), np.array([1, 1])) == 0.5


@pytest.fixture(scope="module")
def pairs(spark):
    rng = np.random.default_rng(3)
    names = [f"d_{i}" for i in range(8)]
    rows = []
    for q in range(400):
        x = rng.normal(size=8)
        first = x[0] + x[1] * x[2] > 0
        rows += [(q, "a", "b", int(first), *map(float, x)), (q, "b", "a", int(not first), *map(float, -x))]
    return spark.createDataFrame(rows, "query_id long, a string, b string, label int, " + ", ".join(f"{n} double" for n in names)).repartition(5)


def test_one_epoch_of_the_pair_net_in_plain_numpy(spark, pairs, monkeypatch):
    blocks = training.pair_blocks(pairs, working(spark, "test"), size=64)
    rows = blocks.collect()
    net = training.PairNet()
    params = net.start(np.random.default_rng(42))
    total = np.sum([descent.sums(net, params, r) for r in rows], axis=0)
    size = sum(v.size for v in params.values())
    assert total[size + 1] + total[size + 3] == 800 and 40 < total[size + 3] < 160  # about a tenth is for validation
    slope = total[:size] / total[size + 1]
    want = descent._flat(params) - 1e-3 * slope / (np.abs(slope) + 1e-8)  # Adam's first step
    monkeypatch.setattr(descent, "FAN", 1)  # sums go through a tree
    got = descent.train(blocks, net, epochs=1, patience=5, by="val_loss")
    assert np.allclose(descent._flat(got.params), want, atol=1e-9)
    assert got.epoch == 1 and got.history[0]["loss"] == pytest.approx(total[size] / total[size + 1])
    assert got.history[0]["val_loss"] == pytest.approx(total[size + 2] / total[size + 3])


def test_pair_net_learns_and_stops(spark, pairs):
    test = F.col("query_id") % 4 == 0
    net = training.pair_net(pairs.where(~test), working(spark, "test"), epochs=25, patience=5, batches=2, rate=3e-2)
    found = training.pair_predictions(net, pairs.where(test)).collect()
    assert sum((r.probability > 0.5) == (r.label == 1) for r in found) / len(found) > 0.75
    losses = [h["val_loss"] for h in net.history]
    assert net.epoch == 1 + int(np.argmin(losses[1:])) or losses[net.epoch] <= min(losses[1:]) + 1e-5
    # a rate that makes it worse at once: training ends `patience` epochs after the best one, whose parameters are kept
    wild = training.pair_net(pairs, working(spark, "test"), epochs=40, patience=3, batches=2, rate=3.0)
    assert len(wild.history) - 1 <= wild.epoch + 3 < 40
    first = descent.train(training.pair_blocks(pairs, working(spark, "test"), batches=2), training.PairNet(), wild.epoch, 40, 3.0, 2, by="val_loss")
    assert first.history[wild.epoch]["val_loss"] == pytest.approx(wild.history[wild.epoch]["val_loss"], rel=1e-6)


def test_order_by_the_net(spark):
    entry = "array<struct<rank: int, tool: string, sim: double, pos: double, into: array<double>>>"
    c = [(0, "a", 0.9, 0.1, [0.0, 0.3, 0.0]), (1, "b", 0.8, 0.5, [0.7, 0.0, 0.1]), (2, "c", 0.1, 0.9, [0.0, 0.9, 0.0])]
    rows = spark.createDataFrame([(7, 3, c), (8, 3, c[:1])], f"query_id long, k int, c {entry}")
    net = training.PairNet()
    fitted = descent.Fitted(net, net.start(np.random.default_rng(1)), 0)
    f = {r.rank: [r.sim, r.f_rank, r.sum_out, r.sum_in, r.max_out, r.max_in, r.position, r.size] for r in ordering.features(rows.where("query_id = 7")).collect()}
    score = {i: sum(1 / (1 + math.exp(-net.logits(fitted.params, np.array([f[i]]) - np.array([f[j]]))[0][0])) for j in f if j != i) for i in f}
    got = ordering.by_net(rows, fitted).orderBy("query_id", "pos").collect()
    want = sorted(f, key=lambda i: (-round(score[i], 9), i))
    assert [(r.query_id, r.pos, r.tool) for r in got] == [(7, p, c[i][1]) for p, i in enumerate(want)] + [(8, 0, "a")]
    assert [r.score for r in got[:3]] == pytest.approx([score[i] for i in want])


def _planted(spark):
    """Tools of six kinds; a link leads to the next kind. Neither vector nor product tells, only both together do."""
    rng = np.random.default_rng(11)
    kind = rng.integers(0, 6, 90)
    vec = np.eye(6)[kind] + rng.normal(0, 0.3, (90, 6))
    names = [f"t{i:02}" for i in range(90)]
    vectors = spark.createDataFrame([(n, [float(x) for x in v]) for n, v in zip(names, vec, strict=True)], "tool string, vec array<double>")
    near = [(names[i], names[j]) for i in range(90) for j in range(90) if i != j and kind[j] == (kind[i] + 1) % 6 and rng.random() < 0.5]
    return vectors, spark.createDataFrame(near, "src string, dst string")


def test_encoder_on_a_planted_graph(spark):
    vectors, positive = _planted(spark)
    keep = working(spark, "planted")
    rows = keep(training.with_negatives(positive, tables.numbered(vectors.select("tool"), "tool", keep), keep, ratio=2), "rows")
    message, test = rows.where("label = 1 AND part = 'train'"), rows.where("part = 'test'").select("src", "dst", "label")
    net, encoded = links.fit(rows, vectors, message, keep, hidden=16, epochs=40, patience=6, rate=2e-2)
    auc = evaluation.link_scores(links.scores(net, test, encoded).join(test, ["src", "dst"]), "score", "label").first().auc
    means = training.link_features(rows, training.encoded(vectors, message))
    plain = training.link_probabilities(training.link_model(means.where("part = 'train'")), means.where("part = 'test'"), -1.0)
    averaged = evaluation.link_scores(plain.join(test, ["src", "dst"]), "score", "label").first().auc
    assert auc > 0.8 and auc > averaged + 0.05
    areas = [h["val_auc"] for h in net.history]
    assert areas[net.epoch] == max(areas[1:]) and len(areas) - 1 <= net.epoch + 6
    # all pairs, block by block, against the given ones
    found = {(r.src, r.dst): r.score for r in links.all_scores(net, encoded, working(spark, "all"), 0.3).collect()}
    some = {(r.src, r.dst): r.score for r in links.scores(net, test, encoded).collect()}
    assert {k: v for k, v in some.items() if v > 0.3} == pytest.approx({k: v for k, v in found.items() if k in some})
    assert links.all_scores(net, encoded, working(spark, "all"), -1.0).count() == 90 * 89


def test_examples_hold_each_tool_once(spark):
    vectors = spark.createDataFrame([(t, [float(i), 1.0]) for i, t in enumerate("abcd")], "tool string, vec array<double>")
    edges = spark.createDataFrame([("a", "b"), ("c", "b"), ("d", "b"), ("b", "a")], "src string, dst string")
    keep = working(spark, "test")
    nodes = keep(links.neighbourhoods(vectors, edges, sample=2), "nodes")
    got = {r.tool: r for r in nodes.collect()}
    assert got["b"].z == [1.0, 1.0, pytest.approx(5 / 3), 1.0] and len(got["b"].near) == 2
    assert got["c"].z == [2.0, 1.0, 0.0, 0.0] and got["c"].near == [] and got["a"].near == [got["b"].z]
    rows = [("a", "b", 1, "train"), ("b", "c", 0, "train"), ("a", "d", 0, "val"), ("a", "zz", 1, "train"), ("d", "a", 1, "train")]
    blocks = links.examples(spark.createDataFrame(rows, "src string, dst string, label int, part string"), nodes, keep, 2, size=2).collect()
    assert sorted((r.part, len(r.label)) for r in blocks) in ([("train", 1), ("train", 2), ("val", 1)], [("train", 1)] * 3 + [("val", 1)])
    for r in blocks:
        z = np.frombuffer(r.z, np.float32).reshape(-1, 3, 4)
        assert len(z) == len(set(r.src) | set(r.dst)) and len({x.tobytes() for x in z[:, 0]}) == len(z)


def test_negatives_are_exact(spark):
    names = [f"t{i}" for i in range(12)]
    tools = spark.createDataFrame([(t, i) for i, t in enumerate(names)], "tool string, n long")
    positive = spark.createDataFrame([(names[i], names[(i + 1) % 12]) for i in range(12)], "src string, dst string")
    for ratio, n in ((0, 0), (1, 12), (3, 36), (9, 108), (20, 120)):
        got = training.with_negatives(positive, tools, working(spark, "test"), ratio).collect()
        negative = [(r.src, r.dst) for r in got if r.label == 0]
        assert len(negative) == len(set(negative)) == n and sum(r.label for r in got) == 12
        assert not set(negative) & {tuple(r) for r in positive.collect()} and all(a != b for a, b in negative)
    assert training.with_negatives(positive.limit(0), tools, working(spark, "test")).count() == 0
    few = training.with_negatives(positive, tools, working(spark, "test"), 3).where("label = 0")
    assert few.select("src").distinct().count() > 8  # not the first tools only


def test_tools_beyond_the_vectors_get_one(spark):
    steps = spark.createDataFrame([(t,) for t in "edcba"], "tool string")
    e = spark.createDataFrame([(0, [1.0], 5), (1, [2.0], 6)], "vec_id long, embedding array<double>, label int")
    got = tables.tool_vectors(steps, e, working(spark, "test")).orderBy("tool").collect()
    assert [(r.tool, r.vec, r.community) for r in got] == [(t, [[1.0], [2.0]][i % 2], 5 + i % 2) for i, t in enumerate("abcde")]
