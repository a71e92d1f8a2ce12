"""Graph operators of any size against plain code on the driver."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from trajectra.operators import evaluation, graph, planning
from trajectra.sources.working import working


def _sequential(edges):
    """Communities by greedy moves of one node after the other, and aggregation."""
    weight = defaultdict(lambda: defaultdict(float))
    for u, v, w in edges:
        weight[u][v] += w
        weight[v][u] += w
    member = {n: n for n in weight}
    while True:
        total = sum(sum(x.values()) for x in weight.values())
        degree = {n: sum(x.values()) for n, x in weight.items()}
        of, mass, any_moved = {n: n for n in weight}, dict(degree), False
        moved = True
        while moved:
            moved = False
            for n in sorted(weight):
                mass[of[n]] -= degree[n]
                near = defaultdict(float)
                for m, w in weight[n].items():
                    if m != n:
                        near[of[m]] += w
                best = max([of[n], *near], key=lambda c: (round(near.get(c, 0.0) - mass[c] * degree[n] / total, 12), c == of[n]))
                moved |= best != of[n]
                of[n] = best
                mass[best] += degree[n]
            any_moved |= moved
        if not any_moved:
            return member
        member = {n: of[c] for n, c in member.items()}
        merged = defaultdict(lambda: defaultdict(float))
        for n, x in weight.items():
            for m, w in x.items():
                merged[of[n]][of[m]] += w
        weight = merged


def _modularity(edges, member):
    total = 2 * sum(w for *_, w in edges)
    mass, inside = defaultdict(float), 0.0
    for u, v, w in edges:
        mass[member[u]] += w
        mass[member[v]] += w
        inside += 2 * w * (member[u] == member[v])
    return inside / total - sum(m * m for m in mass.values()) / total**2


def test_communities_are_as_good_as_sequential_ones(spark):
    two = [("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 1.0), ("x", "y", 1.0), ("y", "z", 1.0), ("x", "z", 1.0), ("c", "x", 0.1)]
    schema = "src string, dst string, weight double"
    found = {r.tool: r.community for r in graph.louvain(spark.createDataFrame(two, schema), working(spark, "test")).collect()}
    assert found["a"] == found["b"] == found["c"] != found["x"] == found["y"] == found["z"]
    rng = random.Random(3)
    names = [f"n{i:03}" for i in range(120)]
    edges = [(a, b, rng.uniform(0.5, 2)) for i, a in enumerate(names) for j, b in enumerate(names[:i]) if rng.random() < (0.4 if i % 8 == j % 8 else 0.015)]
    got = {r.tool: r.community for r in graph.louvain(spark.createDataFrame(edges, schema), working(spark, "test")).collect()}
    assert got.keys() == {n for e in edges for n in e[:2]} and set(got.values()) <= got.keys()
    assert _modularity(edges, got) >= 0.99 * _modularity(edges, _sequential(edges))
    assert graph.louvain(spark.createDataFrame([], schema), working(spark, "test")).count() == 0


def _strong(nodes, links):
    reach = {n: {n} for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            for n in nodes:
                if a in reach[n] and b not in reach[n]:
                    reach[n].add(b)
                    changed = True
    return {n: min(m for m in reach[n] if n in reach[m]) for n in nodes}


def test_components_and_layers_of_any_depth(spark):
    schema = "src string, dst string"
    rng = random.Random(7)
    names = [f"n{i:02}" for i in range(24)]
    for density in (0.03, 0.08):
        links = [(a, b) for a in names for b in names if a != b and rng.random() < density]
        nodes = {n for e in links for n in e}
        got = {r.tool: r for r in graph.topological_order(spark.createDataFrame([*links, (names[0], names[0])], schema), working(spark, "test")).collect()}
        want = _strong(nodes | {names[0]}, links)
        assert {n: r.component for n, r in got.items()} == want
        layer = {c: 0 for c in want.values()}
        for _ in layer:
            for a, b in links:
                if want[a] != want[b]:
                    layer[want[b]] = max(layer[want[b]], layer[want[a]] + 1)
        assert {n: r.layer for n, r in got.items()} == {n: layer[c] for n, c in want.items()}
        assert {n for n, r in got.items() if r.cyclic} == {n for n, c in want.items() if sum(x == c for x in want.values()) > 1}
    chain = [f"c{i:02}" for i in range(40)]  # deeper than any limit of rounds would be
    got = {r.tool: r.layer for r in graph.topological_order(spark.createDataFrame([*zip(chain, chain[1:])], schema), working(spark, "test")).collect()}
    assert got == {c: i for i, c in enumerate(chain)}
    assert graph.topological_order(spark.createDataFrame([], schema), working(spark, "test")).count() == 0


def test_search_in_rounds_equals_the_heap(spark):
    rng = random.Random(5)
    for trial in range(1):
        tools = [f"t{i:02}" for i in range(18)]
        edges = [(a, b, rng.choice([0.02, 0.3, rng.random()])) for a in tools for b in rng.sample(tools, 3) if a != b]
        vec = {t: [rng.uniform(-1, 1), rng.uniform(-1, 1)] for t in tools}
        asked = [(q, [rng.uniform(-1, 1), rng.uniform(-1, 1)], 3) for q in range(6)]
        vectors = spark.createDataFrame(list(vec.items()), "tool string, vec array<double>")
        queries = spark.createDataFrame(asked, "query_id long, vec array<double>, k int")
        e = spark.createDataFrame(edges, "src string, dst string, weight double")
        for expansions in (1500, 5):
            heap = planning.best_first(queries, vectors, e, entries=3, expansions=expansions)
            rounds = planning.best_first(queries, vectors, e, entries=3, expansions=expansions, keep=working(spark, "test"), most=5)
            assert sorted((r.query_id, r.seq) for r in heap.collect()) == sorted((r.query_id, r.seq) for r in rounds.collect()), (trial, expansions)


def test_random_graph_has_as_many_edges(spark):
    e = spark.createDataFrame([(f"t{i}", f"t{(i * 3 + 1) % 30}", 1.0) for i in range(30) if i != (i * 3 + 1) % 30], "src string, dst string, weight double")
    got = [tuple(r) for r in planning.random_graph(e, working(spark, "test")).select("src", "dst").collect()]
    assert len(got) == len(set(got)) == e.count() and all(a != b for a, b in got)
    other = [tuple(r) for r in planning.random_graph(e, working(spark, "test"), seed="7").select("src", "dst").collect()]
    assert set(got) != set(other)


def test_bootstrap_in_plain_code(spark):
    rng = np.random.default_rng(2)
    deltas = [(i * 7, float(x)) for i, x in enumerate(rng.normal(0.05, 0.3, 90))]
    got = evaluation.bootstrap(spark.createDataFrame(deltas, "query_id long, delta double"), 500).first()
    bounds = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(9)]
    means = []
    for r in range(500):
        total = n = 0.0
        for q, x in deltas:
            h = hashlib.md5(f"42:{r // 8}:{q}".encode()).hexdigest()
            times = sum(int(h[4 * (r % 8) : 4 * (r % 8) + 4], 16) >= int(65536 * b + 0.5) for b in bounds)
            total, n = total + times * x, n + times
        means.append(total / n)
    assert got.n == 90 and got.mean_delta == pytest.approx(np.mean([x for _, x in deltas]))
    assert (got.lo, got.hi) == pytest.approx(tuple(np.percentile(means, [2.5, 97.5])))
    assert got.p_value == pytest.approx(np.mean(np.array(means) <= 0)) and got.significant == (got.lo > 0)
    # the spread is that of drawing with replacement
    drawn = [np.mean(rng.choice([x for _, x in deltas], 90)) for _ in range(2000)]
    assert np.std(means) == pytest.approx(np.std(drawn), rel=0.12)


def test_plans_of_all_settings(spark):
    """Beams and hybrid plans by setting against the planners themselves, best-first ones against the search."""
    rng = random.Random(9)
    tools = [f"t{i:02}" for i in range(16)]
    vec = {t: [rng.uniform(-1, 1) for _ in range(3)] for t in tools}
    vectors = spark.createDataFrame([(t, v, i % 4) for i, (t, v) in enumerate(vec.items())], "tool string, vec array<double>, community int")
    edges = spark.createDataFrame([(a, b, rng.random(), rng.random()) for a in tools for b in rng.sample(tools, 4) if a != b], "src string, dst string, weight double, transition_prob double")
    positions = spark.createDataFrame([(t, rng.random()) for t in tools[:12]], "tool string, avg_pos double")
    asked = [(q, [rng.uniform(-1, 1) for _ in range(3)], 3 + q % 3) for q in range(5)]
    asked.append((5, asked[0][1], 4))  # the vector of another query with another k
    queries = spark.createDataFrame(asked, "query_id long, vec array<double>, k int")
    tried = [("beam", {"weights": (0.3, 0.5, 0.2), "width": 3}), ("hybrid", {"multiple": 2, "alpha": 0.4, "gamma": 0.2}), ("best_first", {"beta": 0.3, "entries": 5})]
    got = {(r.query_id, r.method): list(r.seq) for r in planning.plans_of_settings(queries, vectors, edges, positions, tried).collect()}
    beams = planning.beam(queries, vectors, edges, width=3, weights=(0.3, 0.5, 0.2)).where("rank = 0").collect()
    assert {r.query_id: list(r.seq) for r in beams} == {q: s for (q, m), s in got.items() if m == "beam"}
    plans = planning.hybrid(queries, vectors, edges, positions, 0.4, 0.2, 2, bridges=False).collect()
    assert {r.query_id: list(r.seq) for r in plans} == {q: s for (q, m), s in got.items() if m == "hybrid"}
    searched = planning.best_first(queries, vectors, edges).collect()
    assert {r.query_id: list(r.seq) for r in searched} == {q: s for (q, m), s in got.items() if m == "best_first"}
    every = planning.settings()
    assert [sum(m == x for m, _ in every) for x in ("best_first", "beam", "hybrid")] == [20, 52, 75]
    assert len(planning.settings(trials=10)) == 30 and planning.settings(10) == planning.settings(10)


def test_nearest_tools_against_all_pairs(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(20, 3))[rng.integers(0, 20, 40)]  # some are equal
    vectors = spark.createDataFrame([(f"t{i:02}", [float(v) for v in row]) for i, row in enumerate(x)], "tool string, vec array<double>")
    for top in (1, 5, 60):
        got = {(r.src, r.dst): r.sim for r in graph.knn(vectors, working(spark, "test"), top).collect()}
        want = {}
        for i in range(40):
            best = sorted((-round(float(x[i] @ x[j]), 9), f"t{j:02}") for j in range(40) if j != i and x[i] @ x[j] > 0)[:top]
            want |= {(f"t{i:02}", n): pytest.approx(-s, abs=1e-8) for s, n in best}
        assert got == want
