"""Operators on small fixtures worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from trajectra import plans
from trajectra.functions import metrics, text
from trajectra.operators import evaluation, graph, ordering, planning, registered, retrieval, training, trajectory
from trajectra.sources import readers, sinks, tables
from trajectra.sources.working import working

SEQS = {"q1": "abc", "q2": "ab", "q3": "baca", "q4": "c", "q5": "aab"}


@pytest.fixture
def steps(spark):
    rows = [(t, i, x, "k") for t, s in SEQS.items() for i, x in enumerate(s)]
    return spark.createDataFrame(rows, "task_id string, pos int, tool string, category string")


def test_transition_graph(steps):
    found = {(r.src, r.dst): r for r in graph.weighted(graph.transitions(steps)).collect()}
    want = {
        ("a", "b"): (3.5, 0.7, 0.530628, 0.371440), ("a", "c"): (1.5, 0.3, -0.162519, 0), ("b", "a"): (1.0, 0.4, 0.530628, 0.212251),
        ("b", "c"): (1.5, 0.6, 0.530628, 0.318377), ("c", "a"): (1.0, 1.0, 1.446919, 1.446919),
    }
    assert found.keys() == want.keys()
    for k, v in want.items():
        r = found[k]
        assert (r["count"], r.transition_prob, r.pmi, r.weight) == pytest.approx(v, abs=1e-6)
    kept = graph.pruned(graph.weighted(graph.transitions(steps))).select("src", "dst").collect()
    assert [tuple(r) for r in kept] == [("a", "b")]


def test_positions(steps):
    assert {r.tool: r.avg_pos for r in trajectory.mean_positions(steps).collect()} == pytest.approx({"a": 0.222222, "b": 0.375, "c": 0.388889}, abs=1e-6)


def test_bm25(spark):
    docs = spark.createDataFrame([(1, "get weather data"), (2, "get stock price"), (3, "send email email"), (4, None)], "doc_id int, text string")
    asked = spark.createDataFrame([(1, "get weather"), (2, "send email"), (3, "get get price")], "item_id int, text string")
    found = {(r.item_id, r.doc_id): round(r.score, 6) for r in retrieval.bm25(asked, docs).collect()}
    assert found == {(1, 1): 1.450833, (1, 2): 0.470004, (2, 3): 2.382014, (3, 1): 0.940007, (3, 2): 1.920837}


def test_text(spark):
    df = spark.createDataFrame([("Thought: t\nAction: foo_for_bar\nAction Input: {}", '{"error":""}', "Step 12: find x", "a_for_b_for_c", '1. B -> a -> "C"')], "turn string, result string, task string, tool string, ranked string")
    r = df.select(
        text.action_name(F.col("turn")), text.call_succeeded(F.col("result")), text.task_text(F.col("task")), text.category(F.col("tool")),
        text.endpoint(F.col("tool")), text.ranked_names(F.col("ranked")), text.action_name(F.lit("Action: Finish")), text.call_succeeded(F.lit("no")),
        text.collapsed(F.array(*map(F.lit, "aabba"))), text.trajectory_succeeded(F.array(F.lit("give_up_and_restart"), F.lit("give_answer"))),
        text.trajectory_succeeded(F.array(F.lit("give_answer"), F.lit("give_up_and_restart"))),
        text.category(F.lit("plain"), F.lit("?")),
    ).first()
    assert tuple(r) == ("foo_for_bar", True, "find x", "c", "a_for_b", ["b", "a", "c"], None, False, ["a", "b", "a"], True, False, "?")


def test_literals_as_python_reads_them(spark):
    """Tool lists by the column expression against ast.literal_eval."""
    import ast
    import random

    rng, rows = random.Random(1), []
    pieces = ["a", "'", '"', "\\", "\n", "\t", "é", "\x07", "don't", "\\n", "{", "}", "[", ", ", ": ", "None", "True", "🙂", "\x85", "/"]
    for _ in range(300):
        tools = []
        for _ in range(rng.randint(0, 4)):
            tool = {"name": "".join(rng.choices(pieces, k=rng.randint(0, 5))) if rng.random() < 0.8 else "Finish"}
            if rng.random() < 0.8:
                tool["description"] = "".join(rng.choices(pieces, k=rng.randint(0, 9))) if rng.random() < 0.9 else None
            if rng.random() < 0.5:
                tool["more"] = {"x": [1, 2.5, -3e-5, None, True, False, "it's"], "y": {}}
            tools.append(tool)
        rows.append(repr(tools))
    rows += ["[{'name': 'a', 'description': 'unfinished}]", "[{'name': f(1)}]", "[{'name': 'x' 'y'}]", "[{'name': 'a',},]", r"[{'name': '\d\x41'}]"]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, raw string")
    said = F.concat(F.lit("Specifically, you have access to the following APIs: "), "raw")
    got = {r.i: [tuple(t) for t in r.t] for r in df.select("i", text.tool_list(said).alias("t")).collect()}
    for i, raw in enumerate(rows):
        try:
            want = ast.literal_eval(raw)
        except (SyntaxError, ValueError):
            want = []
        if "'x' 'y'" in raw:
            want = []  # literals side by side are left out
        tools = [(t["name"], (t.get("description") or "").strip().rstrip('"')) for t in want if t["name"] not in ("", "Finish")]
        assert got[i] == tools, raw


def test_descriptions_of_their_own_objects(spark):
    raw = '{"name": "a"} {"name": "b", "description": "of b"} {"name":"c","x":1} { "name" : "d", "y": 2, "description" : "of d"} {"description": "e", "name": "f"}'
    got = spark.createDataFrame([(raw,), (None,), ("",)], "raw string").select(text.described_apis(F.col("raw")).alias("t")).collect()
    assert [None if r.t is None else [tuple(t) for t in r.t] for r in got] == [[("b", "of b"), ("d", "of d")], None, []]


def test_chats(spark, tmp_path):
    chat = [
        {"id": "x", "conversations": [
            {"from": "system", "value": "Specifically, you have access to the following APIs: [{'name': 'get_for_w', 'description': 'Got it'}, {'name': 'get_for_w', 'description': \"Gets 'it'\"}, {'name': 'Finish', 'description': 'f'}]"},
            {"from": "user", "value": "Step 1: ask"}, {"from": "assistant", "value": "Action: get_for_w\nAction Input: {}"},
            {"from": "function", "value": '{"error": "", "response": "r"}'}, {"from": "assistant", "value": "Action: Finish give_answer"},
        ]},
        {"id": "y", "conversations": None},
    ]
    (tmp_path / "chats.json").write_text(json.dumps(chat))
    assert readers.chats(spark, f"{tmp_path}/none.json").count() == 0
    rows = trajectory.successful(trajectory.from_chats(readers.chats(spark, f"{tmp_path}/chats.json"))).collect()
    assert [(r.task_id, r.task_description, r.tool_details[0].description, r.tool_details[0].call_success) for r in rows] == [("x", "ask", "Gets 'it'", True)]


def test_edges_csv(spark, tmp_path, steps):
    edges = graph.weighted(graph.transitions(steps)).withColumnsRenamed({"src": "source", "dst": "target"})
    sinks.csv(edges.select("source", "target", "weight", "count", "pmi", "transition_prob"), f"{tmp_path}/e", [F.desc("weight")], {"weight": 6, "pmi": 4})
    assert readers.edges(spark, f"{tmp_path}/e").count() == 5
    assert "a  " in sinks.report(edges, "edges", ["source", "weight"])


def test_components_and_communities(spark):
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("x", "y", 2.0)], "src string, dst string, weight double")
    found = {r.tool: r.component for r in graph.weak_components(e).collect()}
    assert found == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
    first = spark.createDataFrame([("a",)], "tool string")
    for depth, want in ((None, {"a": 0, "b": 1, "c": 2}), (1, {"a": 0, "b": 1})):
        assert {r.dst: r.hops for r in graph.shortest_paths(e, first, working(spark, "test"), depth).collect()} == want


def test_best_order():
    import numpy as np

    into = np.array([[0, 0, 0.9], [0.5, 0, 0], [0, 0.4, 0]])
    assert ordering.best_order(into, np.array([0.9, 0.5, 0.1]), None) == [2, 0, 1]
    assert ordering.best_order(into, np.array([0.9, 0.5, 0.1]), 0.0) == [0, 1, 2]


def test_best_first_search():
    adjacency = {"a": [("b", 1.0), ("c", 0.1)], "b": [("d", 1.0)], "c": [("d", 1.0)], "d": []}
    sims = {"a": 0.9, "b": 0.5, "c": 0.8, "d": 0.4}
    assert planning.search(adjacency, sims, ["a"], 3) == ["a", "b", "d"]
    assert planning.search(adjacency, sims, [], 3) == []


def test_all_tasks_are_queried(spark, steps):
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<float>")
    found = tables.queries(steps, vectors, working(spark, "test")).orderBy("query_id").collect()
    assert [(r.query_id, r.task_id, list(r.vec), "".join(r.truth), r.k) for r in found] == [
        (i, t, [[1.0, 0.0], [0.0, 1.0]][i % 2], s, max(3, len(s))) for i, (t, s) in enumerate(SEQS.items())
    ]
    d = "/root/testdata/sf0.001"
    assert plans.QUERIES["plan_fallback"](spark, d).select("query_id").distinct().count() == tables.order_steps(spark, d).select("task_id").distinct().count()


def test_pairs_of_all_own_tools(spark):
    names = [f"t{i:03}" for i in range(100)]
    vectors = spark.createDataFrame([(n, [1.0, i / 100]) for i, n in enumerate(names)], "tool string, vec array<float>")
    truth = ["t001", "t050", "t002", "t001", "t099"]
    q = spark.createDataFrame([(0, [0.0, 1.0], truth, 5)], "query_id long, vec array<float>, truth array<string>, k int")
    links = spark.createDataFrame([("t001", "t002", 0.5)], "src string, dst string, w double")
    rows = training.pair_rows(planning.linked(planning.own_tools(q, vectors), links), q.select("query_id", "truth")).collect()
    before = {(a, b) for i, a in enumerate(truth) for b in truth[i + 1 :]}  # with (t001, t001), and both orders of t001 and others
    assert sorted((r.a, r.b, r.label) for r in rows) == sorted([(a, b, 1) for a, b in before] + [(b, a, 0) for a, b in before])
    assert all(r[i] == 0 for r in rows if r.a == r.b for i in range(4, len(r)))
    frequency = spark.createDataFrame([(n, 1000 - i) for i, n in enumerate(names)], "tool string, frequency long")
    many = retrieval.most_frequent(q.withColumn("k", F.lit(90)), frequency).orderBy("rank").collect()
    assert [r.tool for r in many] == names[:90]
    d = "/root/testdata/sf0.001"
    pairs, tasks = plans.QUERIES["pair_training_rows"](spark, d), tables.sequences(tables.order_steps(spark, d))
    want = sum(2 * len({(a, b) for i, a in enumerate(r.seq) for b in r.seq[i + 1 :]}) for r in tasks.collect())
    assert pairs.count() == want


def test_bridges_of_any_length(spark):
    chain = [f"c{i:02}" for i in (0, 9, 1, 8, 2, 7, 3, 6, 4, 5)] + ["c10", "c11"]
    bridge = ["c11", "x1", "x2", "x3", "x4", "far"]
    edges = spark.createDataFrame([*zip(chain, chain[1:]), *zip(bridge, bridge[1:])], "src string, dst string")
    tools = [*sorted(chain), "far"]
    # the chain's end leads on and is among its best three
    order = ["c11", *[t for t in tools if t != "c11"]]
    cands = spark.createDataFrame([(0, t, 1.0 - i / 100, i, 3) for i, t in enumerate(order)], "query_id long, tool string, sim double, rank int, k int")
    q = spark.createDataFrame([(0, [1.0], 3)], "query_id long, vec array<float>, k int")
    vectors = spark.createDataFrame([(t, [0.0]) for t in {*chain, *bridge}], "tool string, vec array<float>")
    found = {r.tool for r in planning.with_bridges(cands, edges, q, vectors, working(spark, "test")).collect()}
    assert found == {*chain, *bridge}
    ring = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "src string, dst string")
    ends = spark.createDataFrame([("a", "c"), ("a", "z"), ("q", "a")], "src string, dst string")
    assert [tuple(r) for r in graph.paths_between(ring, ends, working(spark, "test")).collect()] == [("a", "c", ["a", "b", "c"])]
    assert planning.with_bridges(cands.where("tool <> 'far'"), edges, q, vectors, working(spark, "test")).count() == len(chain)


def test_grow_takes_the_best_of_all_tools():
    import random

    rng = random.Random(4)
    tools = [f"t{i:02d}" for i in range(40)]
    for _ in range(30):
        sims = {t: round(rng.uniform(-1, 1), 2) for t in tools}
        links = {t: [(u, rng.random()) for u in rng.sample(tools, 6) if u != t] for t in tools}
        order, chosen = sorted(tools, key=lambda t: (-sims[t], t)), []
        weight = {(a, b): w for a, out in links.items() for b, w in out}
        while len(chosen) < 7:
            value = lambda t: 0.5 * max((weight.get((c, t), 0.0) for c in chosen), default=0.0) + 0.5 * sims[t]
            left = [t for t in order if t not in chosen]
            chosen.append(left[0] if not chosen else min(left, key=lambda t: (-round(value(t), 9), order.index(t))))
        assert planning.grow(sims, links, 7, 0.5) == chosen


def test_json_object_is_one_document(spark, tmp_path):
    import json

    path = f"{tmp_path}/object"
    sinks.json_object(spark.createDataFrame([("b", 2), ("a", 1), (None, 3)], "k string, v int").repartition(3), "k", "v", path)
    assert json.loads("".join(r.value for r in spark.read.text(path).collect())) == {"a": 1, "b": 2}


def test_similar_examples(spark):
    """Examples are different, of neighbouring lengths, or of any length if there are none."""
    pool = spark.createDataFrame([(i, 2 + i % 3) for i in range(30)], "task_id long, num_steps int")
    targets = spark.createDataFrame([(100, 2), (101, 4), (102, 9)], "task_id long, num_steps int")
    found = trajectory.similar_examples(targets, pool, 4).collect()
    assert len(found) == 12
    for task, allowed in ((100, {2, 3}), (101, {3, 4}), (102, {2, 3, 4})):
        mine = [r.example for r in found if r.task_id == task]
        assert len(set(mine)) == 4 and {2 + x % 3 for x in mine} <= allowed
    few = trajectory.similar_examples(targets, pool.where("task_id < 2"), 4).groupBy("task_id").count().collect()
    assert {r.task_id: r["count"] for r in few} == {100: 2, 101: 1, 102: 2}
    assert trajectory.similar_examples(targets, pool.where("false")).count() == 0


def test_non_edges(spark):
    nodes = spark.createDataFrame([(f"t{i}",) for i in range(20)], "tool string")
    edges = spark.createDataFrame([(f"t{i}", f"t{(i + 1) % 20}") for i in range(20)], "src string, dst string")
    drawn = [tuple(r) for r in graph.non_edges(nodes, edges).collect()]
    assert 10 < len(drawn) == len(set(drawn)) <= 20
    assert not {tuple(r) for r in edges.collect()} & set(drawn) and all(a != b for a, b in drawn)


def test_plan_by_learned_scores(spark):
    """The chain of greatest scores from the most similar tool on, against a plain loop."""
    names = "abcdef"
    vectors = spark.createDataFrame([(t, [1.0 - 0.1 * i, 0.1 * i]) for i, t in enumerate(names)], "tool string, vec array<double>")
    score = {(a, b): ((i * 7 + j * 5) % 11) / 11 for i, a in enumerate(names) for j, b in enumerate(names) if a != b}
    learned = spark.createDataFrame([(a, b, w) for (a, b), w in score.items()], "src string, dst string, weight double")
    queries = spark.createDataFrame([(1, [1.0, 0.0], 3), (2, [0.0, 1.0], 3)], "query_id long, vec array<double>, k int")
    found = {r.query_id: list(r.seq) for r in planning.by_learned(queries, vectors, learned, 4, 1).collect()}
    for q, pool in ((1, "abcdef"), (2, "fedcba")):
        seq, left = [pool[0]], list(pool[1:])
        while len(seq) < 4:
            best = max(left, key=lambda t: score[seq[-1], t])
            seq.append(best)
            left.remove(best)
        assert found[q] == seq


def test_registered_functions(spark):
    """The SQL functions give what the column functions give, and the table function what the search gives."""
    rows = [(1, "abc", "abd"), (2, "cba", "abc"), (3, "", "ab"), (4, None, "ab"), (5, "ab", ""), (6, "abab", "baab"), (7, "xyabz", "abz"), (8, None, None)]
    rows = [(i, None if p is None else list(p), None if g is None else list(g)) for i, p, g in rows]
    df = spark.createDataFrame(rows, "i int, p array<string>, g array<string>")
    df.createOrReplaceTempView("some_predictions")
    assert set(registered.FUNCTIONS) < set(registered.register(spark))
    none = F.array().cast("array<string>")
    same = {
        "seq_precision_at_k": metrics.precision_at, "seq_recall_at_k": metrics.recall_at, "seq_hit_rate": metrics.hit_rate, "seq_jaccard": metrics.jaccard,
        "seq_set_precision": metrics.set_precision, "seq_set_recall": metrics.set_recall, "seq_set_f1": metrics.set_f1, "seq_lcs": metrics.lcs,
        "seq_lcs_recall": metrics.lcs_recall, "seq_ordered_overlap": metrics.ordered_overlap, "seq_ordered_precision": metrics.ordered_precision,
        "seq_first_accuracy": metrics.first_accuracy,
    }
    assert same.keys() == registered.FUNCTIONS.keys()
    got = spark.sql(f"SELECT {', '.join(f'{n}(p, g) AS {n}' for n in same)} FROM some_predictions ORDER BY i").collect()
    base = df.select("i", F.coalesce("p", none).alias("p"), F.coalesce("g", none).alias("g")).orderBy("i")
    for a, b in zip(got, base.select(*[f(F.col("p"), F.col("g")).alias(n) for n, f in same.items()]).collect(), strict=True):
        assert a.asDict() == pytest.approx(b.asDict(), abs=1e-12)
    found = spark.sql(
        "SELECT s.* FROM (SELECT array(named_struct('src', 'a', 'dst', 'b', 'weight', 0.9D), named_struct('src', 'b', 'dst', 'c', 'weight', 0.8D)) AS e,"
        " map('a', 0.9D, 'b', 0.5D, 'c', 0.4D) AS m), LATERAL seq_best_first(e, m, array('a'), 3) s"
    ).collect()
    assert [r.tool for r in found] == planning.search({"a": [("b", 0.9)], "b": [("c", 0.8)]}, {"a": 0.9, "b": 0.5, "c": 0.4}, ["a"], 3)


def test_matched_names_and_lengths(spark):
    lists = spark.createDataFrame([(1, ["x", "b", "A", "B", "c"]), (2, []), (3, None)], "key int, names array<string>")
    tools = spark.createDataFrame([("a",), ("B",), ("c",), ("C",)], "tool string")
    found = evaluation.matched_names(lists, tools, 2).orderBy("rank").collect()
    assert [tuple(r) for r in found] == [(1, 0, "B"), (1, 1, "a")]
    preds = spark.createDataFrame([(1, "m", ["a"], None), (2, "m", [], ["a", "b"])], "query_id int, method string, p array<string>, g array<string>")
    assert [tuple(r)[2:] for r in evaluation.lengths(preds).orderBy("query_id").collect()] == [(1, 0), (0, 2)]


def test_result_files(spark, tmp_path):
    (tmp_path / "one.csv").write_text("method,F1\nbeam,0.5\nhybrid,bad\n")
    found = readers.results(spark, str(tmp_path / "one.csv"), "method string, f1 double, tau double").collect()
    assert [tuple(r) for r in found] == [("beam", 0.5, None), ("hybrid", None, None)]
    import os

    os.utime(tmp_path / "one.csv", (1_000_000, 1_000_000))
    (tmp_path / "two.csv").write_text("method\n")
    names = [r.path.rsplit("/", 1)[-1] for r in readers.newest(spark, str(tmp_path), "*.csv").collect()]
    assert names == ["two.csv", "one.csv"]


def test_first_rows_and_prompts(spark):
    rows = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 3, "z")], "k string, n int, v string")
    assert sorted((r.k, r.v) for r in trajectory.first_of_key(rows, "k", F.col("n")).collect()) == [("a", "y"), ("b", "z")]
    one = spark.createDataFrame([("do it", ["t1", "t2"], [("ex", ["a", "b"])])], "task string, tools array<string>, ex array<struct<task: string, seq: array<string>>>")
    prompt = one.select(text.few_shot_prompt(F.col("task"), F.col("tools"), F.col("ex"))).first()[0]
    assert prompt.startswith("Task: ex\nAnswer: a -> b\n\nTask: do it\nTools: t1, t2")
    assert one.select(text.shown_plan(F.array(F.lit("get_for_x"), F.lit("put")), F.lit("beam"), F.lit(0.5))).first()[0] == "[beam] get -> put (0.5000)"


def test_hashed_tfidf_as_an_encoder(spark):
    docs = spark.createDataFrame([(1, "get weather data"), (2, "get stock price"), (3, "send email"), (4, None)], "doc_id int, text string")
    model = retrieval.hashed_tfidf(docs)
    vec = {r.doc_id: r.vec.toArray() for r in model.transform(docs.where("text IS NOT NULL")).collect()}
    assert all(abs((v @ v) - 1) < 1e-9 for v in vec.values()) and vec[1] @ vec[2] > vec[1] @ vec[3]
