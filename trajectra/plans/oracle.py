"""SQL for DuckDB that gives the rows of the queries, where SQL can express them."""

from __future__ import annotations

import math
from textwrap import dedent

#: Common table expressions, in order; each may use those before it.
PARTS = {
    "t1": """
        SELECT l_orderkey AS task_id, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
               l_extendedprice, l_shipdate) - 1)::INT AS pos, replace(p_name, ' ', '_') || '_for_' || lower(p_type) AS tool, lower(p_type) AS category
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "t2": """
        SELECT task_id, (row_number() OVER (PARTITION BY task_id ORDER BY ts, event_id) - 1)::INT AS pos, event_type || '_for_' || category AS tool, category
        FROM (SELECT *, user_id || '_' || strftime(ts, '%Y%m%d') AS task_id, 'k' || (json_extract_string(props, '$.k')::INT % 10) AS category FROM events)""",
    "seqs": "SELECT task_id, list(tool ORDER BY pos) AS seq, count(*)::INT AS num_steps FROM t1 GROUP BY task_id",
    "sized": """
        SELECT *, CASE WHEN num_steps <= 2 THEN '1-2' WHEN num_steps <= 4 THEN '3-4' ELSE '5+' END AS bucket FROM seqs""",
    "splits": """
        SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY md5('42:' || task_id)) <= greatest(1, floor(count(*) OVER (PARTITION BY bucket) * 0.2::DOUBLE)) AS is_test
        FROM sized""",
    "positions": """
        SELECT tool, avg(pos / n) AS avg_pos, count(*) AS n FROM (SELECT *, count(*) OVER (PARTITION BY task_id) AS n FROM t1) GROUP BY tool""",
    "frequency": "SELECT tool, category, count(*) AS frequency FROM t1 GROUP BY tool, category",
    "edges": "{edges:t1}",
    "event_edges": "{edges:t2}",
    "pruned": "SELECT * FROM edges WHERE count >= 3 AND weight >= 0.01",
    "vectors": """
        SELECT tool, embedding::DOUBLE[] AS vec, label AS community FROM (SELECT tool, row_number() OVER (ORDER BY tool) - 1 AS i FROM (SELECT DISTINCT tool FROM t1))
        JOIN embeddings ON vec_id = i % (SELECT count(*) FROM embeddings)""",
    "q": """
        SELECT i AS query_id, task_id, vec_id AS vi, embedding::DOUBLE[] AS vec, seq AS truth, greatest(num_steps, 3) AS k
        FROM (SELECT task_id, seq, num_steps, row_number() OVER (ORDER BY task_id) - 1 AS i FROM seqs) JOIN embeddings ON vec_id = i % (SELECT count(*) FROM embeddings)""",
    "near_": """
        SELECT *, row_number() OVER (PARTITION BY vi ORDER BY round(sim, 9) DESC, tool) - 1 AS rank
        FROM (SELECT vi, tool, list_inner_product(u.vec, v.vec) AS sim FROM (SELECT DISTINCT vi, vec FROM q) u CROSS JOIN vectors v)""",
    "sims": "SELECT query_id, k, tool, sim FROM q JOIN near_ USING (vi)",
    "ranked": "SELECT query_id, k, tool, sim, rank FROM q JOIN near_ USING (vi)",
    "top": "SELECT * FROM ranked WHERE rank < k",
    "knn": """
        SELECT src, dst, sim FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(sim, 9) DESC, dst) AS n FROM
        (SELECT a.tool AS src, b.tool AS dst, list_inner_product(a.vec, b.vec) AS sim FROM vectors a JOIN vectors b ON a.tool <> b.tool)) WHERE n <= 20 AND sim > 0""",
    "comm": "SELECT tool, community, regexp_extract(tool, '^(.*)_for_(.*)$', 2) AS category FROM vectors",
    "und": "SELECT least(src, dst) AS u, greatest(src, dst) AS v, max(weight) AS weight FROM edges GROUP BY 1, 2",
    "meta": """
        SELECT least(a.community, b.community) AS c1, greatest(a.community, b.community) AS c2, sum(weight) AS weight
        FROM edges JOIN comm a ON a.tool = src JOIN comm b ON b.tool = dst WHERE a.community <> b.community GROUP BY 1, 2""",
    "centroids": """
        SELECT community, dim, coalesce(v / nullif(sqrt(sum(v * v) OVER (PARTITION BY community)), 0), 0) AS value FROM
        (SELECT community, dim, sum(w * x) / sum(w) AS v FROM
         (SELECT community, w, unnest(range(len(vec)))::INT AS dim, unnest(vec) AS x FROM vectors JOIN
          (SELECT tool, greatest(0.01::DOUBLE, ln((SELECT count(DISTINCT task_id) FROM t1) / count(DISTINCT task_id))) AS w FROM t1 GROUP BY tool) USING (tool)) GROUP BY 1, 2)""",
    "selected": "{linked:top:edges}",
    "o_sem": "SELECT query_id, list_transform(c, lambda x: x.tool) AS seq FROM selected",
    "o_links": "{greedy:selected:x.links[acc[len(acc)] + 1]:len(c) - 1}",
    "o_strong": "{greedy:selected:0.7::DOUBLE * list_max(list_transform(acc, lambda r: x.links[r + 1])) + (1 - 0.7::DOUBLE) * x.sim:len(c) - 1}",
    "freq_top": "SELECT tool, row_number() OVER (ORDER BY frequency DESC, tool) - 1 AS rank FROM frequency",
    "preds": """
        SELECT query_id, method, seq AS p, truth AS g FROM (
          SELECT query_id, 'frequency' AS method, list(tool ORDER BY rank) AS seq FROM q JOIN freq_top ON rank < k GROUP BY query_id
          UNION ALL SELECT query_id, 'semantic', seq FROM o_sem UNION ALL SELECT query_id, 'semantic_links', seq FROM o_links
          UNION ALL SELECT query_id, 'semantic_strongest', seq FROM o_strong) JOIN q USING (query_id)""",
    "measured": "{measured:preds}",
    "later": "SELECT x.task_id, x.tool AS a, y.tool AS b FROM t2 x JOIN t2 y ON x.task_id = y.task_id AND x.pos < y.pos AND x.tool <> y.tool",
}

_EDGES = """
        SELECT src, dst, count, pmi, transition_prob, transition_prob * greatest(0, pmi) AS weight FROM
        (SELECT src, dst, count, ln(count * sum(count) OVER () / (sum(count) OVER (PARTITION BY src) * sum(count) OVER (PARTITION BY dst))) AS pmi,
                count / sum(count) OVER (PARTITION BY src) AS transition_prob FROM
         (SELECT src, dst, sum(c) AS count FROM
          (SELECT tool AS src, lead(tool, 1) OVER w AS dst, 1.0::DOUBLE AS c FROM {0} WINDOW w AS (PARTITION BY task_id ORDER BY pos)
           UNION ALL SELECT tool, lead(tool, 2) OVER w, 0.5::DOUBLE FROM {0} WINDOW w AS (PARTITION BY task_id ORDER BY pos))
          WHERE dst IS NOT NULL AND src <> dst GROUP BY src, dst))"""
#: One row a query with its candidates by rank and the links that reach each from the others.
_LINKED = """
        SELECT query_id, any_value(k) AS k, list({{'rank': rank, 'tool': tool, 'sim': sim, 'pos': pos, 'links': links}} ORDER BY rank) AS c FROM
        (SELECT b.query_id, b.k, b.rank, b.tool, b.sim, coalesce(any_value(avg_pos), 0.5) AS pos, list(coalesce(e.{2}, 0) ORDER BY a.rank) AS links
         FROM {0} a JOIN {0} b ON a.query_id = b.query_id LEFT JOIN {1} e ON e.src = a.tool AND e.dst = b.tool LEFT JOIN positions p ON p.tool = b.tool
         GROUP BY b.query_id, b.k, b.rank, b.tool, b.sim) GROUP BY query_id"""
_GREEDY = """
        SELECT query_id, list_transform(ranks, lambda r: c[r + 1].tool) AS seq FROM
        (SELECT query_id, c, list_reduce(range(1, {2} + 1), lambda acc, i: CASE WHEN len(acc) >= len(c) THEN acc ELSE list_append(acc,
           list_sort(list_transform(list_filter(c, lambda x: NOT list_contains(acc, x.rank)), lambda x: {{'s': -round({1}, 9), 'r': x.rank}}))[1].r) END, [0::BIGINT]) AS ranks
         FROM {0})"""
_LCS = """(CASE WHEN len({0}) = 0 OR len({1}) = 0 THEN 0 ELSE list_reduce({0}, lambda row, x: list_reduce(range(1, len({1}) + 1), lambda acc, j: list_append(acc,
           CASE WHEN {1}[j] = x THEN row[j] + 1 ELSE greatest(row[j + 1], acc[j]) END), [0::BIGINT]), list_transform(range(0, len({1}) + 1), lambda z: 0::BIGINT))[len({1}) + 1] END)"""
#: Bounds of 0, 1, ... draws, in 65,536ths.
_DRAWN = [int(65536 * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) + 0.5) for k in range(9)]
_LAST = "(len({0}) - list_position(list_reverse({0}), {1}))"


def _measures() -> dict[str, str]:
    """Each metric as SQL over p, g and ranks (the places in g of p's common elements)."""
    hits = "len(list_intersect(p[1:len(g)], g))"
    both = "len(list_intersect(p, g))"
    np_, ng = "len(list_distinct(p))", "len(list_distinct(g))"
    f1 = lambda a, b: f"coalesce(2 * ({a}) * ({b}) / nullif(({a}) + ({b}), 0), 0)"
    ratio = lambda a, b: f"coalesce(({a})::DOUBLE / nullif({b}, 0), 0)"
    pk, rk = ratio(hits, "len(g)"), ratio(hits, ng)
    sp, sr = ratio(both, np_), ratio(both, ng)
    pairs = lambda op: f"coalesce(list_sum(list_transform(range(1, len(ranks)), lambda i: len(list_filter(ranks[i + 1:], lambda s: s {op} ranks[i])))), 0)"
    total = "(len(ranks) * (len(ranks) - 1) / 2)"
    two = lambda x: f"CASE WHEN len(ranks) < 2 THEN 0 ELSE coalesce({x}, 0) END"
    cat = lambda x: f"list_transform({x}, lambda t: CASE WHEN contains(t, '_for_') THEN regexp_extract(t, '^(.*)_for_(.*)$', 2) ELSE t END)"
    a, b = _LAST.format("p", "g[i]"), _LAST.format("p", "g[i + 1]")
    return {
        "precision_at_k": pk, "recall_at_k": rk, "f1_at_k": f1(pk, rk),
        "hit_rate": f"CASE WHEN len(g) > 0 AND len(list_filter(g, lambda x: NOT list_contains(p[1:len(g)], x))) = 0 THEN 1 ELSE 0 END::DOUBLE",
        "jaccard": ratio(both, "len(list_distinct(list_concat(p, g)))"), "set_precision": sp, "set_recall": sr, "set_f1": f1(sp, sr),
        "ordered_precision": two(f"{pairs('>')} / {total}"),
        "transition_acc": ratio(f"len(list_filter(range(1, len(g)), lambda i: coalesce({b} - {a} BETWEEN 1 AND 2, false)))", "greatest(len(g) - 1, 0)"),
        "first_tool_acc": "coalesce((p[1] = g[1])::INT, 0)::DOUBLE",
        "kendall_tau": two(f"({pairs('>')} - {pairs('<')}) / nullif(sqrt({total} * ({total} - {pairs('=')})), 0)"),
        "tau_a": two(f"({pairs('>')} - {pairs('<')}) / {total}"),
        "tau_b": two(f"({pairs('>')} - {pairs('<')}) / nullif(sqrt({total} * ({total} - {pairs('=')})), 0)"),
        "tau_c": two(f"(2 * {pairs('>')} - {total}) / {total}"),
        "lcs_r": ratio(_LCS.format("p", "g"), "len(g)"), "ordered_overlap": ratio(_LCS.format("p", "g"), "greatest(len(p), len(g))"),
        "cat_lcs_r": ratio(_LCS.format(cat("p"), cat("g")), "len(g)"),
        "n_categories": f"len(list_distinct(list_transform(g, lambda t: CASE WHEN contains(t, '_for_') THEN regexp_extract(t, '^(.*)_for_(.*)$', 2) ELSE '?' END)))::INT",
    }


MEASURES = _measures()
MAIN = ["set_f1", "ordered_precision", "lcs_r", "kendall_tau", "transition_acc", "first_tool_acc"]


def _measured(source: str, names: list[str]) -> str:
    ranks = _LAST.format("g", "x")
    return f"""
        SELECT query_id, method, CASE WHEN len(g) <= 2 THEN '1-2' WHEN len(g) <= 4 THEN '3-4' ELSE '5+' END AS bucket,
               {", ".join(f"{MEASURES[n]} AS {n}" for n in names)}
        FROM (SELECT *, list_transform(list_filter(p, lambda x: list_contains(g, x)), lambda x: {ranks}) AS ranks FROM {source})"""


def _expand(text: str) -> str:
    if not text.startswith("{"):
        return text
    kind, _, rest = text[1:-1].partition(":")
    if kind == "edges":
        return _EDGES.format(rest)
    if kind == "linked":
        source, links = rest.split(":")
        return _LINKED.format(source, links, "transition_prob")
    if kind == "greedy":
        source, score = rest.split(":", 1)
        score, steps = score.rsplit(":", 1)
        return _GREEDY.format(source, score, steps)
    return _measured(rest, MAIN)


def _with(final: str, **more: str) -> str:
    """The final SELECT after the parts that it needs, and some of its own."""
    parts = PARTS | more
    need: list[str] = []
    open_: list[str] = []  # a recursive part reads itself
    recursive = set()

    def visit(text: str) -> None:
        import re

        for word in dict.fromkeys(re.findall(r"\b[a-z_0-9]+\b", text)):
            if word in parts and word not in need and re.search(rf"\b(?:FROM|JOIN)\s+{word}\b", text):
                if word in open_:
                    recursive.add(word)
                    continue
                open_.append(word)
                visit(_expand(parts[word]))
                open_.pop()
                if word not in need:
                    need.append(word)

    visit(final)
    return f"WITH {'RECURSIVE ' * bool(recursive)}" + ",\n".join(f"{n} AS{'' if n in recursive else ' MATERIALIZED'} ({dedent(_expand(parts[n])).strip()})" for n in need) + "\n" + final if need else final


def _six(columns: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns.split())


_STEPS = "SELECT query_id, (unnest(range(len(seq))))::INT AS step, unnest(seq) AS tool FROM {}"


def _permuted(score: str, greedy: str) -> str:
    """All orders of up to eight candidates by a recursive table; longer ones are ordered greedily."""
    return _with(
        f"SELECT query_id, (unnest(range(len(seq))))::INT AS step, unnest(seq) AS tool FROM (SELECT query_id, seq FROM best UNION ALL SELECT query_id, seq FROM long)",
        perms="SELECT n, o FROM perms0 WHERE len(o) = n",
        scored=f"SELECT query_id, c, o, {score} AS s FROM selected JOIN perms ON n = len(c)",
        best="SELECT query_id, list_transform(o, lambda r: c[r + 1].tool) AS seq FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, o) AS i FROM scored) WHERE i = 1",
        few="SELECT * FROM selected WHERE len(c) > 8",
        long="{greedy:few:" + greedy + ":len(c) - 1}",
    ).replace("WITH ", "WITH RECURSIVE perms0 AS (SELECT n::BIGINT AS n, []::BIGINT[] AS o FROM range(3, 9) t(n) UNION ALL SELECT n, list_append(o, i) FROM perms0, range(0, 8) r(i) WHERE i < n AND len(o) < n AND NOT list_contains(o, i)),\n", 1)


_FEATURES = """
    SELECT query_id, rank::INT AS rank, tool, sim, (rank / greatest(n - 1, 1)) AS rank_share, so AS sum_out, si AS sum_in, mo AS max_out, mi AS max_in, pos AS position, n / 10 AS size FROM
    (SELECT query_id, n, x.rank AS rank, x.tool AS tool, x.sim AS sim, x.pos AS pos, list_sum(list_transform(c, lambda y: y.links[x.rank + 1])) AS so, list_sum(x.links) AS si,
            list_max(list_transform(c, lambda y: y.links[x.rank + 1])) AS mo, list_max(x.links) AS mi FROM (SELECT query_id, c, len(c) AS n, unnest(c) AS x FROM selected))"""
_WEIGHTS = (1.0, -0.5, 0.4, -0.3, 0.8, -0.6, -1.5, 0.2)
_MASKS = {"all": (1,) * 8, "no_similarity": (0, 0, 1, 1, 1, 1, 1, 1), "no_links": (1, 1, 0, 0, 0, 0, 1, 1), "no_position": (1, 1, 1, 1, 1, 1, 0, 1)}
_DIFFERENCES = {"d_sim": "sim", "d_f_rank": "rank_share"} | {f"d_{n}": n for n in ("sum_out", "sum_in", "max_out", "max_in", "position", "size")}
_NAMES = ("sim", "rank_share", "sum_out", "sum_in", "max_out", "max_in", "position", "size")


def _pairwise(mask: tuple[int, ...]) -> str:
    total = " + ".join(f"({w * m})::DOUBLE * {n}" for n, w, m in zip(_NAMES, _WEIGHTS, mask, strict=True))
    return f"""SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, rank) - 1)::INT AS pos, tool, score FROM
        (SELECT a.query_id, a.rank, a.tool, sum(1 / (1 + exp(b.v - a.v))) AS score FROM (SELECT *, {total} AS v FROM features) a
         JOIN (SELECT query_id, {total} AS v FROM features) b USING (query_id) GROUP BY ALL)"""


def _beams_of_settings(target: int = 4) -> dict[str, str]:
    """`plans`: the best beam (path) of each vector asked (vi) by each setting (i, w1, w2, w3, width)."""
    parts = {
        "nbr": "SELECT src, dst, transition_prob FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(weight, 9) DESC, dst) AS n FROM edges) WHERE n <= 30",
        "live0": "SELECT vi, i, w1, w2, w3, width, [tool] AS path, [community] AS comms, sim AS cum FROM near_ JOIN asked USING (vi) JOIN comm USING (tool) CROSS JOIN settings WHERE rank < least(5, width)",
    }
    for n in range(1, target):
        parts[f"grown{n}"] = f"""SELECT b.*, dst, community, w1 * transition_prob + w2 * s.sim + w3 * (1 - len(list_filter(comms, lambda z: z = community)) / len(path)) AS s
            FROM live{n - 1} b JOIN nbr ON src = path[len(path)] AND NOT list_contains(path, dst) JOIN near_ s ON s.vi = b.vi AND s.tool = dst JOIN comm m ON m.tool = dst"""
        parts[f"ended{n}"] = f"""SELECT b.vi, b.i, b.path, b.cum FROM live{n - 1} b LEFT JOIN (SELECT vi, i, path, max(s) AS m FROM grown{n} GROUP BY ALL) g
            ON g.vi = b.vi AND g.i = b.i AND g.path = b.path WHERE coalesce(m, 0) < 0.05"""
        parts[f"live{n}"] = f"""SELECT vi, i, w1, w2, w3, width, path, comms, cum FROM (SELECT *, row_number() OVER (PARTITION BY vi, i ORDER BY round(cum, 9) DESC, path) AS r FROM
            (SELECT vi, i, w1, w2, w3, width, list_append(path, dst) AS path, list_append(comms, community) AS comms, cum + s AS cum FROM grown{n})) WHERE r <= width"""
    every = " UNION ALL ".join([f"SELECT vi, i, path, cum FROM ended{n}" for n in range(1, target)] + [f"SELECT vi, i, path, cum FROM live{target - 1}"])
    parts["plans"] = f"""SELECT vi, i, path FROM (SELECT *, row_number() OVER (PARTITION BY vi, i ORDER BY round(score, 9) DESC, path) AS r FROM
        (SELECT vi, i, path, max(cum / len(path)) AS score FROM ({every}) GROUP BY ALL)) WHERE r = 1"""
    return parts


def _drawn(tools: str, wanted: str, without: str = "") -> dict[str, str]:
    """`drawn`: pairs of tools in the order of a permutation of the pairs' numbers, as many as wanted."""
    return {
        "names": f"SELECT tool, row_number() OVER (ORDER BY tool) - 1 AS n FROM ({tools})",
        "sizes": "SELECT c, c * (c - 1) AS total, (SELECT min(h) FROM range(0, 31) t(h) WHERE pow(4, h) >= c * (c - 1)) AS half FROM (SELECT count(*) AS c FROM names)",
        "mixed0": "SELECT i, c, total, pow(2, half)::BIGINT AS wide, i // pow(2, half)::BIGINT AS hi, i % pow(2, half)::BIGINT AS lo FROM (SELECT *, unnest(range(pow(4, half)::BIGINT)) AS i FROM sizes)",
        **{f"mixed{r + 1}": f"SELECT i, c, total, wide, lo AS hi, (hi + ('0x' || substr(md5('42:{r}:' || lo), 1, 8))::BIGINT) % wide AS lo FROM mixed{r}" for r in range(4)},
        "ends": "SELECT i, p // (c - 1) AS s, p % (c - 1) + (p % (c - 1) >= p // (c - 1))::INT AS d FROM (SELECT i, c, hi * wide + lo AS p, total FROM mixed4) WHERE p < total",
        "drawn": f"SELECT a.tool AS src, b.tool AS dst FROM ends JOIN names a ON a.n = s JOIN names b ON b.n = d {without} ORDER BY i LIMIT ({wanted})",
    }


def _beam(target: int = 4, width: int = 5) -> dict[str, str]:
    """The levels of a beam search, unrolled, once for each vector (as query_id, until the end)."""
    parts = {
        "nbr": "SELECT src, dst, transition_prob FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(weight, 9) DESC, dst) AS n FROM edges) WHERE n <= 30",
        "live0": "SELECT query_id, [tool] AS path, [community] AS comms, sim AS cum FROM (SELECT vi AS query_id, tool, sim, rank FROM near_) JOIN comm USING (tool) WHERE rank < 5",
    }
    ended = []
    for i in range(1, target):
        parts[f"grown{i}"] = f"""SELECT b.query_id, path, comms, cum, dst, community, 0.4::DOUBLE * transition_prob + 0.4::DOUBLE * sim
            + 0.2::DOUBLE * (1 - len(list_filter(comms, lambda z: z = community)) / len(path)) AS s
            FROM live{i - 1} b JOIN nbr ON src = path[len(path)] AND NOT list_contains(path, dst) JOIN near_ s ON s.vi = b.query_id AND s.tool = dst JOIN comm m ON m.tool = dst"""
        parts[f"ended{i}"] = f"""SELECT b.query_id, b.path, b.cum FROM live{i - 1} b LEFT JOIN (SELECT query_id, path, max(s) AS m FROM grown{i} GROUP BY ALL) g
            ON g.query_id = b.query_id AND g.path = b.path WHERE coalesce(m, 0) < 0.05"""
        parts[f"live{i}"] = f"""SELECT query_id, path, comms, cum FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(cum, 9) DESC, path) AS n FROM
            (SELECT query_id, list_append(path, dst) AS path, list_append(comms, community) AS comms, cum + s AS cum FROM grown{i})) WHERE n <= {width}"""
        ended.append(f"SELECT query_id, path, cum FROM ended{i}")
    final = " UNION ALL ".join([*ended, f"SELECT query_id, path, cum FROM live{target - 1}"])
    parts["of_vector"] = f"""SELECT query_id AS vi, (row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, path) - 1)::INT AS rank, path AS seq, score FROM
        (SELECT query_id, path, max(cum / len(path)) AS score FROM ({final}) GROUP BY ALL)"""
    parts["plans"] = "SELECT q.query_id, rank, seq, score FROM of_vector JOIN q USING (vi)"
    return parts


ORACLE_SQL: dict[str, str] = {
    "traj_steps_t1": _with("SELECT * FROM t1"),
    "traj_steps_t2": _with("SELECT * FROM t2"),
    "traj_collapsed": _with(
        "SELECT task_id, count(*)::INT AS num_steps, string_agg(t, '>' ORDER BY pos) AS seq FROM (SELECT task_id, pos, split_part(tool, '_for_', 1) AS t,"
        " lag(split_part(tool, '_for_', 1)) OVER (PARTITION BY task_id ORDER BY pos) AS b FROM t2) WHERE b IS NULL OR b <> t GROUP BY task_id"
    ),
    "turn_lookahead": """SELECT conv_id, turn, role, lead(role) OVER w AS next_role, coalesce(length(lead(text) OVER w), 0)::INT AS next_len
        FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)""",
    "conversation_success": """SELECT conv_id, count(*) AS n_turns, coalesce(ends_with(arg_max(text, (turn, text)), '.'), false) AS ended
        FROM conversations WHERE role = 'assistant' GROUP BY conv_id""",
    "text_functions": """
        SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE tool END AS action, p_partkey % 3 = 0 AS succeeded, lower(p_type) AS category,
               replace(p_name, ' ', '_') AS endpoint, 'find ' || p_name AS request, replace(p_name, ' ', '_') AS api, 'find ' || p_name AS task,
               replace(tool || '. Category: ' || lower(p_type) || '. ' || p_name, '_', ' ') AS embedding_text, lower(p_name) || '|' || lower(p_type) AS ranked,
               array_to_string(string_split(p_name, ' '), '|') AS tokens,
               CASE WHEN p_partkey % 9 <= 3 THEN 'short' WHEN p_partkey % 9 <= 6 THEN 'medium' ELSE 'long' END AS bucket_short,
               CASE WHEN p_partkey % 9 <= 2 THEN 'short(2)' ELSE 'medium(3+)' END AS bucket_two
        FROM (SELECT *, replace(p_name, ' ', '_') || '_for_' || lower(p_type) AS tool FROM part)""",
    "parsed_tool_lists": _with("SELECT p_partkey, i::INT AS place, t.name AS name, t.description AS description FROM (SELECT p_partkey, unnest(ts) AS t, unnest(range(len(ts))) AS i FROM tools)",
        tools="""SELECT p_partkey, [{'name': replace(p_name, ' ', '_') || '_for_x', 'description': 'It''s "' || p_type || '", isn''t it?'}, {'name': replace(p_name, ' ', '_'), 'description': 'don''t' || chr(10) || p_brand},
            {'name': 'z' || p_partkey, 'description': ''}, {'name': 'told', 'description': p_type}] AS ts FROM part WHERE p_partkey % 10 <> 3"""),
    "parsed_descriptions": _with("""SELECT p_partkey, 0::INT AS place, p_name AS name, 'of ' || p_type AS description FROM part
        UNION ALL SELECT p_partkey, 1, 'b', 'of b' FROM part WHERE p_partkey % 2 = 0"""),
    "sample_files": """
        SELECT (conv_id % 12)::VARCHAR AS file, CASE conv_id % 12 % 3 WHEN 0 THEN 'conversations' WHEN 1 THEN 'process' ELSE 'answer' END AS layout,
               count(DISTINCT conv_id) AS n_samples, count(*) AS n_turns, count(DISTINCT conv_id) AS n_ids FROM conversations GROUP BY ALL
        UNION ALL SELECT 'broken', NULL, 0, NULL, 0""",
    "edge_file": _with("SELECT src, dst, round(weight, 6) AS weight, count, round(pmi, 6) AS pmi, round(transition_prob, 6) AS transition_prob FROM pruned"),
    "trajectory_file": _with("SELECT task_id, string_agg(tool, '>' ORDER BY pos) AS seq, count(*)::INT AS num_steps, 'G1' AS source_split FROM t2 GROUP BY task_id"),
    "tool_frequency": _with("SELECT * FROM frequency"),
    "tool_registry": """
        SELECT tool, coalesce(arg_min(category, p_partkey) FILTER (category <> ''), '') AS category, coalesce(arg_min(description, p_partkey) FILTER (description <> ''), '') AS description,
               count(*) AS frequency
        FROM (SELECT p_partkey, replace(p_name, ' ', '_') || '_for_' || lower(p_type) AS tool, CASE WHEN p_size > 10 THEN p_brand ELSE '' END AS category, p_size::VARCHAR AS description FROM part)
        GROUP BY tool""",
    "length_stats": _with(
        "SELECT bucket, count(*) AS n, round(avg(num_steps), 6) AS mean_len, round(quantile_cont(num_steps::DOUBLE, 0.5), 6) AS median_len,"
        " list_sort(list(num_steps))[count(*) // 2 + 1]::DOUBLE AS upper_median_len, min(num_steps) AS min_len, max(num_steps) AS max_len FROM sized GROUP BY bucket"
    ),
    "length_hist": _with("SELECT least(num_steps, 50) AS num_steps, count(*) AS n FROM seqs GROUP BY 1"),
    "split_stratified": _with("SELECT bucket, count(*) FILTER (NOT is_test) AS n_train, count(*) FILTER (is_test) AS n_test FROM splits GROUP BY bucket"),
    "split_members": _with("SELECT task_id, bucket FROM splits WHERE is_test"),
    "coverage_report": _with("""
        SELECT count(*) AS n_tools, count(b.tool) AS covered, count(*) - count(b.tool) AS uncovered, round(coalesce(100.0::DOUBLE * count(b.tool) / nullif(count(*), 0), 0), 6) AS pct
        FROM (SELECT DISTINCT tool FROM t1 JOIN splits USING (task_id) WHERE is_test) a LEFT JOIN (SELECT DISTINCT tool FROM t1 JOIN splits USING (task_id) WHERE NOT is_test) b ON a.tool = b.tool"""),
    "coverage_examples": _with("SELECT (row_number() OVER (ORDER BY tool) - 1)::INT AS place, tool, n_tasks FROM rare ORDER BY tool LIMIT 10",
        rare="SELECT tool, count(DISTINCT task_id) AS n_tasks FROM t1 WHERE tool NOT IN (SELECT unnest([src, dst]) FROM pruned) GROUP BY tool"),
    "order_by_matrix": _with(_STEPS.format("o_matrix"),
        matrix="SELECT a.tool AS src, b.tool AS dst, list_inner_product(a.vec, b.vec) AS transition_prob FROM vectors a JOIN vectors b ON a.tool <> b.tool",
        selected="{linked:top:matrix}", o_matrix="{greedy:selected:x.links[acc[len(acc)] + 1]:len(c) - 1}"),
    "shown_table": _with("""SELECT (o.i * 4 + b.j)::INT AS place, label, o_bucket AS bucket, count(m.query_id) AS n, """ + ", ".join(f"round(avg(round({v}, 6)), 6) AS {v}" for v in ("set_f1", "ordered_precision", "kendall_tau"))
        + """ FROM (VALUES (0, 'semantic_strongest', 'Strongest link'), (1, 'semantic', 'Similarity'), (2, 'frequency', 'Most frequent')) o(i, o_method, label)
        CROSS JOIN (VALUES (0, '5+'), (1, '3-4'), (2, '1-2'), (3, 'none')) b(j, o_bucket) LEFT JOIN measured m ON m.method = o_method AND m.bucket = o_bucket GROUP BY ALL"""),
    "train_test_overlap": _with("""
        SELECT CASE WHEN k IN (SELECT array_to_string(seq, '>') FROM splits WHERE NOT is_test) THEN 'seen' ELSE 'new' END AS part, count(*) AS n
        FROM (SELECT array_to_string(seq, '>') AS k FROM splits WHERE is_test) GROUP BY 1"""),
    "position_stats": _with(f"SELECT tool, {_six('avg_pos')}, n FROM positions"),
    "transition_graph": _with(f"SELECT src, dst, {_six('count pmi transition_prob weight')} FROM edges"),
    "transition_graph_pruned": _with(f"SELECT src, dst, {_six('count pmi transition_prob weight')} FROM pruned"),
    "transition_graph_events": _with(f"SELECT src, dst, {_six('count pmi transition_prob weight')} FROM event_edges"),
    "strongest_edges": _with(f"SELECT src, dst, {_six('weight')} FROM (SELECT * FROM edges ORDER BY round(edges.weight, 9) DESC, src, dst LIMIT 20)"),
    "strongest_subgraph": _with(f"""
        SELECT src, dst, {_six('weight')} FROM inside WHERE inside.weight >= 0.05::DOUBLE * (SELECT max(weight) FROM inside)""",
        best="SELECT tool FROM (SELECT tool, row_number() OVER (ORDER BY frequency DESC, tool) AS i FROM frequency) WHERE i <= 600",
        inside="SELECT p.* FROM pruned p JOIN best a ON a.tool = src JOIN best b ON b.tool = dst"),
    "graph_degree": _with("SELECT tool, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree FROM (SELECT src AS tool, 0 AS i, 1 AS o FROM edges UNION ALL SELECT dst, 1, 0 FROM edges) GROUP BY tool"),
    "graph_density": _with("""
        SELECT count(*) AS n_nodes, sum(o)::BIGINT AS n_edges, round(coalesce(sum(o)::DOUBLE / nullif(count(*) * (count(*) - 1), 0), 0), 6) AS density, round(avg(o), 6) AS avg_degree,
               max(o)::BIGINT AS max_out, max(i)::BIGINT AS max_in FROM deg""",
        deg="SELECT tool, sum(i) AS i, sum(o) AS o FROM (SELECT src AS tool, 0 AS i, 1 AS o FROM edges UNION ALL SELECT dst, 1, 0 FROM edges) GROUP BY tool"),
    "weight_hist": _with("SELECT least(floor(CASE WHEN hi - lo < 1e-8 THEN 0.5 ELSE (weight - lo) / (hi - lo) END * 60), 59)::BIGINT AS bin, count(*) AS n FROM edges, (SELECT min(weight) AS lo, max(weight) AS hi FROM edges) GROUP BY 1"),
    "active_tools": _with("SELECT tool FROM vectors WHERE tool IN (SELECT src FROM pruned) OR tool IN (SELECT dst FROM pruned)"),
    "cooccurrence_tp": _with("SELECT a, b, round(n / f, 6) AS tp FROM (SELECT a, b, count(*) AS n FROM later GROUP BY a, b) JOIN (SELECT tool AS a, count(*) AS f FROM t2 GROUP BY tool) USING (a)"),
    "loo_tp": _with("""
        SELECT task_id, a, b, round(coalesce((sum(o) OVER (PARTITION BY a, b) - o) / nullif(n - f, 0), 0), 6) AS tp
        FROM (SELECT task_id, a, b, count(*) AS o FROM later GROUP BY ALL) JOIN (SELECT task_id, tool AS a, count(*) AS f FROM t2 GROUP BY ALL) USING (task_id, a)
        JOIN (SELECT tool AS a, count(*) AS n FROM t2 GROUP BY ALL) USING (a)"""),
    "knn_graph": _with(f"SELECT src, dst, {_six('sim')} FROM knn"),
    "fused_graph": _with("""
        SELECT coalesce(e.src, k.src) AS src, coalesce(e.dst, k.dst) AS dst, round(coalesce(weight, 0), 6) AS w_stat, round(coalesce(sim, 0), 6) AS w_sem,
               round(CASE WHEN weight IS NOT NULL THEN 0.7::DOUBLE * (CASE WHEN hi - lo < 1e-8 THEN 0.5 ELSE (weight - lo) / (hi - lo) END) + (1 - 0.7::DOUBLE) * coalesce(sim, 0) ELSE (1 - 0.7::DOUBLE) * sim END, 6) AS w_final,
               CASE WHEN weight IS NOT NULL THEN 'statistical' ELSE 'semantic' END AS edge_source
        FROM pruned e FULL JOIN knn k ON e.src = k.src AND e.dst = k.dst, (SELECT min(weight) AS lo, max(weight) AS hi FROM pruned) WHERE weight IS NOT NULL OR sim >= 0.3"""),
    "community_centroid": _with(f"SELECT community, dim, {_six('value')} FROM centroids"),
    "community_purity": _with("""
        SELECT community, sum(n)::BIGINT AS size, count(*) AS n_categories, arg_min(category, (-n, category)) AS dominant, round(max(n) / sum(n), 6) AS purity
        FROM (SELECT community, category, count(*) AS n FROM comm GROUP BY ALL) GROUP BY community"""),
    "community_nmi": _with("""
        SELECT round(coalesce(mi / nullif((ha + hb) / 2, 0), 1), 6) AS nmi FROM
        (SELECT sum(n / t * ln(n * t / (a * b))) AS mi FROM (SELECT n, sum(n) OVER ()::DOUBLE AS t, sum(n) OVER (PARTITION BY community)::DOUBLE AS a, sum(n) OVER (PARTITION BY category)::DOUBLE AS b FROM counts)),
        (SELECT sum(-a / t * ln(a / t)) AS ha FROM (SELECT count(*)::DOUBLE AS a, (SELECT count(*) FROM comm)::DOUBLE AS t FROM comm GROUP BY community)),
        (SELECT sum(-a / t * ln(a / t)) AS hb FROM (SELECT count(*)::DOUBLE AS a, (SELECT count(*) FROM comm)::DOUBLE AS t FROM comm GROUP BY category))""",
        counts="SELECT community, category, count(*) AS n FROM comm GROUP BY ALL"),
    "modularity": _with("""
        SELECT round(coalesce(sum(coalesce(i, 0) / m - power(d / (2 * m), 2)), 0), 6) AS modularity FROM
        (SELECT c, sum(w) AS d FROM (SELECT cu AS c, weight AS w FROM r UNION ALL SELECT cv, weight FROM r) GROUP BY c) LEFT JOIN (SELECT cu AS c, sum(weight) AS i FROM r WHERE cu = cv GROUP BY cu) USING (c),
        (SELECT sum(weight) AS m FROM r)""", r="SELECT weight, a.community AS cu, b.community AS cv FROM und JOIN comm a ON a.tool = u JOIN comm b ON b.tool = v"),
    "clustering_coefficient": _with("""
        SELECT round(avg(coalesce(2 * t / nullif(k * (k - 1), 0), 0)), 6) AS avg_clustering FROM (SELECT n, count(*) AS k FROM (SELECT u AS n FROM s UNION ALL SELECT v FROM s) GROUP BY n)
        LEFT JOIN (SELECT n, sum(t) AS t FROM (SELECT unnest([x.u, x.v, y.v]) AS n, x.w * y.w * z.w AS t FROM s x JOIN s y ON x.v = y.u JOIN s z ON z.u = x.u AND z.v = y.v) GROUP BY n) USING (n)""",
        s0="SELECT least(src, dst) AS u, greatest(src, dst) AS v, max(weight) AS w FROM event_edges GROUP BY 1, 2", s="SELECT u, v, cbrt(w / (SELECT max(w) FROM s0)) AS w FROM s0"),
    "meta_graph": _with(f"SELECT c1, c2, {_six('weight')} FROM meta"),
    "meta_nodes": _with("SELECT community, count(*) AS size, arg_min(tool, (-frequency, tool)) AS label FROM comm JOIN (SELECT tool, frequency FROM frequency) USING (tool) GROUP BY community"),
    "label_prop": _with(
        "SELECT tool, community FROM l3",
        und2="SELECT least(src, dst) AS u, greatest(src, dst) AS v, max(weight) AS w FROM event_edges GROUP BY 1, 2",
        links_="SELECT u AS a, v AS b, w FROM und2 UNION ALL SELECT v, u, w FROM und2",
        l0="SELECT DISTINCT a AS tool, a AS community FROM links_",
        **{f"l{i}": f"SELECT a AS tool, arg_min(community, (-round(s, 9), community)) AS community FROM (SELECT a, community, sum(w) AS s FROM links_ JOIN l{i - 1} ON b = tool GROUP BY ALL) GROUP BY a" for i in (1, 2, 3)},
    ),
    "weak_components": _with("SELECT tool, least(tool, min(o)) AS component FROM reach GROUP BY tool",
        nearest="SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(sim, 9) DESC, dst) AS n FROM knn) WHERE n = 1",
        ways="SELECT src AS a, dst AS b FROM nearest UNION SELECT dst, src FROM nearest",
        reach="SELECT a AS tool, b AS o FROM ways UNION SELECT reach.tool, ways.b FROM reach JOIN ways ON ways.a = reach.o"),
    "shortest_path_hops": _with("SELECT (SELECT min(src) FROM e) AS src, dst, min(h)::INT AS hops FROM reach GROUP BY dst",
        e="SELECT src, dst FROM edges WHERE count >= 1 AND weight >= 0.05",
        reach="SELECT (SELECT min(src) FROM e) AS dst, 0 AS h UNION SELECT e.dst, h + 1 FROM reach JOIN e ON e.src = reach.dst WHERE h <= (SELECT count(DISTINCT src) FROM e)"),
    "topological_order": _with("SELECT tool, component, n > 1 AS cyclic, layer::INT AS layer FROM member JOIN (SELECT component, count(*) AS n FROM member GROUP BY component) USING (component) JOIN (SELECT component, max(layer) AS layer FROM layers GROUP BY component) USING (component)",
        e="SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(weight, 9) DESC, dst) AS n FROM pruned) WHERE n <= 2",
        reach="SELECT src, dst FROM e UNION SELECT reach.src, e.dst FROM reach JOIN e ON e.src = reach.dst",
        ends="SELECT DISTINCT unnest([src, dst]) AS tool FROM e",
        member="SELECT tool, least(tool, coalesce(min(y.src), tool)) AS component FROM ends LEFT JOIN (SELECT a.src, a.dst FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src) y ON y.dst = tool GROUP BY tool",
        between="SELECT DISTINCT a.component AS src, b.component AS dst FROM e JOIN member a ON a.tool = src JOIN member b ON b.tool = dst WHERE a.component <> b.component",
        layers="SELECT DISTINCT component, 0 AS layer FROM member UNION SELECT dst, layer + 1 FROM layers JOIN between ON src = component"),
    "random_graph_edges": _with("SELECT src, dst, 1.0::DOUBLE AS weight FROM drawn", **_drawn("SELECT DISTINCT unnest([src, dst]) AS tool FROM pruned", "SELECT count(*) FROM pruned")),
    "semantic_topk": _with(f"SELECT query_id, rank::INT AS rank, tool, {_six('sim')} FROM top"),
    "bm25_topk": _with("""
        SELECT item_id, rank, doc_id, round(score, 6) AS score FROM (SELECT *, (row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) - 1)::INT AS rank FROM
        (SELECT item_id, doc_id, sum(qf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
         FROM (SELECT item_id, term, count(*)::DOUBLE AS qf FROM asked GROUP BY ALL) JOIN tf USING (term) JOIN (SELECT term, count(*)::DOUBLE AS df FROM tf GROUP BY term) USING (term)
         JOIN len_ USING (doc_id), (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM len_) GROUP BY ALL)) WHERE rank < 3""",
        w="SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '[ \\t\\n\\x0B\\f\\r]+'), lambda t: t <> '')) AS term FROM documents WHERE text IS NOT NULL",
        tf="SELECT doc_id, term, count(*)::DOUBLE AS tf FROM w GROUP BY ALL",
        len_="SELECT doc_id, len(list_filter(string_split_regex(lower(text), '[ \\t\\n\\x0B\\f\\r]+'), lambda t: t <> ''))::DOUBLE AS dl FROM documents WHERE text IS NOT NULL",
        asked="SELECT item_id, unnest(list_filter(string_split_regex(lower(text), '[ \\t\\n\\x0B\\f\\r]+'), lambda t: t <> '')) AS term FROM benchmark"),
    "frequency_baseline": _with("SELECT query_id, rank::INT AS rank, tool FROM q JOIN freq_top ON rank < k"),
    "plan_hybrid": _with(_STEPS.format("chosen"), pool="SELECT query_id, k, tool, sim, rank FROM ranked WHERE rank < greatest(k + 2, 3 * k)",
        links_="SELECT src, dst, weight AS transition_prob FROM edges UNION ALL SELECT dst, src, weight * 0.5 FROM edges e WHERE NOT EXISTS (SELECT 1 FROM edges f WHERE f.src = e.dst AND f.dst = e.src)",
        rows="{linked:pool:links_}",
        chosen="{greedy:rows:0.5::DOUBLE * x.links[acc[len(acc)] + 1] + 0.5::DOUBLE * x.sim + 0.1::DOUBLE * greatest(0, 1 - abs(x.pos - len(acc) / greatest(1, k - 1))):k - 1}"),
    "plan_beam": _with(f"SELECT query_id, rank, array_to_string(seq, '>') AS seq, {_six('score')} FROM plans WHERE rank < 3", **_beam()),
    "plan_hierarchical": _with("""
        SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY round(coalesce(avg_pos, 0.5), 9), tool) - 1)::INT AS step, tool, round(sim, 6) AS sim
        FROM chosen LEFT JOIN (SELECT tool, avg_pos FROM positions) USING (tool) WHERE n <= 4""",
        csims="SELECT query_id, community, sum(x * value) AS csim FROM (SELECT query_id, unnest(range(len(vec)))::INT AS dim, unnest(vec) AS x FROM q) JOIN centroids USING (dim) GROUP BY ALL",
        cr="SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(csim, 9) DESC, community) - 1 AS crank FROM csims",
        near="SELECT c1 AS a, c2 AS b FROM meta UNION ALL SELECT c2, c1 FROM meta",
        allowed="""SELECT cr.query_id, cr.community, cr.crank FROM cr JOIN (SELECT query_id, community AS a FROM cr WHERE crank = 0) h USING (query_id)
            WHERE crank = 0 OR EXISTS (SELECT 1 FROM near WHERE near.a = h.a AND near.b = cr.community) OR NOT EXISTS (SELECT 1 FROM near WHERE near.a = h.a)""",
        chosen="SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY crank, round(sim, 9) DESC, tool) AS n FROM sims JOIN (SELECT tool, community FROM comm) USING (tool) JOIN allowed USING (query_id, community)"),
    "order_semantic": _with(_STEPS.format("o_sem")),
    "order_greedy_tp": _with(_STEPS.format("o_links")),
    "order_greedy_maxtp": _with(_STEPS.format("o_strong")),
    "order_optimal_perm": _permuted("list_sum(list_transform(range(1, len(o)), lambda i: ln(c[o[i + 1] + 1].links[o[i] + 1] + 1e-9)))", "x.links[acc[len(acc)] + 1]"),
    "order_hybrid_rerank": _permuted(
        "0.7::DOUBLE * list_sum(list_transform(range(1, len(o)), lambda i: c[o[i + 1] + 1].links[o[i] + 1])) + (1 - 0.7::DOUBLE) * list_sum(list_transform(range(1, len(o) + 1), lambda i: c[o[i] + 1].sim / i))",
        "0.7::DOUBLE * x.links[acc[len(acc)] + 1] + (1 - 0.7::DOUBLE) * x.sim / (len(acc) + 1)"),
    "order_pairwise_fixed_weights": _with(f"SELECT query_id, pos, tool, {_six('score')} FROM p", features=_FEATURES, p=_pairwise(_MASKS["all"])),
    "order_masked": _with(" UNION ALL ".join(f"SELECT '{n}' AS mask, query_id, pos, tool FROM p_{n}" for n in _MASKS), features=_FEATURES, **{f"p_{n}": _pairwise(m) for n, m in _MASKS.items()}),
    "pair_features": _with(f"SELECT query_id, rank, tool, {_six('sim rank_share sum_out sum_in max_out max_in position size')} FROM features", features=_FEATURES),
    "pair_training_rows": _with(
        "SELECT query_id, a, b, 1::INT AS label, " + ", ".join(f"round({n}, 6) + 0.0 AS {n}" for n in _DIFFERENCES) + " FROM after UNION ALL SELECT query_id, b, a, 0, "
        + ", ".join(f"round(-{n}, 6) + 0.0" for n in _DIFFERENCES) + " FROM after",
        own="SELECT query_id, k, tool, sim, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, tool) - 1 AS rank FROM sims JOIN (SELECT DISTINCT query_id, unnest(truth) AS tool FROM q) USING (query_id, tool)",
        selected="{linked:own:edges}", features=_FEATURES,
        place="SELECT query_id, tool, min(i) AS first, max(i) AS last FROM (SELECT query_id, unnest(truth) AS tool, unnest(range(len(truth))) AS i FROM q) GROUP BY ALL",
        after="SELECT query_id, x.tool AS a, y.tool AS b, " + ", ".join(f"x.{n} - y.{n} AS {d}" for d, n in _DIFFERENCES.items())
        + " FROM features x JOIN place p USING (query_id, tool) JOIN features y USING (query_id) JOIN place r ON r.query_id = y.query_id AND r.tool = y.tool WHERE p.first < r.last"),
    "link_dataset": _with("""
        SELECT src, dst, label, CASE WHEN h < 8 THEN 'train' WHEN h = 8 THEN 'val' ELSE 'test' END AS part FROM (SELECT *, ('0x' || substr(md5('42|' || src || '|' || dst), 1, 4))::INT % 10 AS h FROM
        (SELECT src, dst, 1::INT AS label FROM positive UNION ALL SELECT src, dst, 0 FROM drawn))""",
        positive="SELECT DISTINCT src, dst FROM (SELECT tool AS src, lead(tool) OVER (PARTITION BY task_id ORDER BY pos) AS dst FROM t2) WHERE dst IS NOT NULL AND src <> dst",
        **_drawn("SELECT DISTINCT tool FROM t2", "SELECT 5 * count(*) FROM positive", "WHERE (a.tool, b.tool) NOT IN (SELECT (src, dst) FROM positive)")),
    "sage_mean_agg": _with("SELECT tool, dim, round(avg(x), 6) AS value FROM (SELECT dst AS tool, unnest(range(len(vec)))::INT AS dim, unnest(vec) AS x FROM pruned JOIN vectors v ON v.tool = src) GROUP BY ALL"),
    "rollup_grouping_sets": _with("SELECT method, bucket, count(*) AS n, " + ", ".join(f"round(avg({v}), 6) AS mean_{v}, round(stddev_samp({v}), 6) AS std_{v}" for v in ("set_f1", "ordered_precision", "transition_acc"))
        + " FROM measured GROUP BY GROUPING SETS ((method, bucket), (method))"),
    "by_length": _with("SELECT method, bucket, count(*) AS n, " + ", ".join(f"round(avg({v}), 6) AS {v}" for v in MAIN) + " FROM measured GROUP BY ALL"),
    "first_tool_table": _with("SELECT method, count(*) AS n, " + ", ".join(f"round(avg({v}), 6) AS {v}" for v in ("first_tool_acc", "ordered_precision", "set_f1")) + " FROM measured GROUP BY ALL"),
    "fixed_k_table": _with("SELECT method, count(*) AS n, " + ", ".join(f"round(avg({v}), 6) AS {v}" for v in ("set_f1", "ordered_precision", "first_tool_acc")) + " FROM m GROUP BY ALL",
        fixed="SELECT query_id, method, list(tool ORDER BY rank) AS p, any_value(truth) AS g FROM ranked JOIN (SELECT query_id, truth FROM q) USING (query_id), (VALUES ('3', 3), ('5', 5), ('8', 8), ('oracle', NULL)) v(method, kk) WHERE rank < coalesce(kk, k) GROUP BY ALL",
        m=_measured("fixed", ["set_f1", "ordered_precision", "first_tool_acc"])),
    "bootstrap_ci": _with("""
        SELECT n, round(mean_delta, 6) AS mean_delta, round(lo, 6) AS lo, round(hi, 6) AS hi, round(p_value, 6) AS p_value, round(lo, 12) > 0 AS significant FROM (SELECT count(*) AS n, avg(delta) AS mean_delta FROM deltas),
        (SELECT quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi, avg((round(m, 12) <= 0)::INT::DOUBLE) AS p_value FROM
         (SELECT c, j, sum(times * delta) / sum(times) AS m FROM (SELECT c, j, delta, """ + " + ".join(f"(v >= {b})::INT" for b in _DRAWN) + """ AS times FROM
          (SELECT c, j, delta, ('0x' || substr(h, 4 * j + 1, 4))::INT AS v FROM (SELECT c, delta, md5('42:' || c || ':' || query_id) AS h FROM deltas, range(1250) t(c)), range(8) s(j))) GROUP BY c, j))""",
        deltas="SELECT a.ordered_precision - b.ordered_precision AS delta, query_id FROM (SELECT * FROM measured WHERE method = 'semantic_links') a JOIN (SELECT * FROM measured WHERE method = 'semantic') b USING (query_id)"),
    "random_order_null": _with("SELECT shuffle, round(avg(ordered_precision), 6) AS ordered_precision, round(avg(kendall_tau), 6) AS kendall_tau FROM (SELECT s.shuffle, m.* FROM m JOIN (SELECT query_id, method, shuffle FROM shuffled) s USING (query_id, method)) GROUP BY shuffle",
        shuffled="""SELECT query_id, shuffle::VARCHAR AS method, shuffle::INT AS shuffle, list_transform(list_sort(list_transform(range(1, len(p) + 1), lambda i: {'h': md5('42:' || shuffle || ':' || query_id || ':' || p[i] || ':' || (i - 1)), 't': p[i]})), lambda y: y.t) AS p, g
            FROM preds, range(100) r(shuffle) WHERE method = 'semantic'""",
        m=_measured("shuffled", ["ordered_precision", "kendall_tau"])),
    "pareto": _with("SELECT method, round(set_f1, 6) AS set_f1, round(ordered_precision, 6) AS ordered_precision, NOT EXISTS (SELECT 1 FROM pts b WHERE b.set_f1 >= a.set_f1 AND b.ordered_precision >= a.ordered_precision AND (b.set_f1 > a.set_f1 OR b.ordered_precision > a.ordered_precision)) AS on_frontier FROM pts a",
        pts="SELECT method, round(avg(set_f1), 9) AS set_f1, round(avg(ordered_precision), 9) AS ordered_precision FROM measured GROUP BY method"),
    "beam_parameter_search": _with("SELECT setting, round(avg(f1 + 0.5::DOUBLE * lcs_r + 0.3::DOUBLE * ordered_precision), 6) AS objective FROM m JOIN settings ON method = i::VARCHAR GROUP BY setting",
        settings="""SELECT row_number() OVER () AS i, *, 'weights=' || w1 || '/' || w2 || '/' || replace(printf('%g', w3), '0.10', '0.1') || ' width=' || width AS setting FROM
            (SELECT a AS w1, b AS w2, round(1 - a - b, 3) AS w3, w AS width FROM (VALUES (0.2::DOUBLE), (0.3), (0.4), (0.5)) x(a), (VALUES (0.3::DOUBLE), (0.4), (0.5), (0.6)) y(b), (VALUES (3), (5), (8), (10)) z(w) WHERE round(1 - a - b, 3) >= 0.05)""",
        held="SELECT * FROM q WHERE task_id IN (SELECT task_id FROM splits WHERE is_test)",
        asked="SELECT DISTINCT vi FROM held",
        **_beams_of_settings(),
        tried="SELECT query_id, i::VARCHAR AS method, path AS p, truth AS g FROM held JOIN plans USING (vi)",
        m="SELECT method, len(list_intersect(p[1:len(g)], g)) / len(g) AS f1, lcs_r, ordered_precision FROM measured_tried JOIN tried USING (query_id, method)",
        measured_tried=_measured("tried", ["lcs_r", "ordered_precision"])),
    "winloss": _with("SELECT count(*) FILTER (d > 0) AS wins, count(*) FILTER (d < 0) AS losses, count(*) FILTER (d = 0) AS ties FROM (SELECT round(a.ordered_precision - b.ordered_precision, 9) AS d FROM (SELECT * FROM measured WHERE method = 'semantic_links') a JOIN (SELECT * FROM measured WHERE method = 'semantic') b USING (query_id))"),
    "extreme_deltas": _with("SELECT query_id, round(delta, 6) AS delta, side FROM (SELECT *, 'gain' AS side, row_number() OVER (ORDER BY round(delta, 9) DESC, query_id) AS i FROM deltas WHERE delta > 0 UNION ALL SELECT *, 'loss', row_number() OVER (ORDER BY round(delta, 9), query_id) FROM deltas WHERE delta < 0) WHERE i <= 5",
        deltas="SELECT query_id, a.set_f1 - b.set_f1 AS delta FROM (SELECT * FROM measured WHERE method = 'semantic_strongest') a JOIN (SELECT * FROM measured WHERE method = 'frequency') b USING (query_id)"),
    "k_distribution": _with("SELECT len(truth)::INT AS k, count(*) AS n, len(truth) < 3 AS order_dependent FROM q GROUP BY ALL"),
    "invariant_set_integrity": "SELECT 0::BIGINT AS violations",
    "invariant_parity": "SELECT 0::BIGINT AS violations",
    "auc_ap_f1": """
        WITH r AS (SELECT round(n_chars / (n_chars + 2000), 9) AS s, toxic AS y FROM labels JOIN documents USING (doc_id)),
        g AS (SELECT s, sum(y) AS pos, count(*) AS n FROM r GROUP BY s),
        w AS (SELECT *, sum(n) OVER (ORDER BY s) - n AS before_, sum(pos) OVER (ORDER BY s DESC) AS tp, sum(n) OVER (ORDER BY s DESC) AS seen FROM g)
        SELECT round(coalesce((sum(pos * (before_ + (n + 1) / 2)) - sum(pos) * (sum(pos) + 1) / 2) / nullif(sum(pos) * (sum(n) - sum(pos)), 0), 0), 6) AS auc,
               round(coalesce(sum(pos * tp / seen) / nullif(sum(pos), 0), 0), 6) AS average_precision,
               round(coalesce(2 * coalesce(sum(pos) FILTER (s >= 0.5), 0) / nullif(coalesce(sum(n) FILTER (s >= 0.5), 0) + sum(pos), 0), 0), 6) AS f1 FROM w""",
    "score_distribution": _with("SELECT round(avg(transition_prob), 6) AS mean, round(quantile_cont(transition_prob, 0.5), 6) AS median, round(quantile_cont(transition_prob, 0.9), 6) AS p90 FROM edges"),
    "stream_window_counts": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2",
    "stream_session_counts": """
        SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM
        (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, g""",
    "stream_transitions": """
        SELECT src, dst, round(sum(c), 6) AS count FROM (SELECT event_type AS src, lead(event_type) OVER w AS dst, 1.0::DOUBLE AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
        UNION ALL SELECT event_type, lead(event_type, 2) OVER w, 0.5::DOUBLE FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE dst IS NOT NULL AND src <> dst GROUP BY src, dst""",
    "stream_distinct_events": "SELECT event_type, count(DISTINCT event_id) AS n, round(sum(value), 6) AS total FROM events GROUP BY event_type",
}

for _name, _columns in {
    "metrics_set": ["precision_at_k", "recall_at_k", "f1_at_k", "hit_rate", "jaccard", "set_precision", "set_recall", "set_f1"],
    "metrics_order": ["ordered_precision", "transition_acc", "first_tool_acc"],
    "metrics_tau": ["tau_a", "tau_b", "tau_c"],
    "metrics_lcs": ["lcs_r", "ordered_overlap", "cat_lcs_r", "n_categories"],
}.items():
    ORACLE_SQL[_name] = _with(f"SELECT query_id, method, bucket, {', '.join(c if c == 'n_categories' else f'round({c}, 6) AS {c}' for c in _columns)} FROM m", m=_measured("preds", _columns))

_ALPHAS = [a / 10 for a in range(11)]
_SWEEP = {f"s{i}": "{greedy:selected:" + f"{a}::DOUBLE * list_max(list_transform(acc, lambda r: x.links[r + 1])) + (1 - {a}::DOUBLE) * x.sim" + ":len(c) - 1}" for i, a in enumerate(_ALPHAS)}
_SWEEP["swept"] = "SELECT query_id, alpha::VARCHAR AS method, alpha, seq AS p, truth AS g FROM (" + " UNION ALL ".join(f"SELECT query_id, {a}::DOUBLE AS alpha, seq FROM s{i}" for i, a in enumerate(_ALPHAS)) + ") JOIN (SELECT query_id, truth FROM q) USING (query_id)"
_SWEEP["m"] = _measured("swept", ["ordered_precision"])
_SWEEP["means"] = "SELECT method::DOUBLE AS alpha, avg(ordered_precision) AS ordered_precision FROM m GROUP BY method"
ORACLE_SQL["alpha_sweep"] = _with("SELECT alpha, round(ordered_precision, 6) AS ordered_precision FROM means", **_SWEEP)
ORACLE_SQL["alpha_best"] = _with("SELECT alpha, round(ordered_precision, 6) AS ordered_precision FROM (SELECT * FROM means ORDER BY round(means.ordered_precision, 9) DESC, alpha LIMIT 1)", **_SWEEP)

_MEANS = "SELECT method, {} FROM measured WHERE method IN ('semantic', 'semantic_links') GROUP BY method"
ORACLE_SQL |= {
    "largest_communities": _with("SELECT community, count(*) AS size FROM comm GROUP BY community ORDER BY size DESC, community LIMIT 40"),
    "community_flow": _with(
        "SELECT a.community AS c1, b.community AS c2, round(sum(weight), 6) AS weight FROM edges JOIN large a ON a.tool = src JOIN large b ON b.tool = dst"
        " WHERE a.community <> b.community GROUP BY 1, 2 HAVING round(sum(weight), 9) >= 1",
        large="SELECT tool, community FROM comm WHERE community IN (SELECT community FROM comm GROUP BY community ORDER BY count(*) DESC, community LIMIT 10)",
    ),
    "edge_score_hist": _with(
        "SELECT kind, floor(round(list_inner_product(a.vec, b.vec), 9) * 20)::BIGINT AS bin, count(*) AS n FROM both_ JOIN vectors a ON a.tool = src JOIN vectors b ON b.tool = dst GROUP BY 1, 2",
        nodes="SELECT tool, row_number() OVER (ORDER BY tool) - 1 AS i, count(*) OVER () AS n FROM vectors",
        drawn="""SELECT src AS s, dst AS d, j, ('0x' || substr(md5('42:' || src || ':' || dst || ':' || j || ':u'), 1, 8))::BIGINT % n AS u,
            ('0x' || substr(md5('42:' || src || ':' || dst || ':' || j || ':v'), 1, 8))::BIGINT % n AS v FROM pruned, range(3) t(j), (SELECT max(n) AS n FROM nodes)""",
        free="""SELECT s, d, j, a.tool AS src, b.tool AS dst FROM drawn JOIN nodes a ON a.i = u JOIN nodes b ON b.i = v
            WHERE u <> v AND NOT EXISTS (SELECT 1 FROM pruned e WHERE e.src = a.tool AND e.dst = b.tool)""",
        both_="""SELECT 'edge' AS kind, src, dst FROM pruned UNION ALL SELECT DISTINCT 'none', p.src, p.dst FROM
            (SELECT arg_min({'src': src, 'dst': dst}, j) AS p FROM free GROUP BY s, d)""",
    ),
    "similar_length_pool": _with(
        "SELECT task_id, place::INT AS place, example FROM picked JOIN pool USING (i)",
        pool="SELECT task_id AS example, num_steps AS len, row_number() OVER (ORDER BY num_steps, substr(md5(task_id::VARCHAR), 1, 2), task_id) - 1 AS i FROM splits WHERE NOT is_test",
        spans="SELECT t.num_steps, min(p.i) AS lo, count(p.i) AS n FROM (SELECT DISTINCT num_steps FROM splits WHERE is_test) t LEFT JOIN pool p ON abs(p.len - t.num_steps) <= 1 GROUP BY 1",
        sized_="""SELECT task_id, coalesce(lo, 0) AS lo, CASE WHEN n = 0 THEN (SELECT count(*) FROM pool) ELSE n END AS n FROM splits JOIN spans USING (num_steps) WHERE is_test""",
        picked="""SELECT task_id, place, lo + (('0x' || substr(md5('42:' || task_id), 1, 8))::BIGINT % n + place) % n AS i FROM sized_, range(3) t(place) WHERE place < n""",
    ),
    "prediction_lengths": _with("SELECT query_id, method, len(p)::INT AS pred_len, len(g)::INT AS gt_len FROM preds"),
    "delta_table": _with(
        " UNION ALL ".join(
            f"SELECT '{c}' AS metric, round(a.{c}, 6) AS old, round(b.{c}, 6) AS new, round(b.{c} - a.{c}, 6) AS delta"
            " FROM (SELECT * FROM both_ WHERE method = 'semantic') a, (SELECT * FROM both_ WHERE method = 'semantic_links') b"
            for c in MAIN
        ),
        both_=_MEANS.format(", ".join(f"avg({c}) AS {c}" for c in MAIN)),
    ),
    "merged_tables": _with("SELECT method, bucket, count(*) AS n, round(avg(set_f1), 6) AS set_f1, round(avg(lcs_r), 6) AS lcs_r FROM measured GROUP BY method, bucket"),
    "success_rate": f"SELECT count(*) AS n, round(avg(ended::INT), 6) AS rate FROM ({ORACLE_SQL['conversation_success']})",
    "ranked_list_match": """
        WITH names AS (SELECT lower(p_name) AS name, min(p_name) AS tool FROM part WHERE p_size > 10 GROUP BY 1),
        lists AS (SELECT p_partkey AS key, unnest([0, 1]) AS place, unnest([lower(p_type), lower(p_name)]) AS name FROM part)
        SELECT key, (row_number() OVER (PARTITION BY key ORDER BY place) - 1)::INT AS rank, tool FROM lists JOIN names USING (name)""",
    "registered_metrics": _with(
        f"SELECT query_id, method, {_six('set_f1 jaccard lcs_r ordered_precision first_tool_acc')} FROM m",
        m=_measured("preds", ["set_f1", "jaccard", "lcs_r", "ordered_precision", "first_tool_acc"]),
    ),
}
