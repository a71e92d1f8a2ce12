"""Metrics as SQL functions, and best-first search as a table function, for use in spark.sql.

The metrics are SQL expressions over arrays p (prediction) and g (truth), so Catalyst inlines them; null arrays count as empty.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from .planning import search

_HEAD = "slice(p, 1, size(g))"
_BOTH = "size(array_intersect(p, g))"
_LAST = "(CASE WHEN array_position(reverse(g), x) > 0 THEN size(g) - array_position(reverse(g), x) ELSE -1 END)"
_RANKS = f"transform(filter(p, x -> array_contains(g, x)), x -> {_LAST})"
_UP = """aggregate(transform(r, (a, i) -> size(filter(slice(r, i + 2, greatest(size(r) - i - 1, 0)), b -> b > a))), 0, (s, n) -> s + n)"""
_SAME = "aggregate(transform(g, (y, j) -> CASE WHEN y = x THEN shiftleft(1L, j) ELSE 0L END), 0L, (a, b) -> a + b)"
_BITS = f"""size(g) - bit_count(aggregate(p, shiftleft(1L, size(g)) - 1L, (row, x) ->
    aggregate(array({_SAME}), row, (r, h) -> ((r + (r & h)) | (r - (r & h))) & (shiftleft(1L, size(g)) - 1L))))"""
_NUMBERS = """aggregate(p, array_repeat(0, size(g) + 1), (above, x) -> aggregate(sequence(1, size(g)), array(0), (acc, j) -> concat(acc, array(
        CASE WHEN get(g, j - 1) = x THEN get(above, j - 1) + 1 ELSE greatest(get(above, j), get(acc, j - 1)) END))), row -> get(row, size(g)))"""


def _shared(value: str, none: str) -> str:
    """The value of sequences that share a name, without a fold over others; null names leave the test open."""
    return f"CASE WHEN coalesce(arrays_overlap(p, g), true) THEN {value} ELSE {none} END"


# as functions.metrics.lcs: a row of bits for g of up to 62 elements
_LCS = _shared(f"CASE WHEN size(p) = 0 OR size(g) = 0 THEN 0 WHEN size(g) <= 62 THEN {_BITS} ELSE {_NUMBERS} END", "0")


def _ratio(a: str, b: str) -> str:
    return f"coalesce(try_divide(CAST({a} AS DOUBLE), {b}), 0D)"


#: name: (type, expression over p and g, neither of them null)
FUNCTIONS = {
    "seq_precision_at_k": ("DOUBLE", _ratio(f"size(array_intersect({_HEAD}, g))", "size(g)")),
    "seq_recall_at_k": ("DOUBLE", _ratio(f"size(array_intersect({_HEAD}, g))", "size(array_distinct(g))")),
    "seq_hit_rate": ("DOUBLE", f"CASE WHEN size(g) > 0 AND size(array_except(g, {_HEAD})) = 0 THEN 1D ELSE 0D END"),
    "seq_jaccard": ("DOUBLE", _shared(_ratio(_BOTH, "size(array_union(p, g))"), "0D")),
    "seq_set_precision": ("DOUBLE", _shared(_ratio(_BOTH, "size(array_distinct(p))"), "0D")),
    "seq_set_recall": ("DOUBLE", _shared(_ratio(_BOTH, "size(array_distinct(g))"), "0D")),
    "seq_set_f1": ("DOUBLE", _shared(_ratio(f"2 * {_BOTH}", "size(array_distinct(p)) + size(array_distinct(g))"), "0D")),
    "seq_lcs": ("INT", _LCS),
    "seq_lcs_recall": ("DOUBLE", _ratio(_LCS, "size(g)")),
    "seq_ordered_overlap": ("DOUBLE", _ratio(_LCS, "greatest(size(p), size(g))")),
    "seq_ordered_precision": (
        "DOUBLE",
        _shared(f"aggregate(array({_RANKS}), 0D, (z, r) -> CASE WHEN size(r) < 2 THEN 0D ELSE {_UP} / (size(r) * (size(r) - 1) / 2D) END)", "0D"),
    ),
    "seq_first_accuracy": ("DOUBLE", "CASE WHEN get(p, 0) = get(g, 0) THEN 1D ELSE 0D END"),
}


class BestFirst:
    """One row a step of the best-first path through a graph given as edges and similarities."""

    def eval(self, edges: list, sims: dict, entries: list, target: int) -> Iterator[tuple[int, str]]:
        out: dict[str, list[tuple[str, float]]] = {}
        for e in edges or []:
            out.setdefault(e["src"], []).append((e["dst"], e["weight"]))
        yield from enumerate(search(out, dict(sims or {}), list(entries or []), target))


def register(spark: SparkSession) -> list[str]:
    """Register all functions with the session, as temporary ones; returns their names."""
    none = "CAST(array() AS ARRAY<STRING>)"
    for name, (kind, body) in FUNCTIONS.items():
        # an array of one struct binds the arguments, with nulls made empty
        bound = f"element_at(transform(array(named_struct('p', coalesce(p_, {none}), 'g', coalesce(g_, {none}))), t -> {_bind(body)}), 1)"
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(p_ ARRAY<STRING>, g_ ARRAY<STRING>) RETURNS {kind} RETURN {bound}")
    spark.udtf.register("seq_best_first", udtf(BestFirst, returnType="step int, tool string"))
    return [*FUNCTIONS, "seq_best_first"]


def _bind(body: str) -> str:
    """The expression with p and g taken from the struct t."""
    return re.sub(r"(?<![\w.])(p|g)(?!\w)", r"t.\1", body)
