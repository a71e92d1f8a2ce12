"""Set and sequence metrics of a prediction p against a truth g (arrays of names), as Column expressions.

K is the length of g, repeats included. A tool's rank in g, and its place in p, is its last one.
Null arrays count as empty.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ZERO = F.lit


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b), _ZERO(0.0))


def _f1(p: Column, r: Column) -> Column:
    return F.coalesce(F.try_divide(2.0 * p * r, p + r), _ZERO(0.0))


def _shared(p: Column, g: Column, value: Column) -> Column:
    """The value of sequences that share a name; 0 of others, which most pairs are, without a fold over them.

    Names that are null leave the test open, and are looked at in full.
    """
    return F.when(F.coalesce(F.arrays_overlap(p, g), F.lit(True)), value).otherwise(F.lit(0))


def last_place(seq: Column, x: Column) -> Column:
    """The last place of x in seq from 0, or -1."""
    at = F.array_position(F.reverse(seq), x)
    return F.when(at > 0, F.size(seq) - at).otherwise(F.lit(-1)).cast("int")


def precision_at(p: Column, g: Column) -> Column:
    return _shared(p, g, _ratio(F.size(F.array_intersect(F.slice(p, 1, F.size(g)), g)), F.size(g)))


def recall_at(p: Column, g: Column) -> Column:
    return _shared(p, g, _ratio(F.size(F.array_intersect(F.slice(p, 1, F.size(g)), g)), F.size(F.array_distinct(g))))


def f1_at(p: Column, g: Column) -> Column:
    return _f1(precision_at(p, g), recall_at(p, g))


def hit_rate(p: Column, g: Column) -> Column:
    """1 if the first K of p hold all of g, which is not empty."""
    return _shared(p, g, F.when((F.size(g) > 0) & (F.size(F.array_except(g, F.slice(p, 1, F.size(g)))) == 0), 1.0).otherwise(0.0))


def jaccard(p: Column, g: Column) -> Column:
    return _shared(p, g, _ratio(F.size(F.array_intersect(p, g)), F.size(F.array_union(p, g))))


def set_precision(p: Column, g: Column) -> Column:
    return _shared(p, g, _ratio(F.size(F.array_intersect(p, g)), F.size(F.array_distinct(p))))


def set_recall(p: Column, g: Column) -> Column:
    return _shared(p, g, _ratio(F.size(F.array_intersect(p, g)), F.size(F.array_distinct(g))))


def set_f1(p: Column, g: Column) -> Column:
    return _f1(set_precision(p, g), set_recall(p, g))


def lcs(p: Column, g: Column) -> Column:
    """Length of the longest common subsequence: a row of bits for g, which each element of p changes.

    A bit that is off is a place where the length grows; g of more than 62 elements has rows of numbers.
    """
    n = F.size(g)
    zero, full = F.lit(0).cast("long"), F.call_function("shiftleft", F.lit(1).cast("long"), n) - 1

    def bits(row: Column, x: Column) -> Column:
        at = F.aggregate(F.transform(g, lambda y, j: F.when(y == x, F.call_function("shiftleft", F.lit(1).cast("long"), j)).otherwise(zero)), zero, lambda a, b: a + b)
        hit = row.bitwiseAND(at)
        return (row + hit).bitwiseOR(row - hit).bitwiseAND(full)

    short = n - F.bit_count(F.aggregate(p, full, bits))
    start = F.array_repeat(F.lit(0), n + 1)

    def row(before: Column, x: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(1), n), F.array(F.lit(0)),
            lambda acc, j: F.concat(
                acc,
                F.array(F.when(F.get(g, j - 1) == x, F.get(before, j - 1) + 1).otherwise(F.greatest(F.get(before, j), F.get(acc, j - 1)))),
            ),
        )

    long = F.aggregate(p, start, row, lambda last: F.get(last, n))
    return F.when((F.size(p) > 0) & (n > 0), _shared(p, g, F.when(n <= 62, short).otherwise(long))).otherwise(F.lit(0))


def lcs_recall(p: Column, g: Column) -> Column:
    return _ratio(lcs(p, g), F.size(g))


def ordered_overlap(p: Column, g: Column) -> Column:
    return _ratio(lcs(p, g), F.greatest(F.size(p), F.size(g)))


def common_ranks(p: Column, g: Column) -> Column:
    """The ranks in g of the elements of p that g holds, in the order of p."""
    return F.transform(F.filter(p, lambda x: F.array_contains(g, x)), lambda x: last_place(g, x))


def _pairs(ranks: Column, test) -> Column:
    """Of all i < j, those whose ranks pass the test."""
    each = F.transform(
        ranks, lambda r, i: F.size(F.filter(F.slice(ranks, i + 2, F.greatest(F.size(ranks) - i - 1, F.lit(0))), lambda s: test(r, s)))
    )
    return F.aggregate(each, F.lit(0), lambda a, x: a + x)


def ordered_precision(p: Column, g: Column) -> Column:
    """Share of pairs of p's common elements whose ranks in g increase; 0 with fewer than two."""
    ranks = common_ranks(p, g)
    n = F.size(ranks)
    return _shared(p, g, F.when(n < 2, 0.0).otherwise(_ratio(_pairs(ranks, lambda a, b: b > a), n * (n - 1) / 2)))


def kendall_tau(p: Column, g: Column, dialect: str = "b") -> Column:
    """Rank agreement of p's common elements: tau-b; `a`: ties count for neither; `c`: ties are discordant."""
    ranks = common_ranks(p, g)
    n = F.size(ranks)
    total = n * (n - 1) / 2
    up, down = _pairs(ranks, lambda a, b: b > a), _pairs(ranks, lambda a, b: b < a)
    ties = _pairs(ranks, lambda a, b: a == b)
    value = {
        "a": lambda: F.try_divide((up - down).cast("double"), total),
        "b": lambda: F.try_divide((up - down).cast("double"), F.sqrt(total * (total - ties))),
        "c": lambda: F.try_divide((2 * up - total).cast("double"), total),
    }[dialect]()
    return _shared(p, g, F.when(n < 2, 0.0).otherwise(F.coalesce(value, _ZERO(0.0))))


def transition_accuracy(p: Column, g: Column, within: int = 2) -> Column:
    """Share of g's neighbours (a, b) with b one to `within` places after a in p; 0 if g is shorter than two."""
    heads = F.slice(g, 1, F.greatest(F.size(g) - 1, F.lit(0)))

    def good(a: Column, i: Column) -> Column:
        x, y = last_place(p, a), last_place(p, F.get(g, i + 1))
        return (x >= 0) & (y >= 0) & (y - x > 0) & (y - x <= within)

    return _shared(p, g, _ratio(F.size(F.filter(heads, good)), F.size(heads)))


def first_accuracy(p: Column, g: Column) -> Column:
    return F.coalesce((F.get(p, F.lit(0)) == F.get(g, F.lit(0))).cast("double"), _ZERO(0.0))


def categories(seq: Column) -> Column:
    return F.transform(seq, lambda t: F.substring_index(t, "_for_", -1))


def category_lcs_recall(p: Column, g: Column) -> Column:
    # worked out once: a fold over p would make g's categories again for each of its elements
    both = F.array(F.struct(categories(p).alias("p"), categories(g).alias("g")))
    return F.get(F.transform(both, lambda s: lcs_recall(s["p"], s["g"])), F.lit(0))


def category_count(g: Column) -> Column:
    """Different categories of g; names without one share "?"."""
    return F.size(F.array_distinct(F.transform(g, lambda t: F.when(F.instr(t, "_for_") > 0, F.substring_index(t, "_for_", -1)).otherwise("?"))))


SET_METRICS = {
    "precision_at_k": precision_at, "recall_at_k": recall_at, "f1_at_k": f1_at, "hit_rate": hit_rate, "jaccard": jaccard,
    "set_precision": set_precision, "set_recall": set_recall, "set_f1": set_f1,
}
ORDER_METRICS = {
    "ordered_precision": ordered_precision, "transition_acc": transition_accuracy, "first_tool_acc": first_accuracy,
    "kendall_tau": kendall_tau,
}
LCS_METRICS = {"lcs_r": lcs_recall, "ordered_overlap": ordered_overlap, "cat_lcs_r": category_lcs_recall}
ALL_METRICS = SET_METRICS | ORDER_METRICS | LCS_METRICS
