"""Fill-in-the-middle transformation by a table-driven scan of the texts' bytes.

A unit is a run of A-Z, a-z, or any other single code point. One automaton over bytes tells where units
and code points begin and where a sentinel (`<P>`, `<S>`, `<M>`) ends: its table gives, for each state and
byte, the next state and what the transition counts. Texts are scanned in lanes of LANE bytes, all lanes
of a slice in step; the state after any two bytes does not depend on what came before them, so a lane
starts from the two bytes before it. The scan leaves counts of each lane only; a second pass scans the
lanes that hold a cut again, and finds its byte.

A text is cut by two of its own numbers (the first three groups of eight hex digits of sha256 of
`seed:doc_id` give the cuts and whether it is transformed, the fourth gives the form), so the result does
not depend on how rows are dealt. `psm` is `<P>`prefix`<S>`suffix`<M>`middle, `spm` is
`<S>`suffix`<P>`prefix`<M>`middle, `plain` is the text as it is. A text that holds a sentinel stays plain,
so the parts of an output can be told apart, and `restored` rebuilds each text from output and form.

Edge cases: a null text counts as empty, an empty one is plain with n = 0; a null doc_id counts as an empty
string of digits; rows with equal doc_id are cut by the same numbers, each by its own length; very long
texts are scanned whole, in many lanes, and nothing longer than a slice or a single text is held; only
doc_id and the text are looked at, whatever other columns are named; an empty table returns no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, words

#: Bytes of a lane, and of the texts that are scanned together.
LANE, SLICE = 256, 1 << 22
SEED = 1
#: Of a hundred texts so many are transformed, and of a hundred of those so many have the suffix first.
SHARE, SUFFIX_FIRST = 90, 20
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"

#: What a transition counts, as fields of one number.
_UNIT, _CHAR, _HIT = 1, 1 << 20, 1 << 40
_FIELD = (1 << 20) - 1


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state, counts) by state * 256 + byte. States: 0 after no letter, 1 in letters, 2 after `<`, 3 after `<` and P, S or M."""
    step, count = np.zeros((4, 256), np.uint16), np.zeros((4, 256), np.int64)
    letters = [*range(65, 91), *range(97, 123)]
    for state in range(4):
        count[state] = _UNIT + _CHAR
        count[state, 0x80:0xC0] = 0  # goes on with a code point
        step[state, letters] = 1
        if state in (1, 3):
            count[state, letters] = _CHAR  # goes on with a unit
        step[state, ord("<")] = 2
    step[2, [ord(c) for c in "PSM"]] = 3
    count[3, ord(">")] += _HIT
    return (step << 8).ravel(), count.ravel()


_STEP, _COUNT = _automaton()


def _lanes(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lanes of texts that lie at at[i]:at[i + 1] one after the other: their first bytes, lengths and texts."""
    size = np.diff(at)
    n = -(-size // LANE)
    text = np.repeat(np.arange(len(size)), n)
    begin = at[text] + LANE * (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n))
    return begin, np.minimum(at[text + 1] - begin, LANE), text


def _entry(raw: np.ndarray, begin: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The state in which lanes are entered (as state * 256); first marks those at the head of a text."""
    state = np.zeros(len(begin), np.uint16)
    rest = np.flatnonzero(~first)
    for back in (2, 1):
        state[rest] = _STEP[state[rest] | raw[begin[rest] - back]]
    return state


def _steps(raw: np.ndarray, begin: np.ndarray, size: np.ndarray, state: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Step by step, the lanes that still have a byte and what their transition counts."""
    order = np.argsort(-size, kind="stable")
    begin, state = begin[order], state[order]
    live = np.searchsorted(-size[order], -np.arange(LANE), side="left")
    for k in range(int(size.max(initial=0))):
        m = int(live[k])
        code = state[:m] | raw[begin[:m] + k]
        yield order[:m], _COUNT[code]
        state[:m] = _STEP[code]


class Scan:
    """Counts of each text, and where its units begin."""

    def __init__(self, raw: np.ndarray, at: np.ndarray):
        self.raw, self.at = raw, at
        self.begin, self.size, self.text = _lanes(at)
        self.state = _entry(raw, self.begin, self.begin == at[self.text])
        counts = np.zeros(len(self.begin), np.int64)
        for lane, c in _steps(raw, self.begin, self.size, self.state):
            counts[lane] += c
        # sums before each lane, and before each text
        self.units, self.chars, hits = (np.r_[0, np.cumsum((counts >> s) & _FIELD)] for s in (0, 20, 40))
        head = np.searchsorted(self.text, np.arange(len(at)))
        self.units_at, self.chars_at = self.units[head], self.chars[head]
        self.n, self.n_chars, self.hits = np.diff(self.units_at), np.diff(self.chars_at), np.diff(hits[head])

    def cuts(self, text: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The byte at which the unit-th unit of a text begins (its end, if there are only so many), and the code points before it."""
        byte, chars = self.at[text + 1].copy(), self.n_chars[text].copy()
        inner = np.flatnonzero(unit < self.n[text])
        want = self.units_at[text[inner]] + unit[inner]
        lane = np.searchsorted(self.units, want, side="right") - 1
        left, before = want - self.units[lane], np.zeros(len(inner), np.int64)
        found = np.full(len(inner), -1)
        for k, (i, c) in enumerate(_steps(self.raw, self.begin[lane], self.size[lane], self.state[lane])):
            here = (c & _UNIT > 0) & (found[i] < 0)
            found[i[here & (left[i] == 0)]] = k
            left[i[here]] -= 1
            before[i] += (found[i] < 0) * (c >> 20 & 1)
        byte[inner] = self.begin[lane] + found
        chars[inner] = self.chars[lane] - self.chars_at[text[inner]] + before
        return byte, chars


def _numbers(doc_id: Column, seed: int) -> list[Column]:
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digits, 8 * i + 1, 8), 16, 10).cast("long").alias(f"_h{i + 1}") for i in range(4)]


_OUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def transform(docs: DataFrame, seed: int = SEED, share: int = SHARE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """Per document: doc_id, n (units), form, prefix_chars, middle_chars (null if plain) and output."""
    kinds = {"long": pa.int64(), "string": pa.string()}
    schema = pa.schema([(n, kinds[t]) for n, t in (x.split() for x in _OUT.split(", "))])

    def part(rows: pa.RecordBatch) -> pa.RecordBatch:
        raw, at = words.bytes_of(rows["text"])
        h1, h2, h3, h4 = (rows[f"_h{i}"].to_numpy() for i in (1, 2, 3, 4))
        scan = Scan(raw, at)
        n = scan.n
        plain = (n == 0) | (scan.hits > 0) | (h3 % 100 >= share)
        some = np.flatnonzero(~plain)
        one, two = h1[some] % (n[some] + 1), h2[some] % (n[some] + 1)
        (a, chars_a), (b, chars_b) = scan.cuts(some, np.minimum(one, two)), scan.cuts(some, np.maximum(one, two))
        whole = memoryview(raw)
        output = [whole[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]
        for d, i, j, last in zip(some.tolist(), a.tolist(), b.tolist(), (h4[some] % 100 < suffix_first).tolist(), strict=True):
            prefix, middle, suffix = whole[at[d] : i], whole[i:j], whole[j : at[d + 1]]
            parts = (SUFFIX, suffix, PREFIX, prefix) if last else (PREFIX, prefix, SUFFIX, suffix)
            output[d] = b"".join((*parts, MIDDLE, middle))
        prefix_chars, middle_chars, form = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64), np.full(len(n), "plain", object)
        prefix_chars[some], middle_chars[some] = chars_a, chars_b - chars_a
        form[some] = np.where(h4[some] % 100 < suffix_first, "spm", "psm")
        columns = [
            rows["doc_id"], pa.array(n), pa.array(form, pa.string()), pa.array(prefix_chars, mask=plain), pa.array(middle_chars, mask=plain),
            pa.array([bytes(x) for x in output], pa.binary()).cast(pa.string()),
        ]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in words.slices([batch["text"]], SLICE):
                yield part(batch.slice(i, j - i))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *_numbers(F.col("doc_id"), seed))
    return rows.mapInArrow(run, _OUT)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from. No part holds a sentinel, so the three that are found are those that were put in."""
    part = lambda i: F.get(F.split(output, "<[PSM]>", -1), F.lit(i))
    psm, spm = F.concat(part(1), part(3), part(2)), F.concat(part(2), part(3), part(1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
