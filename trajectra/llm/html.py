"""Main text of HTML pages: flat text blocks classified by a small decision tree.

A page is cut at block-level tags into flat blocks. Each block is described by its word count and
link density, those of the blocks before and after it, and by where it stands (see `standing`). A
decision tree, grown here from the small labelled table BLOCKS, keeps or drops each block.

What stands in an outer container (a tag such as nav, an ARIA role, or a class or id that says so: adverts,
comments, notices, ...) is no main text at any length, and is not classified. Everywhere else the numbers decide: in an
article, lists of links go and linked lines between paragraphs stay; beside one, only runs of long
paragraphs without links stay; without one, paragraphs stay and short lines among links go. A class or id that
merely tells a state (has-sidebar, comments-open) or names a header is weak, and again the numbers decide. A header
element within an article belongs to it (its title), one outside is the site's. Names of containers around an
article don't count for what the article holds.

Pages are read once from the left, in time that grows with their length. Edge cases: a null or empty
page gives an empty text; unclosed tags end with their nearest closed container; a tag without an end
is ended by the next >, or is text; of elements that hold no text, an unclosed script or style reaches
to the end of the page, any other is passed over; character references are decoded; repeated rows are
treated alike; a column of the output's name is replaced, all others stay as they are; an empty table
returns no rows.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Tags that end the block before them.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset"
    " figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol"
    " option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
#: Tags whose content is no text.
SILENT_TAGS = frozenset("script style noscript template svg math iframe object canvas textarea select head".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Containers that rule a block in, and out.
MAIN_TAGS = frozenset("article main".split())
OUTER_TAGS = frozenset("nav footer aside form header menu dialog button".split())
#: Words of a class or id that name an outer container, and those that may as well name a part of the article.
HINTS = re.compile(
    r"(?:^|[_-])(?:ads?|advert\w*|alerts?|banner|breadcrumbs?|comments?|commentlist|consent|cookies?|discussions?|disqus|footer|menu|modal"
    r"|nav\w*|newsletter|notices?|notification|pagination|popup|promo\w*|related|remarks?|replies|respond|share|sharing|sidebar|social"
    r"|sponsor\w*|subscribe|toolbar|widgets?)(?:$|[_-])",
    re.I,
)
WEAK_HINTS = re.compile(r"(?:^|[_-])(?:header|masthead)(?:$|[_-])", re.I)
#: Classes that tell a state of what they stand on.
STATES = re.compile(r"^(?:has|with|without|no|is|show|hide)[_-]|[_-](?:enabled|disabled|active|open|closed|on|off|visible|layout|page)$", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_QUOTE_OR_END = re.compile("[\"'>]")
#: Elements whose content is not read for tags, and those of them that reach to the end without an end tag.
RAW_TAGS = frozenset("script style textarea iframe noscript template".split())
TO_THE_END = frozenset("script style".split())
_RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW_TAGS}
_ATTR = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)

#: Labelled blocks, one a line: words, link density, words and link density of the block before and of the one after;
#: then main text (1) or not (0). The groups are those of `standing`.
BLOCKS = {
    # on a page without an article, weakly named
    1: """
35 .00 30 .00 40 .00 1
60 .00 0 .00 50 .02 1
5 .00 50 .00 60 .00 1
28 .05 40 .00 8 .00 1
90 .00 4 1.0 60 .00 1
7 .00 30 .00 45 .00 1
45 .00 55 .00 0 .00 1
8 .00 2 1.0 3 1.0 0
4 .00 0 .00 3 1.0 0
12 .00 6 .00 8 .00 0
30 .30 4 1.0 3 1.0 0
2 1.0 3 1.0 2 1.0 0
15 .00 3 1.0 60 .00 0
5 .00 0 .00 9 .00 0
6 .70 40 .00 50 .00 0
32 .00 32 .00 3 .00 1
30 .00 40 .00 5 1.0 1
60 .00 30 .00 0 .00 1
45 .00 2 .00 35 .00 1
26 .00 80 .00 12 .00 1
32 .00 0 .00 32 .00 1
""",
    # beside the article
    2: """
12 .00 1 1.0 10 .00 0
6 .50 30 .00 8 .00 0
55 .00 12 .00 6 .00 0
4 .00 0 .00 9 .00 0
25 .00 14 .10 3 1.0 0
120 .00 100 .00 90 .02 1
150 .01 90 .00 110 .00 1
105 .00 140 .00 85 .00 1
200 .03 120 .00 160 .00 1
70 .00 20 .00 10 .00 0
60 .00 60 .00 50 .00 0
90 .00 5 .00 8 .00 0
130 .00 10 .00 9 .00 0
140 .00 120 .00 15 .00 0
140 .00 15 .00 120 .00 0
180 .20 120 .00 110 .00 0
80 .00 90 .00 100 .00 0
1 1.0 1 1.0 1 1.0 0
9 .00 0 .00 12 .00 0
35 .00 30 .00 40 .00 0
60 .00 0 .00 50 .02 0
5 .00 50 .00 60 .00 0
28 .05 40 .00 8 .00 0
90 .00 4 1.0 60 .00 0
7 .00 30 .00 45 .00 0
45 .00 55 .00 0 .00 0
95 .00 70 .00 75 .00 0
""",
    # on a page without an article
    3: """
60 .00 40 .00 55 .00 1
25 .00 60 .00 70 .02 1
18 .00 45 .00 35 .00 1
80 .05 9 .00 4 1.0 1
7 .00 1 1.0 75 .00 1
5 .00 50 .00 60 .00 1
4 .00 44 .00 38 .00 1
15 .10 20 .00 25 .00 1
30 .30 60 .00 50 .00 1
120 .00 3 1.0 5 1.0 1
35 .00 0 .00 0 .00 1
20 .00 0 .00 0 .00 1
50 .00 30 .00 0 .00 1
40 .00 3 1.0 6 .10 1
25 .00 12 .00 2 .00 1
1 1.0 1 1.0 1 1.0 0
3 1.0 2 1.0 4 1.0 0
12 .80 5 1.0 40 .00 0
4 .00 3 1.0 2 1.0 0
5 .00 2 .00 3 1.0 0
4 .00 0 .00 0 .00 0
6 .00 30 .00 0 .00 0
6 .60 70 .00 4 .80 0
2 1.0 90 .00 60 .00 0
6 .00 40 .00 7 .00 1
7 .00 6 .00 8 .00 1
8 .00 7 .00 45 .00 1
3 .00 5 .00 4 .00 1
9 .10 12 .00 10 .20 1
4 .00 90 .05 6 .00 1
12 .00 5 .00 6 .15 1
2 .00 3 .00 30 .00 1
8 .50 40 .00 60 .00 1
14 .40 80 .10 25 .00 1
5 .00 4 .90 3 .00 0
5 .00 30 .00 4 1.0 0
9 .00 2 1.0 12 .60 0
7 .00 6 .80 5 .90 0
11 .10 3 1.0 2 1.0 0
6 .00 1 1.0 8 .00 0
9 .70 45 .00 50 .00 0
16 .90 8 1.0 70 .00 0
30 .80 20 .75 25 .70 0
13 .60 6 1.0 5 1.0 0
22 .05 4 .90 60 .00 1
26 .00 50 .00 3 1.0 1
40 .20 6 .80 4 1.0 1
4 .00 3 .00 3 .00 1
4 .00 3 .00 2 .00 1
4 .00 3 1.0 3 .00 0
4 .00 3 .00 2 1.0 0
5 .00 5 .00 5 .00 1
5 .00 5 1.0 5 .00 0
5 .00 5 .00 5 1.0 0
8 .00 4 .00 3 .00 1
8 .00 4 1.0 3 .00 0
8 .00 4 .00 3 1.0 0
2 .00 2 .00 2 .00 1
2 .00 2 1.0 2 .00 0
2 .00 2 .00 2 1.0 0
""",
    # in the article, weakly named
    4: """
6 .00 0 .00 3 .00 1
8 .00 6 .00 40 .00 1
50 .00 60 .00 50 .00 1
4 .25 9 .00 60 .00 1
5 .00 4 1.0 70 .00 1
2 .00 8 .00 3 .00 1
30 .10 5 .00 20 .00 1
3 1.0 6 .00 2 1.0 0
2 1.0 0 .00 5 .00 0
5 .60 4 .00 30 .00 0
4 .80 2 1.0 50 .00 0
9 .70 3 .00 4 .00 0
12 1.0 0 .00 60 .00 1
8 1.0 0 .00 40 .00 1
25 1.0 6 .00 50 .00 1
12 1.0 3 1.0 2 1.0 0
8 1.0 2 1.0 40 .00 0
25 1.0 6 .00 4 1.0 0
6 1.0 0 .00 90 .00 1
6 1.0 4 1.0 90 .00 0
""",
    # in the article
    5: """
60 .00 40 .00 55 .00 1
12 .00 60 .00 30 .00 1
1 .00 0 .00 80 .00 1
3 .00 20 .00 4 .00 1
9 .00 4 1.0 70 .00 1
45 .08 60 .00 30 .00 1
6 1.0 50 .00 40 .00 1
14 .60 35 .00 8 .00 1
200 .01 10 .00 0 .00 1
2 .00 1 1.0 1 .00 1
1 .00 1 1.0 1 1.0 1
4 1.0 0 .00 70 .00 1
5 .00 5 .00 5 .00 1
5 .00 5 1.0 5 1.0 1
2 .00 2 1.0 2 1.0 1
30 .45 12 1.0 40 .00 1
8 .40 3 1.0 4 1.0 1
60 .70 50 .10 45 .05 1
25 .10 3 1.0 4 1.0 1
80 .20 9 1.0 8 1.0 1
9 1.0 4 .00 0 .00 1
3 1.0 6 .00 5 .20 1
2 1.0 2 1.0 3 1.0 0
4 1.0 3 1.0 60 .00 0
3 1.0 40 .00 2 1.0 0
5 .90 4 1.0 6 .95 0
8 1.0 8 .90 7 1.0 0
6 .80 0 .00 5 1.0 0
10 1.0 9 1.0 0 .00 0
3 .75 2 1.0 30 .00 0
3 .75 30 .00 2 1.0 0
20 .95 18 .90 15 1.0 0
""",
}


def grow(x: np.ndarray, y: np.ndarray, depth: int = 9) -> tuple:
    """A decision tree by Gini impurity: (feature, threshold, left, right), leaves are 0 or 1."""
    if depth == 0 or y.min() == y.max():
        return (int(y.mean() >= 0.5),)
    best = (np.inf, 0, 0.0)
    for j in range(x.shape[1]):
        values = np.unique(x[:, j])
        for t in (values[1:] + values[:-1]) / 2:
            left, right = y[x[:, j] <= t], y[x[:, j] > t]
            impurity = sum(len(s) * s.mean() * (1 - s.mean()) for s in (left, right))
            best = min(best, (round(float(impurity), 12), j, float(t)))
    if best[0] == np.inf:
        return (int(y.mean() >= 0.5),)
    go = x[:, best[1]] <= best[2]
    return best[1], best[2], grow(x[go], y[go], depth - 1), grow(x[~go], y[~go], depth - 1)


def standing(main: bool, weak: bool, any_main: bool) -> int:
    """On a page without an article 3 (weakly named 1), beside the article 2, in it 5 (weakly named 4)."""
    if main:
        return 4 if weak else 5
    return 2 if any_main else 1 if weak else 3


@lru_cache(maxsize=1)
def tree() -> tuple:
    """The tree of the labelled table."""
    rows = [(*map(float, line.split()), place) for place, lines in BLOCKS.items() for line in lines.split("\n") if line]
    return grow(np.array([[*r[:6], r[7]] for r in rows]), np.array([r[6] for r in rows]))


def keeps(features: tuple) -> bool:
    node = tree()
    while len(node) > 1:
        node = node[2] if features[node[0]] <= node[1] else node[3]
    return bool(node[0])


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(text, "", "") of stretches between tags, and ("", name, attributes) of tags; the name of an end tag begins with a slash."""
    at, size, loose, endless = 0, len(page), False, set()
    while at < size:
        begin = page.find("<", at)
        if begin < 0:
            begin = size
        if begin > at:
            yield page[at:begin], "", ""
        if begin == size:
            return
        if page.startswith("<!--", begin):
            end = page.find("-->", begin + 4)
            at = size if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), begin):
            mark = "]]>" if page.startswith("<![CDATA[", begin) else ">"
            end = page.find(mark, begin)
            at = size if end < 0 else end + len(mark)
            continue
        slash = page.startswith("/", begin + 1)
        name = _NAME.match(page, begin + 1 + slash)
        if not name:
            yield "<", "", ""
            at = begin + 1
            continue
        end = -1 if loose else _end_of_tag(page, name.end())
        if end < 0:  # quotes are not closed: from here on, they mean nothing
            loose, end = True, page.find(">", name.end())
        if end < 0:
            yield page[begin:], "", ""
            return
        at, tag = end + 1, name[0].lower()
        if tag in RAW_TAGS and not slash:
            if tag not in endless and (raw := _RAW_END[tag].search(page, at)):
                at = raw.end()
                continue
            endless.add(tag)
            if tag in TO_THE_END:
                return
            continue
        yield "", "/" * slash + tag, page[name.end() : end]


def _end_of_tag(page: str, at: int) -> int:
    """The first > outside quotes, or -1."""
    while m := _QUOTE_OR_END.search(page, at):
        if m[0] == ">":
            return m.start()
        at = page.find(m[0], m.end()) + 1
        if not at:
            return -1
    return -1


_NOWHERE = (False, False, False, False, False)


class _Blocks:
    """The flat blocks of a page."""

    def __init__(self, page: str):
        #: (text, words, link density, in main container, in outer container, in one with a weak name)
        self.found: list[tuple[str, int, float, bool, bool, bool]] = []
        # open elements: tag, and what holds within: main, outer by tag or role, silent, outer by name, weak name
        self.stack: list[tuple[str, bool, bool, bool, bool, bool]] = []
        self.open: Counter[str] = Counter()
        self.now = _NOWHERE
        self.raw: list[str] = []
        self.linked: list[str] = []
        self.links = 0
        for text, tag, attributes in tokens(page):
            if text:
                if not self.now[2]:
                    self.raw.append(text)
                    if self.links:
                        self.linked.append(text)
            else:
                self.tag(tag, attributes)
        self.close()

    def close(self) -> None:
        if self.raw:
            words = entities.unescape("".join(self.raw)).split()
            if words:
                n = len(entities.unescape(" ".join(self.linked)).split())
                main, outer, _, named, weak = self.now
                self.found.append((" ".join(words), len(words), min(1.0, n / len(words)), main, outer or named, weak))
            self.raw.clear()
            self.linked.clear()

    def pop(self) -> str:
        tag = self.stack.pop()[0]
        self.open[tag] -= 1
        self.now = self.stack[-1][1:] if self.stack else _NOWHERE
        return tag

    def tag(self, tag: str, attributes: str) -> None:
        ending, tag = tag[0] == "/", tag.lstrip("/")
        if tag in BLOCK_TAGS:
            self.close()
        if tag == "a":
            self.links = max(0, self.links + (-1 if ending else 1))
        if ending:
            if self.open[tag]:
                while self.pop() != tag:
                    pass
            return
        if tag in VOID_TAGS:
            return
        if tag in ("p", "li", "td", "th", "tr", "dt", "dd", "option") and self.stack and self.stack[-1][0] == tag:
            self.pop()
        main, outer, silent, named, weak = self.now
        if attributes.strip() and tag not in ("html", "body", "main", "article"):
            for key, *values in _ATTR.findall(attributes):
                value, key = "".join(values), key.lower()
                if key in ("class", "id"):
                    for word in value.split():
                        hinted = bool(HINTS.search(word))
                        state = hinted and bool(STATES.search(word))
                        named, weak = named or (hinted and not state), weak or state or bool(WEAK_HINTS.search(word))
                else:
                    outer = outer or (value.lower() in ROLES if key == "role" else value.lower() != "false" if key == "aria-hidden" else True)
        if tag in MAIN_TAGS:
            main, named, weak = True, False, False
        elif tag == "header" and main:
            weak = True
        elif tag in OUTER_TAGS:
            outer = True
        self.stack.append((tag, main, outer, silent or tag in SILENT_TAGS, named, weak))
        self.open[tag] += 1
        self.now = self.stack[-1][1:]


def main_text(page: str | None) -> str:
    """The main text of a page: kept blocks in page order, joined by one blank."""
    found = _Blocks(page or "").found
    any_main = any(b[3] for b in found)
    edge = ("", 0, 0.0)
    kept = []
    for before, (text, n, density, main, outer, weak), after in zip([edge, *found], found, [*found[1:], edge], strict=False):
        if not outer and keeps((n, density, before[1], before[2], after[1], after[2], standing(main, weak, any_main))):
            kept.append(text)
    return " ".join(kept)


def extract(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """Add the main text of every page as column `out`."""

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        try:
            for column in batches:
                yield column.map(lambda page: main_text(None if page is None or page != page else page))
        finally:
            common.release()

    return pages.withColumn(out, texts(F.col(html)))
