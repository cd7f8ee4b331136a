"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one per block element, with the lines that it leaves empty: one between neighbours, and one more for each level of nesting between them.
Elements marked as menus, notices, adverts, comments and the like are stripped with their text, as scripts are.  A line weighs its length, up to ``CAP``, a line of links nothing.
The sum over a sliding window of lines jumps where the article begins (surge) and falls to nothing where it ends (dive); what lies between is kept, from the first line that makes the sum
jump to the last before it falls: short lines of bare containers before and after those are the page's frame.  Where the windows inside an ``article`` or ``main`` element reach a third of what
the others reach, its lines weigh ``RAISE`` more and those around it nothing; a teaser does not reach that.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW, SURGE = 3, 86
#: Least length of a line that makes the sum jump whatever its element is.
EDGE = SURGE // WINDOW
#: Most that a line's length weighs; what a line inside the marked article weighs more.
CAP = 3 * SURGE
RAISE = 3 * CAP

#: Elements whose content is text without markup, that show no text, that break lines, that hold no article text, that have no end tag.
RAW_TEXT = "script style textarea title iframe noembed noframes xmp"
SILENT = "head noscript template svg math object canvas select audio video map"
BLOCKS = (
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul caption"
)
#: Blocks that hold running text (the others are containers, whose nesting makes empty lines), and those that only a list has.
TEXTUAL = "address blockquote caption dd dl dt figcaption h1 h2 h3 h4 h5 h6 hr ol p pre summary table tbody td tfoot th thead tr ul"
LISTED = "li option"
BOILERPLATE = "nav footer aside dialog menu button search"
#: These may also hold the article (a form around a whole page).
WRAPPERS = "form header"
VOID = "area base br col embed hr img input link meta param source track wbr"
#: Words in class, id or role that mark what is not the article; words that may stand beside them; words that mark reader comments.
MARKS = (
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe subscription paywall sidebar side rail widget widgets related recommended recommendations share sharing social nav navbar navigation menu "
    "breadcrumb breadcrumbs pagination pager footer copyright masthead login signup search complementary contentinfo toolbar skip"
)
COMMENT_MARKS = "comment comments disqus reply replies respond"
BESIDE = (
    "a the site page main top bottom left right upper lower inner outer header head body bar box block area section container content wrapper wrap holder panel list item items link links row col column "
    "group unit slot zone region small large sm md lg xl mobile desktop primary secondary global fixed sticky form field input button buttons icon icons text title module component layout js"
)
#: Elements that the start of another ends, and where the search for them stops.
ENDED_BY = {"li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "td": ("td th", "table tr"), "th": ("td th", "table tr"), "tr": ("tr", "table"), "option": ("option", "select")}
P_SCOPE = "table td th caption button object article main body html"

_words = lambda x: frozenset(x.split())
_RAW, _SILENT, _BLOCKS, _BOILERPLATE, _WRAPPERS, _VOID = map(_words, (RAW_TEXT, SILENT, BLOCKS, BOILERPLATE, WRAPPERS, VOID))
_TEXTUAL, _LISTED = _words(TEXTUAL), _words(LISTED)
_COMMENTS, _P_SCOPE = _words(COMMENT_MARKS), _words(P_SCOPE)
_MARKS, _BESIDE = _words(MARKS) | _COMMENTS, _words(BESIDE)
_ENDED_BY = {k: (_words(a), _words(b)) for k, (a, b) in ENDED_BY.items()}
_SCOPED = _words("p li dt dd")

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"  # comment
    r"|<[!?][^>]*(?:>|\Z)"  # declaration
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attributes>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)"
    r"|<(?P<odd>/?[a-zA-Z][^>]*)(?:>|\Z)",  # a tag with unbalanced quotes
    re.S,
)
_ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_QUOTED, _HIDDEN = re.compile(r"\"[^\"]*\"|'[^']*'"), re.compile(r"\bhidden\b")
_UNSEEN = re.compile(r"\bstyle\s*=\s*[\"']?[^\"'>]*\b(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)

#: How far a place is from the article: nothing marks it; a mark that an article inside lifts; a mark that nothing lifts.
_PLAIN, _MARKED, _OUT = 0, 1, 2
#: What a line's innermost block is.
_BARE, _ITEM, _TEXT = 0, 1, 2


class Line(NamedTuple):
    text: str
    inside: bool  #: of an article or main element
    marked: bool  #: as boilerplate
    linked: bool  #: mostly link text
    depth: int = 0  #: containers around it
    kind: int = _TEXT
    owner: int = 0  #: number of its innermost block (0: the page)


class _State(NamedTuple):
    silent: bool
    mark: int
    inside: bool
    depth: int = 0
    kind: int = _BARE
    owner: int = 0


def mark_of(attributes: str) -> int:
    """Whether a whole class, id or role says that the element is not the article: all its words do, or may stand beside those that do."""
    found = _PLAIN
    for groups in _ATTRIBUTE.findall(attributes):
        for token in "".join(groups).split():
            parts = {p.lower() for p in _PART.findall(token)}
            if parts & _MARKS and parts <= _MARKS | _BESIDE:
                found = max(found, _OUT if parts & _COMMENTS else _MARKED)
    if found < _OUT and "hidden" in attributes and _HIDDEN.search(_QUOTED.sub("", attributes)):
        found = _OUT
    if found < _OUT and "style" in attributes.lower() and _UNSEEN.search(attributes):
        found = _OUT
    return found


class _Reader:
    """Walks over a page's tags with the stack of open elements, and collects its lines."""

    def __init__(self, page: str) -> None:
        self.lines: list[Line] = []
        self.outer = [0]  #: of each block, the number of the one around it
        self._page, self._parts, self._linked, self._links = page, [], 0, 0
        self._stack: list[tuple[str, _State]] = []  # each with the state outside it
        self._names: Counter[str] = Counter()  # of the open elements, so that the stack is searched only for what it holds
        self._state = _State(False, _PLAIN, False)
        self._last_end = {m[1].lower(): m.start() for m in re.finditer(r"</([a-zA-Z][a-zA-Z0-9:-]*)", page)}
        at, size = 0, len(page)
        while at < size:
            token = _TOKEN.search(page, at)
            stop = token.start() if token else size
            if stop > at and not self._state.silent:
                self._parts.append(page[at:stop])
                if self._links:
                    self._linked += stop - at
            if token is None:
                break
            at = token.end()
            if token["name"]:
                name = token["name"].lower()
                if token["end"]:
                    self._close(name)
                else:
                    at = self._open(name, token["attributes"], at)
        self._break()

    def _break(self) -> None:
        if self._parts:
            raw = "".join(self._parts)
            text = " ".join(html.unescape(raw).split())
            if text:
                state = self._state
                self.lines.append(Line(text, state.inside, state.mark > _PLAIN, 2 * self._linked > len(raw), state.depth, state.kind, state.owner))
            self._parts, self._linked = [], 0

    def _pop(self, at: int) -> None:
        self._state = self._stack[at][1]
        self._names.subtract(name for name, _ in self._stack[at:])
        del self._stack[at:]

    def _end_implied(self, names: frozenset[str], scope: frozenset[str]) -> None:
        if not any(self._names[x] for x in names):
            return None
        for i in range(len(self._stack) - 1, -1, -1):
            open_ = self._stack[i][0]
            if open_ in names:
                return self._pop(i)
            if open_ in scope:
                return None
        return None

    def _close(self, name: str) -> None:
        if name == "a":
            self._links = max(0, self._links - 1)
        elif name == "br":
            self._parts.append(" ")
        block = name in _BLOCKS
        if block:
            self._break()
            self._links = 0
        if not self._names[name]:
            return None
        for i in range(len(self._stack) - 1, -1, -1):
            open_ = self._stack[i][0]
            if open_ == name:
                return self._pop(i)
            if (not block and open_ in _BLOCKS) or (name in _SCOPED and open_ in _P_SCOPE):
                return None
        return None

    def _open(self, name: str, attributes: str, at: int) -> int:
        """Returns where to read on."""
        state, single = self._state, attributes.endswith("/") or name in _VOID
        if name in _RAW and not single:
            found = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(self._page, at)
            if found or name in ("script", "style"):
                return found.end() if found else len(self._page)
            return at  # never closed: as if empty
        if name == "a":
            self._links += not single
        elif name == "br":
            self._parts.append(" ")
        block = name in _BLOCKS
        if block:
            self._break()
            self._links = 0
            self._end_implied(frozenset(("p",)), _P_SCOPE)
            if name in _ENDED_BY:
                self._end_implied(*_ENDED_BY[name])
            if name == "body" or state.silent:
                self._end_implied(frozenset(("head",)), frozenset())
            state = self._state
        if single:
            return at
        mark = _PLAIN if name in ("html", "body") else mark_of(attributes)
        if name in _SILENT:
            if self._last_end.get(name, -1) < at and name != "head":
                return at
            new = state._replace(silent=True)
        elif name in ("article", "main"):
            own = _OUT if mark and name == "article" else _PLAIN
            outer = state.mark if state.mark == _OUT else _PLAIN
            new = state._replace(mark=max(own, outer), inside=not own and not outer or state.inside)
        elif name in _BOILERPLATE:
            new = state._replace(mark=_OUT)
        elif mark or (name in _WRAPPERS and not (name == "header" and state.inside)):
            mark = max(mark, _MARKED)
            new = state._replace(mark=max(state.mark, mark)) if block else state._replace(silent=True)
        else:
            new = state
        if block and name != "body":
            kind = _TEXT if name in _TEXTUAL else _ITEM if name in _LISTED else _BARE
            new = new._replace(depth=new.depth + (kind == _BARE), kind=kind, owner=len(self.outer))
            self.outer.append(state.owner)
        self._stack.append((name, state))
        self._names[name] += 1
        self._state = new
        return at


def lines_of(page: str) -> list[Line]:
    """All lines of a page that have text, in order, those of boilerplate elements included."""
    return _Reader(page).lines


def _window_sums(values: list[int]) -> list[int]:
    return [sum(values[i : i + WINDOW]) for i in range(len(values))]


def empty_between(one: Line, other: Line) -> int:
    """Lines that markup leaves empty between two neighbours; a dive needs no more than ``WINDOW``."""
    return min(WINDOW, 1 + abs(one.depth - other.depth))


def distribution(lines: list[Line]) -> tuple[list[int], list[int]]:
    """(weights, places): what each line of a page weighs, empty lines included, and where each of ``lines`` (none of them marked) stands."""
    lengths, places = [], []
    for i, line in enumerate(lines):
        lengths += [0] * (empty_between(lines[i - 1], line) if i else 0)
        places.append(len(lengths))
        lengths.append(0 if line.linked and not line.inside else min(len(line.text), CAP))
    inside = [0] * len(lengths)
    for place, line in zip(places, lines):
        inside[place] = lengths[place] if line.inside else 0
    level, around = (max(_window_sums(x), default=0) for x in (inside, [a - b for a, b in zip(lengths, inside)]))
    if level and WINDOW * level >= around:
        return [x + RAISE if x else 0 for x in inside], places
    return lengths, places


def framed(lines: list[Line], kept: list[bool], outer: list[int]) -> list[bool]:
    """``kept`` without short lines before the first that makes the sum jump and after the last.

    Running text, and lines of ``EDGE`` characters, make it jump; items of a list do so only after such a line.  A line nested in the block whose own text is that long stays with it.
    """
    heavy = [False] * len(outer)
    for line, keep in zip(lines, kept):
        if keep and line.owner and len(line.text) >= EDGE:
            heavy[line.owner] = True
    for i in range(1, len(outer)):  # a block's number is above that of the block around it
        heavy[i] = heavy[i] or heavy[outer[i]]
    jumps = [keep and (line.inside or line.kind == _TEXT or len(line.text) >= EDGE or heavy[line.owner]) for line, keep in zip(lines, kept)]
    if not any(jumps):
        return kept
    first = jumps.index(True)
    last = max(i for i in range(first, len(lines)) if jumps[i] or (kept[i] and lines[i].kind == _ITEM))
    return [keep and first <= i <= last for i, keep in enumerate(kept)]


def kept_lines(weights: list[int]) -> list[bool]:
    """Which lines lie between a surge and the dive after it.

    The highest sum of a window is the page's level.  Where it is above what plain lines can reach, lines that weigh less than a third of the difference a line count as
    nothing.  A stretch between two dives (windows that sum to nothing) is kept if a window in it surges: ``SURGE``, or the page's level where that is lower, and three such least lines.
    """
    level = max(_window_sums(weights), default=0)
    least = max(0, level - WINDOW * CAP) // (WINDOW * 3)
    heavy = [w if w >= least else 0 for w in weights]
    sums = _window_sums(heavy)
    surge = max(min(SURGE, level), WINDOW * least)
    kept, start = [False] * len(weights), 0
    while start < len(sums):
        stop = start
        while stop < len(sums) and sums[stop] > 0:
            stop += 1
        if max(sums[start:stop], default=0) >= surge > 0:
            kept[start:stop] = [w > 0 for w in heavy[start:stop]]
        start = stop + 1
    return kept


def main_text(page: str | None) -> str:
    """Article of a page: its lines joined by two line feeds; '' if there is none (null, empty, markup only)."""
    reader = _Reader(page or "")
    lines = [x for x in reader.lines if not x.marked]
    weights, places = distribution(lines)
    between = kept_lines(weights)
    kept = framed(lines, [between[at] for at in places], reader.outer)
    return "\n\n".join(x.text for x, keep in zip(lines, kept) if keep)


def main_text_column(page: Column) -> Column:
    @F.pandas_udf(T.StringType())
    def extract(pages: pd.Series) -> pd.Series:
        return pd.Series([main_text(p) for p in pages], dtype=object)

    return extract(page)


def with_main_text(pages: DataFrame, html_column: str = "html", text_column: str = "main_text") -> DataFrame:
    """``pages`` plus the article's text (never null) and ``n_chars``, its code points; columns of these names are replaced.

    Every row is worked on alone, whatever its other columns hold: repeated rows give repeated results, a null or empty page gives '', an empty table an empty result.
    A page's memory is a few times its length, however long it is.  Windows of equal sums need no choice: all that lies between a surge and its dive stays.
    """
    return pages.withColumn(text_column, main_text_column(F.col(html_column))).withColumn("n_chars", F.length(text_column).cast("long"))
