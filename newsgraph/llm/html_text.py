"""Main text of HTML pages: parser events, text-to-tag ratio per line, smoothing and clustering."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser
from operator import add
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements without content, those that never hold article text, and those that begin a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset(
    "nav header footer aside form script style noscript template iframe object svg canvas menu button select textarea title head dialog audio video map math".split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter nobr output picture progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: What a block element begins ends an open paragraph; these stop the search for it.
SCOPE = frozenset("article section main div body td th li table blockquote aside header footer nav form ul ol dl select".split())
#: Elements that an end tag is left out of often: what a new one ends, and what stops the search for that.
ENDS = {
    "li": (("li",), SCOPE - {"li"}), "dt": (("dt", "dd"), SCOPE), "dd": (("dt", "dd"), SCOPE), "option": (("option",), SCOPE),
    "tr": (("tr",), frozenset(["table"])), "td": (("td", "th"), frozenset(["table", "tr"])), "th": (("td", "th"), frozenset(["table", "tr"])),
}
#: Blocks that are lines of what they stand in, and parts of an article that need not be prose.
LINES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr thead tbody tfoot caption figcaption legend summary address option hr br html".split())
PARTS = frozenset("ul ol dl table td th blockquote pre figure details".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of a class, id or role that hardly ever mark article text, and those that may.
APART = frozenset(
    "ad ads advert adverts advertisement advertising breadcrumb breadcrumbs contentinfo cookie cookies consent copyright dropdown footer gdpr menu modal nav navbar navigation navlinks newsletter "
    "notice notification pagination pager popup promo promoted promotion share sharing sidebar signup skip social sponsor sponsored subscribe subscription".split()
)
BESIDE = APART | frozenset("banner complementary header masthead recommended recommendations related search tags teaser toolbar topbar widget".split())
#: Words that go with all of them, those that a part of the article may end with (post-header), and
#: those that tell a state of the page (has-sidebar).
NEUTRAL = frozenset("area bar block bottom box button buttons container content form group inner item items left link links list main outer page policy right section site slot small top unit wrap wrapper".split())
OWN = frozenset("header search share tags".split())
STATE = frozenset("has with no open closed without".split())
#: Reader comments: words that are enough, words that go with "comment", and who says what.
COMMENTS = frozenset("comments commentlist disqus respond".split())
OF_COMMENT = frozenset("area author block body box container content count form item list meta reply section text thread threads wrapper".split())
READERS, TALK = frozenset("reader readers user users visitor visitors guest".split()), frozenset("comment remark remarks reply replies discussion responses feedback thread".split())
#: On the scale of log1p(characters outside links for each tag): what a line beside an article or
#: main element lacks, what the two kinds of words take from a line, and what is prose anyhow, so that
#: a page of prose only is not split.
PRIOR, DOUBT, STRONG, PROSE = 1.0, 1.0, 3.0, float(np.log1p(25))


def _words(marks: str) -> list[set[str]]:
    parts = ([x for x in re.split(r"[-_0-9]+", m) if x] for m in re.sub(r"([a-z])([A-Z])", r"\1-\2", marks).lower().split())
    return [set(p) | {"." + p[-1]} for p in parts if p and not STATE & set(p)]


def of_readers(marks: str, tag: str) -> bool:
    """Whether a class, id or role names reader comments; of paragraphs, "comment" alone does not."""
    for p in _words(marks):
        alone = len(p) == 2 and tag not in ("p", "blockquote", "pre") and tag not in INLINE
        if p & COMMENTS or "comment" in p and (alone or p & OF_COMMENT) or p & READERS and p & TALK:
            return True
    return False


def doubt(marks: str) -> float:
    """What a class, id or role takes from the ratio of the lines in its element: it ends with such a
    word (page-sidebar), or holds one and else only words that go with all (sidebar-left)."""
    most = 0.0
    for p in _words(marks):
        parts = {x for x in p if x[0] != "."}
        last = {x[1:] for x in p - parts}
        if last & (BESIDE - OWN) or parts & BESIDE and parts <= BESIDE | NEUTRAL:
            most = max(most, STRONG if parts & APART else DOUBT)
    return most


class _Open(NamedTuple):
    """An open element: whether it is left out, what its marks take from a line, the container and block of its text."""

    tag: str
    left_out: bool
    doubt: float
    node: int
    block: str


class _Line(NamedTuple):
    text: str
    tags: int
    linked: int
    doubt: float
    node: int
    block: str


class _Lines(HTMLParser):
    """Blocks of a page as lines, and the containers around them, numbered from the root (0) on so
    that each comes after its parent. Places of open elements are kept by name, so that no event
    walks through all that are open."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[_Open] = []
        self.at: defaultdict[str, list[int]] = defaultdict(list)
        self.lines: list[_Line] = []
        self.text: list[str] = []
        self.tags = self.linked = 0
        self.parent = [0]
        self.kind = ["body"]
        self.ended = False

    # What begins like a declaration, a comment or an instruction and is not well formed ends with
    # the next ">", or with the page, as in browsers; the parser of the library raises or shows it.

    def _until(self, mark: str, i: int) -> int:
        end = self.rawdata.find(mark, i)
        return end + len(mark) if end >= 0 else len(self.rawdata) if self.ended else -1

    def parse_html_declaration(self, i: int) -> int:
        return self._until(">", i + 2)

    def parse_comment(self, i: int, report: bool = True) -> int:
        short = self.rawdata.startswith(("<!-->", "<!--->"), i)
        return self._until(">", i + 4) if short else self._until("-->", i + 4)

    def parse_pi(self, i: int) -> int:
        return self._until(">", i + 2)

    def _state(self) -> _Open:
        return self.open[-1] if self.open else _Open("body", False, 0.0, 0, "body")

    def _last(self, names: Iterable[str]) -> int:
        """The place of the last open element of these names, or -1."""
        return max((self.at[x][-1] for x in names if self.at[x]), default=-1)

    def _close(self, place: int) -> None:
        while len(self.open) > place:
            self.at[self.open.pop().tag].pop()

    def _break(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            now = self._state()
            self.lines.append(_Line(text, self.tags, self.linked, now.doubt, now.node, now.block))
            self.tags = self.linked = 0
        self.text = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag == "br":
            self.handle_data(" ")
        elif tag not in INLINE:
            self._break()
            ends, stops = ENDS.get(tag, (("p",), SCOPE))
            place = self._last(ends)
            if place >= 0 and place >= self._last(stops):
                self._close(place)
        if tag in VOID:
            return
        _, left_out, lacks, node, block = self._state()
        given = {k: v or "" for k, v in attrs if k in ("class", "id", "role", "hidden", "aria-hidden", "style")}
        if tag in SKIPPED and not (tag == "header" and (self.at["article"] or self.at["main"])):
            left_out = True
        elif tag not in ("html", "body", "main") and given:
            marks = " ".join(given.get(k, "") for k in ("class", "id", "role"))
            left_out |= of_readers(marks, tag)
            if tag != "article":
                left_out |= "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in given.get("style", "").replace(" ", "")
                lacks = max(lacks, doubt(marks))
        if tag not in INLINE:
            block = tag
            if tag not in LINES and tag != "body":
                self.parent.append(node)
                self.kind.append(tag)
                node = len(self.kind) - 1
        self.at[tag].append(len(self.open))
        self.open.append(_Open(tag, left_out, lacks, node, block))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag not in INLINE:
            self._break()
        place = self._last((tag,))
        if place >= 0 and not (tag in INLINE and place < self._last(SCOPE)):
            self._close(place)

    def handle_data(self, data: str) -> None:
        if self._state().left_out:
            return
        self.text.append(data)
        if self.at["a"]:
            self.linked += len(data.strip())


def smoothed(values: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing over the neighbouring lines, normalised at both ends."""
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    # "full" and a cut, for pages with fewer lines than the kernel has values.
    part = slice(reach, reach + len(values))
    return np.convolve(values, kernel)[part] / np.convolve(np.ones(len(values)), kernel)[part]


def threshold(values: np.ndarray) -> float:
    """Between the two clusters of values: 2-means on a line from the least and the greatest."""
    low, high = float(values.min()), float(values.max())
    for _ in range(30):
        cut = (low + high) / 2
        above = values > cut
        if above.all() or not above.any():
            return cut
        now = float(values[~above].mean()), float(values[above].mean())
        if now == (low, high):
            break
        low, high = now
    return (low + high) / 2


def main_text(html: str | None, sigma: float = 1.0) -> str:
    """The blocks of the article, joined by line feeds."""
    if not html:
        return ""
    # A tag that the page ends within is none.
    rest = html.rfind(">") + 1
    cut = re.search("<[A-Za-z/!?]", html[rest:])
    page = _Lines()
    page.feed(html[: rest + cut.start()] if cut else html)
    page.ended = True
    page.close()
    page._break()
    lines = page.lines
    if not lines:
        return ""
    node = np.array([x.node for x in lines])
    chars, linked, lacks = (np.array([f(x) for x in lines], float) for f in (lambda x: len(x.text), lambda x: x.linked, lambda x: x.doubt))
    # Characters outside links for each tag, smoothed over the lines.
    size = np.maximum(0, chars - linked)
    smooth = np.log1p(smoothed(size / np.maximum(1, [x.tags for x in lines]), sigma))
    # An article or main element is a prior: beside one, a line needs more for its tags, as it does
    # in elements whose names speak against it.
    named = _down(page.parent, [k in ("article", "main") for k in page.kind])
    prior = lacks + (np.where(named[node], 0.0, PRIOR) if named[node].any() else 0.0)
    smooth, own = smooth - prior, np.log1p(size / 2) - prior
    # The two clusters; what a name all but rules out is no content unless it is prose even so.
    open_to = lacks < STRONG
    cut = min(threshold(smooth[open_to]), PROSE) if open_to.sum() > 1 else -np.inf
    cuts = np.where(open_to, cut, PROSE)
    # Smoothing lifts what stands next to the article; a line that selects is above the cut by itself
    # too, with the two tags of a paragraph, as those of the containers around it say nothing of it.
    content = (smooth >= cuts) & (own >= cuts)
    if not content.any():
        content = open_to & (smooth >= cut)
    if not content.any():
        return ""
    # Article and main elements that hold most of the prose hold all of it.
    inside = content & named[node]
    if inside.any() and 2 * size[inside].sum() >= size[content].sum():
        content = inside
    keep = content | _belongs(page, node, content, chars, linked, named) & (lacks == 0)
    return "\n".join(x.text for x, good in zip(lines, keep, strict=True) if good)


def _down(parent: list[int], marked: list[bool]) -> np.ndarray:
    """Which containers are marked or within a marked one."""
    out = list(marked)
    for i in range(1, len(out)):
        out[i] = out[i] or out[parent[i]]
    return np.array(out)


def _up(parent: list[int], values: np.ndarray, join) -> np.ndarray:
    """The values of containers joined with those of all within them."""
    out = values.tolist()
    for i in range(len(out) - 1, 0, -1):
        out[parent[i]] = join(out[parent[i]], out[i])
    return np.array(out)


def _belongs(page: _Lines, node: np.ndarray, content: np.ndarray, chars: np.ndarray, linked: np.ndarray, named: np.ndarray) -> np.ndarray:
    """Which lines go with the content: in the smallest container of all content (or the article
    element around it), those of a block that holds content lines itself or of an article: its lines
    and headings, lists, tables and quotes, unless links make most of such a part, and whatever
    stands between content lines.
    """
    n, parent, kind = len(page.kind), page.parent, page.kind
    number = np.arange(len(node))
    count = _up(parent, np.bincount(node[content], minlength=n), add)
    region = inner = int(np.flatnonzero(count == count[0])[-1])
    while inner and kind[inner] != "article":
        inner = parent[inner]
    region = inner or region
    first, last, letters, links = np.full(n, len(node)), np.full(n, -1), np.zeros(n), np.zeros(n)
    np.minimum.at(first, node[content], number[content])
    np.maximum.at(last, node[content], number[content])
    np.add.at(letters, node, chars)
    np.add.at(links, node, linked)
    own = last >= 0
    first, last, letters, links = _up(parent, first, min), _up(parent, last, max), _up(parent, letters, add), _up(parent, links, add)
    in_region = _down(parent, [i == region for i in range(n)])
    one = _down(parent, (in_region & (own | named)).tolist())
    # The smallest container with content around each container without, and the part of it.
    around, part = list(range(n)), list(range(n))
    for i in range(1, n):
        if count[i] == 0:
            p = parent[i]
            around[i], part[i] = (around[p], part[p]) if count[p] == 0 else (p, i)
    c, b = np.array(around)[node], np.array(part)[node]
    direct = c == node
    heading = np.array([x.block in HEADINGS for x in page.lines])
    between = (first[c] < number) & (number < last[c])
    by_links = np.where(direct, False, 2 * links[b] > letters[b])
    fits = named[c] | direct | np.array([k in PARTS for k in kind])[b]
    return in_region[node] & (between & (one[c] | (c > 0) & ~by_links) | one[c] & (heading & direct | ~by_links & fits))


def _extracted(batches: Iterator[pa.RecordBatch], html_col: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x) for x in batch[html_col].to_pylist()]
        rest = batch.drop_columns([html_col])
        yield pa.record_batch([*rest.columns, pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], [*rest.schema.names, "text", "n_chars"])


def extract_main_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Replace the HTML of every page by its main text and n_chars, the code points of that.

    Events of the streaming parser give lines (blocks) with their text-to-tag ratio; smoothing
    and a threshold between two clusters mark content lines. An article or main element is a prior
    for its lines, words of a class, id or role are one against theirs (reader comments, navigation,
    forms and the like are left out). Kept are the content lines and, in the smallest container that
    encloses all of them, what belongs to these (see _belongs): links and notices around them go.

    Null or empty HTML, or nothing found: empty text. Equal pages give equal texts, each its row.
    Nested and unclosed elements take time linear in the page, however deep they are. Columns of
    pages named text and n_chars are replaced. One pass, no shuffle.
    """
    base = pages.drop("text", "n_chars")
    rest = [f for f in base.schema if f.name != html_col]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), "text string, n_chars long"])
    return base.select(*(F.col(f.name) for f in rest), F.col(html_col)).mapInArrow(lambda it: _extracted(it, html_col), schema)
