"""Main text of web pages: parser events, text-to-tag ratios per line, smoothing and threshold clustering."""

from __future__ import annotations

import re
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_UNREAD = frozenset("script style template noscript iframe svg math canvas object head title select option button textarea audio video map dialog".split())
_BOILERPLATE = frozenset("nav footer aside menu fieldset label".split())
_CONTAINERS = frozenset("html body article main section div td blockquote center".split())
_BLOCKS = _CONTAINERS | _BOILERPLATE | frozenset("form p h1 h2 h3 h4 h5 h6 header ul ol li dl dt dd table thead tbody tfoot tr th caption pre figure figcaption address hr hgroup details summary".split())
#: What may stand in a head; anything else ends one that was left open.
_IN_HEAD = frozenset("html head base basefont bgsound link meta title style script noscript noframes template".split())
#: An open element that the start of another ends.
_ENDS = {"p": _BLOCKS - {"td"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
#: Words in class, id or role that mark what may not be the article.
_MARKS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs masthead footer sidebar aside complementary contentinfo banner ad ads advert adverts advertisement advertising adsense"
    " sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup login search share sharing social related recommended"
    " recommendations comment comments respond replies disqus discussion popup modal overlay widget toolbar pagination pager tags".split()
)
#: What may stand beside such a word in one name (``site-footer``, ``related-posts``); ``has-sidebar`` or ``market-share`` mark nothing.
_BESIDE = frozenset("site page main global top bottom left right primary secondary post posts article articles blog user reader readers list section area container wrapper wrap box block bar form links link inner outer body buttons button slot unit item items panel row col skip to up sign reply in us".split())
_PAGE_HEADER = re.compile(r"(?:^|\s)(?:(?:site|page|top|global|main)[_-])?header(?:$|\s)", re.IGNORECASE)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
_MAIN = frozenset({"article", "main"})
#: The same for elements that are an article by their tag: of readers, or of something else.
_NOT_THE_MAIN = frozenset("comment comments respond replies disqus related recommended promo sponsor sponsored ad ads advert adverts advertisement".split())
#: Ends of constructs, with the starts that nothing ends behind the last of them.
_CLOSED_BY = ((re.compile(r"--!?>"), "<!--"), (re.compile(r"\]>"), "<!["))
_TAG_START = re.compile(r"<[a-zA-Z/!?]")
#: Characters per tag from which a line counts as prose.
_PROSE = 20
_LISTS = frozenset({"table", "ul", "ol", "dl"})
#: Open elements that the start of a tag ends, by that tag.
_ENDED_BY: dict[str, list[str]] = {}
for _ended, _by in _ENDS.items():
    for _tag in _by:
        _ENDED_BY.setdefault(_tag, []).append(_ended)


def marked_name(names: str, marks: frozenset[str]) -> bool:
    """Whether one of the names, split at hyphens and underscores, has a word of ``marks`` and otherwise only words that stand beside them."""
    for name in names.lower().split():
        words = [w for w in re.split("[_-]+", name) if w]
        if any(w in marks for w in words) and all(w in marks or w in _BESIDE or w.isdigit() for w in words):
            return True
    return False


def closed(html: str) -> str:
    """The page without starts of comments, sections and tags that nothing ends: the parser would look for each one's end anew."""
    for end, start in _CLOSED_BY:
        last = max((m.end() for m in end.finditer(html)), default=0)
        html = html[:last] + html[last:].replace(start, "")
    last = html.rfind(">") + 1
    return html[:last] + _TAG_START.split(html[last:], maxsplit=1)[0]


@dataclass
class Line:
    """A block's text, with its tags, how much of it is in links, and the innermost container and innermost marked element around it (-1: none)."""

    text: str
    tags: int
    linked: int
    inside: int
    skipped: bool
    mark: int = -1

    @property
    def ratio(self) -> float:
        """Characters outside of links per tag."""
        return 0.0 if self.skipped else max(0, len(self.text) - self.linked) / max(1, self.tags)

    @property
    def mostly_links(self) -> bool:
        return 2 * self.linked > len(self.text)


class _Lines(HTMLParser):
    """Parser events gathered into lines: one for each block, its white space collapsed.

    Places of open elements are kept by tag and by kind, so that each event
    takes the same time however deeply elements are nested.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        #: Of every container: the one around it, and the outermost article or main element that it is in (-1: none).
        self.parents: list[int] = []
        self.mains: list[int] = []
        self.open: list[str] = []
        self.at: dict[str, list[int]] = {}  # places in ``open`` by tag; by kind under "#..."
        self.containers: list[int] = []
        #: Of every element that its names mark: the one around it; and those that are open.
        self.mark_parents: list[int] = []
        self.marks: list[int] = []
        self.parts: list[str] = []
        self.tags = self.linked = 0

    def _places(self, key: str) -> list[int]:
        return self.at.setdefault(key, [])

    def _last(self, key: str) -> int:
        places = self.at.get(key)
        return places[-1] if places else -1

    def _end_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append(Line(text, self.tags, self.linked, self.containers[-1] if self.containers else -1, self._last("#skips") >= 0, self.marks[-1] if self.marks else -1))
        self.parts, self.tags, self.linked = [], 0, 0

    def _pop_to(self, depth: int) -> None:
        if self._last("#block") >= depth:
            self._end_line()
        while len(self.open) > depth:
            self._places(self.open.pop()).pop()
        for kind in ("#block", "#barrier", "#skips", "#unread"):
            places = self._places(kind)
            while places and places[-1] >= depth:
                places.pop()
        places = self._places("#container")
        while places and places[-1] >= depth:
            places.pop()
            self.containers.pop()
        places = self._places("#marked")
        while places and places[-1] >= depth:
            places.pop()
            self.marks.pop()

    def _end_head(self) -> None:
        if self._places("head"):
            self._pop_to(self.at["head"][0])

    def _marked(self, tag: str, attrs: dict[str, str]) -> bool:
        if tag in ("html", "body"):
            return False
        names = " ".join(attrs.get(k) or "" for k in ("class", "id", "role", "aria-label"))
        return tag == "form" or (marked_name(names, _NOT_THE_MAIN) if tag in _MAIN else marked_name(names, _MARKS) or bool(_PAGE_HEADER.search(names)))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "body" or tag not in _IN_HEAD and self.open and self.open[-1] == "head":
            self._end_head()
        self.tags += 1
        ended = max((self._last(t) for t in _ENDED_BY.get(tag, ())), default=-1)
        if ended >= 0 and ended >= self._last("#barrier"):
            self._pop_to(ended)
        given = {k: v or "" for k, v in attrs}
        hidden = "hidden" in given or given.get("aria-hidden") == "true" or bool(_HIDDEN.search(given.get("style", "")))
        marked = self._marked(tag, given)
        if tag in _MAIN and not marked and not hidden and self._places("#skips"):  # an element that was never closed doesn't swallow the article
            bad = self.at["#skips"][0]
            if self.open[bad] not in _MAIN:
                self._pop_to(bad)
        if tag in _BLOCKS:
            self._end_line()
            self.tags = 1
        if tag in _VOID:
            if tag in ("br", "hr", "wbr"):
                self.parts.append("" if tag == "wbr" else " ")
            return
        around = self.containers[-1] if self.containers else -1
        in_main = around >= 0 and self.mains[around] >= 0
        place = len(self.open)
        if tag in _CONTAINERS:
            number = len(self.parents)
            self.parents.append(around)
            is_main = tag in _MAIN or given.get("role") == "main" or given.get("itemprop") == "articleBody"
            self.mains.append(self.mains[around] if in_main else number if is_main else -1)
            self.containers.append(number)
            self._places("#container").append(place)
        self.open.append(tag)
        self._places(tag).append(place)
        if marked:
            number = len(self.mark_parents)
            self.mark_parents.append(self.marks[-1] if self.marks else -1)
            self.marks.append(number)
            self._places("#marked").append(place)
        for kind, is_one in (
            ("#block", tag in _BLOCKS),
            ("#barrier", tag in _CONTAINERS or tag in _LISTS),
            ("#skips", tag in _BOILERPLATE or tag == "header" and not in_main or hidden),
            ("#unread", tag in _UNREAD),
        ):
            if is_one:
                self._places(kind).append(place)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        place = self._last(tag)
        if place >= 0 and (tag in _BLOCKS or self._last("#block") <= place):
            self._pop_to(place)

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1] == "head" and data.strip():
            self._end_head()
        if self._last("#unread") >= 0:
            return
        self.parts.append(data)
        if self._last("a") >= 0:
            self.linked += len(data)

    def close(self) -> None:
        super().close()
        self._pop_to(0)
        self._end_line()


def without_marked(lines: list[Line], parents: list[int]) -> None:
    """Skips the lines in elements that their names mark, but for elements that hold half of the page's text outside links or more, in lines of prose (by their ratio) for the most part.

    A name is a guess: what holds most of a page isn't beside its article.
    Elements in such a one are judged by themselves.
    """
    if not parents:
        return
    weight, prose, page = np.zeros(len(parents) + 1), np.zeros(len(parents) + 1), 0
    for line in lines:
        if not line.skipped:
            own = max(0, len(line.text) - line.linked)
            weight[line.mark] += own
            prose[line.mark] += own if line.ratio >= _PROSE else 0
            page += own
    weight[-1] = prose[-1] = 0
    for i in range(len(parents) - 1, -1, -1):
        weight[parents[i]] += weight[i]
        prose[parents[i]] += prose[i]
    gone = np.zeros(len(parents) + 1, bool)
    for i, parent in enumerate(parents):
        gone[i] = gone[parent] and parent >= 0 or not page or 2 * weight[i] < page or 2 * prose[i] < weight[i]
    for line in lines:
        line.skipped |= line.mark >= 0 and bool(gone[line.mark])


def smoothed(ratios: np.ndarray, radius: int = 2, sigma: float = 1.0) -> np.ndarray:
    """Gaussian smoothing; at the ends, the weights of what is there."""
    kernel = np.exp(-(np.arange(-radius, radius + 1) ** 2) / (2 * sigma**2))
    weights = np.convolve(np.ones(len(ratios)), kernel, "full")[radius : radius + len(ratios)]
    return np.convolve(ratios, kernel, "full")[radius : radius + len(ratios)] / weights


def content_lines(lines: list[Line]) -> np.ndarray:
    """Which lines the threshold takes for content: those whose smoothed text-to-tag ratio is at least its standard deviation over the page, or its mean if that is less."""
    ratio = np.array([x.ratio for x in lines])
    free = np.array([not x.skipped for x in lines], bool)
    if not ratio.any():
        return np.zeros(len(lines), bool)
    smooth = smoothed(ratio)
    return (smooth >= min(smooth.std(), smooth.mean())) & free if len(lines) > 1 else free


def menu_lines(lines: list[Line], good: np.ndarray) -> np.ndarray:
    """Lines of clusters of neighbours that are mostly links, where less than half of a cluster is content."""
    linked = np.array([x.mostly_links for x in lines], bool)
    cluster = np.cumsum(np.r_[True, linked[1:] != linked[:-1]]) - 1
    share = np.bincount(cluster, good) / np.bincount(cluster)
    return linked & (share < 0.5)[cluster]


def _weights(lines: list[Line], good: np.ndarray, parents: list[int]) -> np.ndarray:
    """Characters of content lines in each container, nested ones included; in the last place, those of the page."""
    weight = np.zeros(len(parents) + 1)
    for line, ok in zip(lines, good):
        if ok:
            weight[line.inside] += len(line.text)
    for i in range(len(parents) - 1, -1, -1):  # a container's number is above those around it
        weight[parents[i]] += weight[i]
    return weight


def _region(weight: np.ndarray, parents: list[int]) -> int:
    """The innermost container with three quarters of the content around it, at every step inwards; -1: the page."""
    best = np.full(len(weight), -1)
    for i in range(len(parents) - 1, -1, -1):
        if best[parents[i]] < 0 or weight[i] >= weight[best[parents[i]]]:
            best[parents[i]] = i
    region = -1
    while best[region] >= 0 and weight[best[region]] >= 0.75 * weight[region] > 0:
        region = int(best[region])
    return region


def main_text(html: str | None) -> str:
    """The article's blocks, one per line.

    Lines are blocks of the page. Each has a ratio of its text outside links
    to its tags, which is smoothed over its neighbours; lines over the
    threshold are content. What stands in scripts, menus, headers and
    footers has ratio 0, and so have forms and elements whose class or id
    names such things, unless they hold half of the page's text, as prose. The
    content decides the regions: all outermost article or main elements that
    hold some, else the innermost container with three quarters of it, from
    its first to its last content line. In the regions, clusters of lines
    that are mostly links go where less than half of them is content: these
    are menus, whatever their tags. Other lines below the threshold stay, as
    an article has short blocks too.

    Null, empty and damaged pages have what can be read in them, "" if
    nothing. The time grows with the page's length, however nested it is.
    """
    parser = _Lines()
    parser.feed(closed(html or ""))
    parser.close()
    lines, mains = parser.lines, parser.mains
    without_marked(lines, parser.mark_parents)
    if not lines:
        return ""
    good = content_lines(lines)
    main_of = [mains[x.inside] if x.inside >= 0 else -1 for x in lines]
    regions = {m for m, ok in zip(main_of, good) if ok and m >= 0}
    if not good.any():  # nothing but links: an article of these, or nothing
        return "\n".join(x.text for x, m in zip(lines, main_of) if m >= 0 and not x.skipped)
    if regions:
        inside = [i for i, m in enumerate(main_of) if m in regions]
    else:
        region, within = _region(_weights(lines, good, parser.parents), parser.parents), np.zeros(len(mains) + 1, bool)
        within[region] = True
        for i, parent in enumerate(parser.parents):
            within[i] |= within[parent] and (parent >= 0 or region == -1)
        inside = [i for i, x in enumerate(lines) if within[x.inside] and (x.inside >= 0 or region == -1)]
        content = [i for i in inside if good[i]]
        inside = [i for i in inside if content[0] <= i <= content[-1]]
    menu = menu_lines(lines, good)
    return "\n".join(lines[i].text for i in inside if not lines[i].skipped and not menu[i])


def with_main_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """Adds text (empty where there is none) to every row; a column of that name is replaced.

    Whole pages of any length are read, null as empty; repeated rows get equal
    texts; an empty table stays empty. Nothing is shuffled.
    """

    @F.arrow_udf("string")
    def extract(htmls: pa.Array) -> pa.Array:
        return pa.array([main_text(x.as_py()) for x in htmls], pa.string())

    return pages.withColumn("text", extract(F.col(html)))
