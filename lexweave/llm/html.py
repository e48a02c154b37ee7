"""Main-text extraction from whole pages by text-to-tag ratio.

A page is read once as parser events.  Every block element or line break opens a
line; a line has its text, the tags seen while it was built, and its place in the
tree.  The ratio of text to tags per line is smoothed with a Gaussian, and lines
at or above a threshold form the content clusters, but for lines of links.

Clusters decide three things.  Where no element says what the article is, the region
is the deepest container that holds all clusters, without what comes before or after
them in containers of its own.  Where articles are marked, the region is the one that
holds most of the clusters' text.  A class or id name that sounds like furniture is
only a hint: it fails where the clusters lie inside that element.  Of the region's
lines all count, short ones too, save those in page furniture and runs of links under
the threshold.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from math import exp

import pyarrow as pa
from pyspark.sql import DataFrame

from .kernels import released, texts
from .storage import prepare

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html "
    "li main nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINER = frozenset("article blockquote body center div dl figure html main ol section table tbody td tr ul".split())
#: Elements that never hold main text.
FURNITURE = frozenset(
    "head title script style noscript template svg math canvas iframe object embed audio video map nav footer aside form button input select option "
    "textarea label fieldset dialog menu datalist".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert alertdialog dialog status toolbar".split())
#: Words of class and id names that mark furniture.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adbox banner banners sponsor sponsored sponsors promo promos promotion nav navbar "
    "navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside footer foot masthead topbar cookie cookies consent gdpr notice notices notification "
    "alert alerts popup popups modal overlay newsletter subscribe subscription signup share sharing social related recommended recommendations "
    "comment comments commentlist disqus reply replies respond discussion form login search widget widgets toolbar pagination pager copyright skip".split()
)
_HEADER_MARKS = frozenset({"header", "head"})
#: First words of a class name that say what an element has or lacks, not what it is.
_ABOUT = frozenset("has have with without no not is".split())
MENU = 3  #: lines of links in a row that are a menu
_NAME = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
#: A start tag of the key ends open elements of the value, back to the nearest container.
IMPLIED = {
    "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"},
}
#: Containers that are a part of an article and not the place of one.
_PARTS = frozenset("blockquote dl figure ol table tbody tr ul".split())
_SCOPE = frozenset("article main section div body ul ol dl table blockquote".split())


class _Lines(HTMLParser):
    """Turns parser events into lines: (text, tags, container, furniture, hint, whether it is mostly links).

    Containers are numbered from the outside in, hints (elements whose names sound like
    furniture) likewise; 0 is the page, and no hint.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, int, int]] = []  # tag, furniture so far, container, hint
        self.count: dict[str, int] = {}  # of open elements by tag
        self.parents: list[int] = [-1]
        self.kinds: list[str] = [""]
        self.marked: list[bool] = [False]  # whether a container is in an article or the main part
        self.hints: list[int] = [-1]  # the hint around each hint
        self.lines: list[tuple[str, int, int, bool, int, bool]] = []
        self.anchors: list[int] = []  # lines of a first heading
        self.parts: list[str] = []
        self.tags = 0
        self.linked = 0  # characters of the line in links

    def _state(self) -> tuple[bool, int, int]:
        return self.open[-1][1:] if self.open else (False, 0, 0)

    def _line(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            hidden, container, hint = self._state()
            if self.count.get("h1"):
                self.anchors.append(len(self.lines))
            self.lines.append((text, self.tags, container, hidden, hint, 2 * self.linked > len(text)))
            self.tags = 0
        self.parts = []
        self.linked = 0

    def _close(self, at: int) -> None:
        for x in self.open[at:]:
            self.count[x[0]] -= 1
        del self.open[at:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK or tag in FURNITURE:
            self._line()
        self.tags += 1
        if tag in VOID:
            return
        closes = IMPLIED.get(tag, {"p"} if tag in BLOCK else ())
        if any(self.count.get(x) for x in closes):
            for at in range(len(self.open) - 1, -1, -1):
                if self.open[at][0] in closes:
                    self._close(at)
                    break
                if self.open[at][0] in _SCOPE:
                    break
        hidden, container, hint = self._state()
        hidden = hidden or self._is_furniture(tag, attrs, container)
        if not hidden and self._is_hint(tag, attrs, container):
            self.hints.append(hint)
            hint = len(self.hints) - 1
        if tag in CONTAINER:
            self.parents.append(container)
            self.kinds.append(tag)
            self.marked.append(tag in ("article", "main") or self.marked[container])
            container = len(self.kinds) - 1
        self.open.append((tag, hidden, container, hint))
        self.count[tag] = self.count.get(tag, 0) + 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "math", "iframe", "script"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK or tag in FURNITURE:
            self._line()
        self.tags += 1
        if not self.count.get(tag):
            return
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == tag:
                self._close(at)
                break
            if tag not in BLOCK and self.open[at][0] in _SCOPE:
                break  # a stray inline end tag does not end the block around it

    def handle_data(self, data: str) -> None:
        self.parts.append(data)
        if self.count.get("a"):
            self.linked += len(data.strip())

    def finish(self) -> None:
        self.close()
        self._line()

    def _is_furniture(self, tag: str, attrs: list[tuple[str, str | None]], container: int) -> bool:
        """Whether the element itself says that it is no main text."""
        if tag in ("html", "body", "article", "main"):
            return False
        if tag in FURNITURE or (tag == "header" and not self.count.get("article")):
            return True
        for name, value in attrs:
            value = value or ""
            if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "role" and value.strip().lower() in ROLES):
                return True
            if name == "style" and "display:none" in value.replace(" ", "").lower():
                return True
        return False

    def _is_hint(self, tag: str, attrs: list[tuple[str, str | None]], container: int) -> bool:
        """Whether a class or id name sounds like furniture."""
        if tag in ("html", "body", "article", "main"):
            return False
        for name, value in attrs:
            if name in ("class", "id"):
                for one in (value or "").split():
                    names = [x.lower() for x in _NAME.findall(one)]
                    if names and names[0] not in _ABOUT and (not MARKS.isdisjoint(names) or (not _HEADER_MARKS.isdisjoint(names) and not self.count.get("article"))):
                        return True
        return False


def smooth(values: list[float], sigma: float = 1.0, radius: int = 2) -> list[float]:
    """Gaussian mean of each value and its neighbours; weights beyond the ends are left out."""
    weights = [exp(-(d * d) / (2 * sigma * sigma)) for d in range(-radius, radius + 1)]
    out = []
    for i in range(len(values)):
        total = weight = 0.0
        for d, w in zip(range(-radius, radius + 1), weights, strict=True):
            if 0 <= i + d < len(values):
                total += w * values[i + d]
                weight += w
        out.append(total / weight)
    return out


def least_ratio(smoothed: list[float], factor: float = 1.0) -> float:
    """The threshold: ``factor`` standard deviations of the smoothed ratios, or the largest one if none reaches that."""
    mean = sum(smoothed) / len(smoothed)
    return min(factor * (sum((x - mean) ** 2 for x in smoothed) / len(smoothed)) ** 0.5, max(smoothed))


def content_lines(ratios: list[float], sigma: float = 1.0, factor: float = 1.0) -> list[bool]:
    """Lines whose smoothed ratio reaches the threshold."""
    smoothed = smooth(ratios, sigma)
    if not smoothed:
        return []
    least = least_ratio(smoothed, factor)
    return [x >= least for x in smoothed]


def _sums(own: list[int], parents: list[int]) -> list[int]:
    """Each node's value with those of all nodes below it; nodes come after their parents."""
    out = list(own)
    for i in range(len(out) - 1, 0, -1):
        out[parents[i]] += out[i]
    return out


def _ratios(lines: list[tuple], furniture: list[bool]) -> list[float]:
    return [0.0 if hidden else len(x[0]) / max(1, x[1]) for x, hidden in zip(lines, furniture, strict=True)]


def _clusters(lines: list[tuple], furniture: list[bool]) -> list[int]:
    """Lines of the content clusters; furniture has no ratio and is in none."""
    return [i for i, yes in enumerate(content_lines(_ratios(lines, furniture))) if yes and not furniture[i]]


def _furniture(parser: _Lines) -> list[bool]:
    """Which lines are furniture: by their elements, and by hints that the clusters do not refute.

    A hint fails if its element holds four fifths of the clusters' text, made without
    hints, and all of the page's first headings and marked articles.
    """
    lines = parser.lines
    plain = [x[3] for x in lines]
    if len(parser.hints) == 1 or all(plain):
        return plain
    chosen = _clusters(lines, plain)
    inside, anchors = [0] * len(parser.hints), [0] * len(parser.hints)
    for i in chosen:
        inside[lines[i][4]] += len(lines[i][0])
    for i in {*(i for i, x in enumerate(lines) if parser.marked[x[2]]), *parser.anchors}:
        if not plain[i]:
            anchors[lines[i][4]] += 1
    inside, anchors = _sums(inside, parser.hints), _sums(anchors, parser.hints)
    holds = [False] * len(parser.hints)  # whether an element around, or this one, is furniture by its name
    for h in range(1, len(holds)):
        fails = 5 * inside[h] >= 4 * inside[0] and anchors[h] == anchors[0]
        holds[h] = holds[parser.hints[h]] or not fails
    return [hidden or holds[x[4]] for hidden, x in zip(plain, lines, strict=True)]


def extract(page: str) -> str:
    """Main text of one page; empty if it has none."""
    parser = _Lines()
    parser.feed(page)
    parser.finish()
    lines, parents = parser.lines, parser.parents
    furniture = _furniture(parser)
    shown = [i for i, hidden in enumerate(furniture) if not hidden]
    if not shown:
        return ""
    clusters = _clusters(lines, furniture)
    chosen = [i for i in clusters if not lines[i][5]] or clusters or shown
    marked = [i for i in shown if parser.marked[lines[i][2]]]
    if marked:
        chosen = [i for i in chosen if parser.marked[lines[i][2]]] or marked
    own = [0] * len(parents)
    for i in chosen:
        own[lines[i][2]] += len(lines[i][0])
    held = _sums(own, parents)
    last = list(range(len(parents)))  # of the containers below each, which are numbered in a row
    for c in range(len(parents) - 1, 0, -1):
        last[parents[c]] = max(last[parents[c]], last[c])
    most = held[0]
    region = max(c for c, n in enumerate(held) if (2 * n > most if marked else n == most))
    if marked:
        while region > 0 and parser.kinds[region] not in ("article", "main"):
            region = parents[region]
        kept = [i for i in marked if region <= lines[i][2] <= last[region]]
    else:
        while parser.kinds[region] in _PARTS:
            region = parents[region]
        child = [0] * len(parents)  # the container right in the region that each lies in, or the region
        for c in range(region, last[region] + 1):
            child[c] = c if c == region or parents[c] == region else child[parents[c]]
        mine = {region, *(child[lines[i][2]] for i in chosen)}
        kept = [i for i in shown if region <= lines[i][2] <= last[region] and (chosen[0] <= i <= chosen[-1] or child[lines[i][2]] in mine)]
    ratios = _ratios(lines, furniture)
    least = least_ratio(smooth(ratios))
    return " ".join(lines[i][0] for i in _without_menus(kept, [x[5] and r < least for x, r in zip(lines, ratios, strict=True)]))


def _without_menus(kept: list[int], links: list[bool]) -> list[int]:
    """Lines without runs of MENU or more lines of links whose own ratio is under the threshold, unless nothing else is left."""
    out: list[int] = []
    run: list[int] = []
    for i in [*kept, -1]:
        if i >= 0 and links[i]:
            run.append(i)
            continue
        if len(run) < MENU or len(run) == len(kept):
            out += run
        run = []
        if i >= 0:
            out.append(i)
    return out


def extract_pages(df: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """(key, url, text, n_chars) of every whole page.

    Null and empty pages, and pages of furniture alone, have an empty text.
    Repeated rows are read each; an empty table gives no rows; other columns are
    left out.
    """
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in texts(batch.column(2)):
                found = [extract(x.decode()) for x in part]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i).slice(first, len(part)) for i in (0, 1)] + [pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())],
                    ["key", "url", "text", "n_chars"],
                )

    kinds = [df.schema[c].dataType.simpleString() for c in (key, url)]
    schema = f"key {kinds[0]}, url {kinds[1]}, text string, n_chars long"
    return df.select(key, url, html).mapInArrow(released(run), schema).withColumnsRenamed({"key": key, "url": url})
