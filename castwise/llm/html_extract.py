"""Main text of web pages from parser events.

The standard-library parser streams events. Block-level tags cut the page into lines; each line has a
text-to-tag ratio (characters of text over tags). The ratios are smoothed with a Gaussian, two clusters split them at a
threshold, and the lines of the upper cluster choose the content region: the innermost container that holds them all. It
is widened to containers around it, up to an article, that add no line of links, and by blocks that stand directly beside it. All
lines of the region are taken, short ones too, but for what stands in menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles or reader comments (known by tag, role or class). Where that leaves nothing of a page, classes and roles do not count.

White space inside a block becomes one blank, blocks are joined by two line feeds. Null, empty and text-free
pages give an empty text. Repeated rows are treated each. Unclosed and stray tags are tolerated. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

SIGMA, RADIUS = 1.0, 3
LINKED = 0.5  # of a line's text in links makes it a line of links

# HTML tag names by role.
CONTAINERS = frozenset("html body div section article main td table center".split())
REGIONS = frozenset(["article", "main"])
LEFT_OUT = frozenset(
    "nav header footer aside form script style noscript template iframe svg canvas object button select textarea "
    "head title menu dialog audio video map".split()
)
BLOCKS = CONTAINERS | frozenset(
    "p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre figure figcaption address hr tr th thead tbody tfoot caption "
    "fieldset legend details summary nav header footer aside form".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Words of class, id and role that name what is no content.
MARKS = frozenset(
    "ad ads adv advert advertisement advertising adsense adslot adbox banner promo promotion promoted sponsor sponsored sidebar "
    "nav navbar navigation menu breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice notices popup modal overlay "
    "newsletter subscribe subscription signup share sharing social related recommended recommendations comment comments reply "
    "replies disqus widget widgets toolbar pagination pager skip contentinfo complementary search alert alertdialog dialog".split()
)
WORD = re.compile(r"[a-z0-9]+")


# First parts of class names that say what goes with an element, not what it is.
BESIDE = frozenset("with has no without is show hide".split())


def _marked(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
    """Whether class, id or role name something other than content."""
    if tag in ("html", "body"):
        return False
    for key, value in attrs:
        if key in ("class", "id", "role"):
            for name in (value or "").lower().split():
                parts = WORD.findall(name)
                if name in ("header", "site-header", "page-header") or (parts and parts[0] not in BESIDE and MARKS.intersection(parts)):
                    return True
    return False


def _hidden(attrs: list[tuple[str, str | None]]) -> bool:
    for key, value in attrs:
        value = (value or "").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", "")):
            return True
    return False


class Lines(HTMLParser):
    """Collects lines: container path, text, tags, share of text in links, whether a class or role marks it as no content."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, bool, int]] = []  # tag, left out, marked, container number
        self.lines: list[tuple[tuple[int, ...], str]] = []
        self.tags: list[int] = []
        self.links: list[float] = []
        self.marked: list[bool] = []
        self.kinds: dict[int, str] = {}
        self.parts: list[str] = []
        self.n_tags = self.in_links = self.linked = 0

    def _path(self) -> tuple[int, ...]:
        return tuple(number for *_, number in self.open if number)

    def _out(self) -> bool:
        return bool(self.open) and self.open[-1][1]

    def cut(self) -> None:
        raw = "".join(self.parts)
        text = " ".join(raw.split())
        self.parts = []
        if text and not self._out():
            self.lines.append((self._path(), text))
            self.tags.append(self.n_tags)
            self.links.append(self.linked / len(raw))
            self.marked.append(bool(self.open) and self.open[-1][2])
        self.n_tags = self.linked = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS or tag in LEFT_OUT:
            self.cut()
        self.n_tags += 1
        if tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        self.in_links += tag == "a"
        left_out, marked = tag in LEFT_OUT or _hidden(attrs), _marked(tag, attrs)
        if tag in BLOCKS or left_out or marked:
            if left_out or marked:
                self.cut()
            if tag in ("p", "li", "td", "tr", "dt", "dd") and self.open and self.open[-1][0] == tag:
                self.open.pop()  # these end where the next one begins
            number = 0
            if tag in CONTAINERS:
                number = len(self.kinds) + 1
                self.kinds[number] = tag
            around = bool(self.open) and self.open[-1][2]
            self.open.append((tag, self._out() or left_out, around or marked, number))

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS or any(t == tag for t, *_ in self.open):
            self.cut()
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                break
        self.n_tags += 1
        if tag == "a":
            self.in_links = max(self.in_links - 1, 0)

    def handle_data(self, data: str) -> None:
        if not self._out():
            self.parts.append(data)
            self.linked += len(data) if self.in_links else 0


def smoothed(values: list[float]) -> list[float]:
    weights = [math.exp(-(d * d) / (2 * SIGMA * SIGMA)) for d in range(-RADIUS, RADIUS + 1)]
    out = []
    for i in range(len(values)):
        near = [(w, values[i + d]) for d, w in zip(range(-RADIUS, RADIUS + 1), weights) if 0 <= i + d < len(values)]
        out.append(sum(w * v for w, v in near) / sum(w for w, _ in near))
    return out


def threshold(values: list[float]) -> float:
    """The middle between the means of two clusters on a line."""
    low, high = min(values), max(values)
    while True:
        mid = (low + high) / 2
        below, above = [v for v in values if v <= mid], [v for v in values if v > mid]
        if not above:
            return low
        a, b = sum(below) / len(below), sum(above) / len(above)
        if (a, b) == (low, high) or abs(a - low) + abs(b - high) < 1e-9:
            return (a + b) / 2
        low, high = a, b


def upper_lines(ratios: list[float]) -> list[bool]:
    """Lines of the upper of two clusters of smoothed ratios."""
    smooth = smoothed(ratios)
    least = threshold(smooth)
    return [r >= least for r in smooth]


def main_text(html: str | None) -> str:
    """The text of the content region of one page."""
    page = Lines()
    page.feed(html or "")
    page.close()
    page.cut()
    usable = [k for k in range(len(page.lines)) if not page.marked[k]] or list(range(len(page.lines)))
    if not usable:
        return ""
    lines = [page.lines[k] for k in usable]
    links = [page.links[k] > LINKED for k in usable]
    upper = upper_lines([len(page.lines[k][1]) / max(page.tags[k], 1) for k in usable])
    # the containers around all lines of the upper cluster, the innermost last
    around = list(lines[upper.index(True)][0])
    for (path, _), up in zip(lines, upper):
        if up:
            around = [n for n in around if n in path]
    inside = _within(lines, around)
    while len(around) > 1 and page.kinds[around[-1]] not in REGIONS and page.kinds[around[-2]] not in ("html", "body"):
        wider = _within(lines, around[:-1])
        if any(links[k] for k in wider - inside):
            break
        around, inside = around[:-1], wider
    first, last, outer = min(inside), max(inside), set(around)
    beside = lambda k: 0 <= k < len(lines) and not links[k] and set(lines[k][0]) < outer
    while page.kinds.get(around[-1] if around else 0) not in REGIONS and beside(first - 1):
        first -= 1
    while page.kinds.get(around[-1] if around else 0) not in REGIONS and beside(last + 1):
        last += 1
    grown = sorted(inside | set(range(first, min(inside))) | set(range(max(inside) + 1, last + 1)))
    return "\n\n".join(lines[k][1] for k in grown)


def _within(lines: list[tuple[tuple[int, ...], str]], around: list[int]) -> set[int]:
    """Lines inside the last of the containers; all without any."""
    return {k for k, (path, _) in enumerate(lines) if not around or around[-1] in path}


def _extract(batches):
    for batch in batches:
        texts = [main_text(page.as_py()) for page in batch.column(2)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )


def main_texts(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages`` (``page_id, url, html``)."""
    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInArrow(
        _extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long"
    )
