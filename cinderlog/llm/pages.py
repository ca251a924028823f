"""Main text of web pages from streaming parser events.

1. The standard library's parser streams a page's events. They become lines: the
   text of one block each, with white space joined, character references decoded,
   and the number of tags met on the way. Scripts, styles, menus, page headers and
   footers, side bars, notices, adverts, forms and reader comments are left out by
   element, role, or words of class and id.
2. A line's ratio is its characters per tag. Ratios are smoothed along the page
   with a Gaussian, and lines at or above the mean of the smoothed ratios are cores.
3. Cores cluster by their containers: the content region is all outermost articles
   (or main elements), or without such the deepest section that holds every core, or
   the whole page. Every line of the region stays, so short lines are not lost. A
   block beside that section without a core line is not part of it.

Rows: null and empty html gives an empty text, so does a page without a line.
Unclosed and stray tags are taken as they come; a comment that never ends hides
the rest. Repeated rows are extracted each for itself; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cinderlog.llm.common import per_batch

SIGMA = 1.5
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre "
    "section summary table tbody td tfoot th thead tr ul".split()
)
HIDDEN = frozenset(
    "aside button canvas datalist dialog fieldset footer form head iframe input label menu nav noscript "
    "object option script select style svg template textarea title".split()
)
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
NAMES = re.compile(
    r"ads?|advert\w*|adsense|aside|banner|breadcrumbs?|comments?|consent|cookies?|disclaimer|disqus|footer|gdpr|"
    r"login|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|pagination|pager|paywall|popup|promo\w*|"
    r"recommend\w*|related|repl(?:y|ies)|respond|search|share|sharing|sidebar|signup|social|sponsor\w*|subscribe|"
    r"toolbar|widget"
)
# words that say nothing of what a part is for: inside an article a class like related-work
# names its subject, so there all other words must be of these
PLAIN = re.compile(
    r"area|articles?|bar|blocks?|body|bottom|box|buttons?|cards?|container|content|count|entry|feed|group|holder|"
    r"icons?|inner|items?|left|links?|list|main|module|news|outer|panel|posts?|primary|readers?|right|row|section|"
    r"site|stories|strip|text|thread|title|top|tools?|unit|users?|wrap(?:per)?|[0-9]+"
)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
CLOSES = {  # a start tag that ends an open element of these names
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"},
}
REGIONS = frozenset(("article", "main"))
SECTIONS = frozenset("body html div section td main article".split())


class Boxes:
    """The containers of a page, each with its name and the container around it (-1: none).
    One that lies in another has the higher number."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.around: list[int] = []
        self.region: list[int] = []  # the outermost article or main it lies in, or is

    def add(self, name: str, around: int) -> int:
        box = len(self.names)
        outer = self.region[around] if around >= 0 else -1
        self.names.append(name)
        self.around.append(around)
        self.region.append(outer if outer >= 0 else box if name in REGIONS else -1)
        return box


class Lines(HTMLParser):
    """Collects (text, tags, container) of each block outside hidden parts.

    Every step takes the same time however many tags are open.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, int]] = []  # name, hidden, innermost container
        self.n_open: Counter[str] = Counter()
        self.regions = 0  # open articles and mains
        self.unseen = 0
        self.boxes = Boxes()
        self.text: list[str] = []
        self.tags = 0
        self.lines: list[tuple[str, int, int]] = []

    @property
    def box(self) -> int:
        return self.open[-1][2] if self.open else -1

    def line_end(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.lines.append((text, self.tags, self.box))
            self.tags = 0
        self.text = []

    def hides(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if tag in HIDDEN:
            return True
        if tag == "header" and not self.regions:
            return True
        if tag in ("body", "html"):
            return False
        for name, value in attrs:
            value = value or ""
            if name in ("class", "id"):
                if any(self.names_aside(word) for word in value.split()):
                    return True
            elif name == "role":
                if value.strip().lower() in ROLES:
                    return True
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                return True
            elif name == "style" and UNSEEN.search(value):
                return True
        return False

    def names_aside(self, word: str) -> bool:
        """Whether a class or id names a menu, an advert, a notice or the like."""
        parts = [w.lower() for w in PART.findall(word)]
        if not any(map(NAMES.fullmatch, parts)):
            return False
        return not self.regions or all(NAMES.fullmatch(w) or PLAIN.fullmatch(w) for w in parts)

    def pop(self) -> None:
        name, hidden, _ = self.open.pop()
        self.n_open[name] -= 1
        self.regions -= name in REGIONS
        self.unseen -= hidden

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS or tag in HIDDEN:
            self.line_end()
            # a block ends an open paragraph, and items end their like
            ends = CLOSES.get(tag, set()) | ({"p"} if tag in BLOCKS else set())
            while self.open and (self.open[-1][0] in ends or self.open[-1][0] not in BLOCKS | HIDDEN and any(
                name in ends for name, *_ in self.open[-4:]
            )):
                self.pop()
        elif tag == "br":
            self.text.append(" ")
        self.tags += 1
        if tag in REGIONS and self.unseen and not self.hides(tag, attrs):
            # an unclosed menu or notice does not swallow the article
            while self.unseen and not self.regions:
                self.pop()
        if tag in VOID:
            return
        hidden = self.hides(tag, attrs)
        self.unseen += hidden
        box = self.boxes.add(tag, self.box) if tag in BLOCKS else self.box
        self.open.append((tag, hidden, box))
        self.n_open[tag] += 1
        self.regions += tag in REGIONS

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS or tag in HIDDEN:
            self.line_end()
        self.tags += 1
        if self.n_open[tag]:
            while self.open[-1][0] != tag:
                self.pop()
            self.pop()

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def parse_comment(self, i: int, report: bool = True) -> int:
        """An unclosed comment, which the parser would give as text, ends the page: it is fed whole."""
        end = super().parse_comment(i, report)
        return end if end >= 0 else len(self.rawdata)

    def handle_data(self, data: str) -> None:
        if not self.unseen:
            self.text.append(data)


def lines_of(html: str) -> tuple[list[tuple[str, int, int]], Boxes]:
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.line_end()
    return parser.lines, parser.boxes


def smoothed(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; beyond the ends stands the last value."""
    reach = max(1, math.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(values, reach, mode="edge"), kernel / kernel.sum(), mode="valid")


def content(lines: list[tuple[str, int, int]], boxes: Boxes) -> list[str]:
    """The texts of the content region's lines."""
    if not lines:
        return []
    size = np.array([len(text) for text, *_ in lines], float)
    ratio = smoothed(size / np.maximum(1, [tags for _, tags, _ in lines]))
    core = ratio >= ratio.mean() - 1e-9
    region = [boxes.region[box] if box >= 0 else -1 for _, _, box in lines]
    if max(region) >= 0:
        return [text for (text, *_), r in zip(lines, region) if r >= 0]
    shared = holds_all(boxes, [lines[k][2] for k in np.flatnonzero(core)])
    # a single long paragraph is not the region, its section is
    while shared >= 0 and boxes.names[shared] not in SECTIONS:
        shared = boxes.around[shared]
    if shared < 0:
        return [text for text, *_ in lines]
    inside = [False] * len(boxes.names)
    for box, around in enumerate(boxes.around):
        inside[box] = box == shared or around >= 0 and inside[around]
    return [text for text, _, box in lines if box >= 0 and inside[box]]


def holds_all(boxes: Boxes, cores: list[int]) -> int:
    """The innermost container of all the given ones, -1 without one."""
    held = [0] * len(boxes.names)
    for box in cores:
        if box >= 0:
            held[box] += 1
    for box in range(len(held) - 1, -1, -1):  # what lies inside comes first
        if held[box] == len(cores):
            return box
        if boxes.around[box] >= 0:
            held[boxes.around[box]] += held[box]
    return -1


def main_text(html: str | None) -> str:
    return "\n\n".join(content(*lines_of(html))) if html else ""


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page, from the whole html."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(html.as_py()) for html in batch.column(2)]
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0).cast(pa.int64()), batch.column(1), pa.array(texts, pa.string()),
                pa.array(map(len, texts), pa.int64()),
            ],
            ["page_id", "url", "text", "n_chars"],
        )

    return per_batch(
        pages.select("page_id", "url", "html"), step, "page_id long, url string, text string, n_chars long"
    )
