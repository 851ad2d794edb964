"""Main text of HTML pages by text-to-tag ratio.

The standard library's parser streams a page's events.  They are gathered
into lines, one for each block of text, with the number of characters of text
and of tags that the block took.  A line's ratio is its text by its tags.
The logarithms of the whole page's ratios are smoothed by a Gaussian and
clustered by a threshold, on every page; runs of lines above it make regions of
content.  What the markup itself names as no article (navigation, forms,
asides, scripts, elements whose class or id says advert, comments, cookies and
so on) makes boundaries and is never part of a region; its tags count for no
line.  A region is selected by its weight against the heaviest one's.  Markup
that names the article makes boundaries and doubles a region's weight; it
neither selects lines nor keeps any below the threshold.

Null, empty and text-free pages give an empty text; a page without block tags
is one line; unclosed and misplaced tags end with the block that holds them;
repeated pages are extracted each; further columns pass by unread.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, strings

#: Elements whose content is no text of a page.
SILENT = frozenset("script style noscript template svg math iframe object embed canvas audio video map head title select option datalist button textarea".split())
#: Elements that are no part of an article.
ASIDE = frozenset("nav footer aside form menu dialog fieldset".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
#: A start tag of the key closes an open element of the values, up to the nearest of their parents.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("ul ol dl table tbody thead tfoot article section div main body html".split())
#: Words of class, id or role that mark what an article isn't.
BOILER = re.compile(
    r"(?:^|[\s_-])(?:ads?|adv|advert\w*|adsense|banner|sponsor\w*|promo\w*|comments?|comment\w*|disqus|replies|reply|respond|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscri\w+|signup|login|sidebar\w*|side|widget\w*|menu\w*|nav|navbar|navigation|breadcrumbs?|toolbar|topbar|footer\w*|header|masthead|site-header|social\w*|share\w*|sharing|related\w*|recommend\w*|pager|pagination|tags?|skip\w*|hidden|copyright|legal|search|contentinfo|complementary|dialog)(?:$|[\s_-])",
    re.I,
)
ARTICLE = re.compile(r"(?:^|[\s_-])(?:article\w*|articlebody|post-?(?:content|body)|entry-?content|main-?content|story-?body)(?:$|[\s_-])", re.I)
SPACE = re.compile(r"\s+")
#: Width of the Gaussian in lines, and the share of the mean (of logarithms of ratios) at which a line counts as content.
SIGMA, SHARE = 1.0, 0.6
#: Share of the heaviest region's weight at which a region is selected, and what the article's markup multiplies a weight by.
LEAST, NAMED = 0.2, 2.0


class Lines(HTMLParser):
    """Lines of a page: text, characters of tags, run (grows at every boundary), and whether an article holds them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, bool]] = []
        self.open: list[tuple[str, int, int]] = []  # element, and how much it adds to silence and to article
        self.opened: Counter[str] = Counter()  # open elements by tag
        self.silent = self.article = self.run = self.tags = 0
        self.held: list[str] = []

    def _end_line(self) -> None:
        if self.held:
            text = SPACE.sub(" ", "".join(self.held)).strip()
            self.held = []
            if text:
                self.lines.append((text, self.tags, self.run, self.article > 0))
                self.tags = 0

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag in VOID:
            if tag == "br" and not self.silent:
                self.held.append(" ")
            elif tag == "hr":
                self._end_line()
            return
        if tag in BLOCK:
            self._end_line()
            if tag == "body":  # whatever was left open in the head
                while self.open and self.open[-1][0] != "html":
                    self._close()
            elif tag == "p" or tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
                self._imply(("p",))
        if tag in CLOSES:
            self._imply(CLOSES[tag])
        marks = " ".join(v for k, v in attrs if v and k in ("class", "id", "role", "aria-label"))
        hidden = any(k == "hidden" or k == "style" and v and "display:none" in v.replace(" ", "") for k, v in attrs)
        article = tag in ("article", "main") or bool(marks) and tag in ("div", "section", "td") and bool(ARTICLE.search(marks))
        quiet = tag in SILENT or tag in ASIDE or hidden or tag == "header" and not self.article or bool(marks) and tag not in ("html", "body", "article", "main") and not article and bool(BOILER.search(marks))
        if quiet and not self.silent:
            self._end_line()
            self.run += not self.article  # what an article leaves out doesn't cut it in two
        if article and not self.article:
            self._end_line()
            self.run += 1
        self.open.append((tag, int(quiet), int(article)))
        self.opened[tag] += 1
        self.silent += quiet
        self.article += article

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _imply(self, closed: tuple[str, ...]) -> None:
        if not any(self.opened[tag] for tag in closed):
            return
        for k in range(len(self.open) - 1, -1, -1):
            tag = self.open[k][0]
            if tag in closed:
                while len(self.open) > k:
                    self._close()
                return
            if tag in SCOPE or tag in ASIDE or tag in SILENT:
                return

    def _close(self) -> None:
        tag, quiet, article = self.open.pop()
        self.opened[tag] -= 1
        if tag in BLOCK or quiet or article:
            self._end_line()
        self.silent -= quiet
        self.article -= article
        if quiet and not self.silent:
            self.tags = 0
        if (quiet and not self.silent or article) and not self.article:
            self.run += 1

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in BLOCK:
            self._end_line()
        if not self.opened[tag]:
            return
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                while len(self.open) > k:
                    self._close()
                return
            if tag not in BLOCK and self.open[k][0] in SCOPE:  # an inline end tag closes nothing beyond its block
                return

    def handle_data(self, data):
        if not self.silent:
            self.held.append(data)

    def finish(self) -> list[tuple[str, int, int, bool]]:
        self.close()
        self._end_line()
        return self.lines


def smooth(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Convolution with a normalised Gaussian; at the edges with as much of it as there is."""
    reach = max(1, round(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    full = lambda x: np.convolve(x, kernel)[reach : reach + len(x)]
    return full(values) / full(np.ones(len(values)))


def main_text(html: str) -> str:
    """The selected lines of a page, joined by newlines."""
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    lines = parser.finish()
    if not lines:
        return ""
    run = np.asarray([x[2] for x in lines])
    inside = np.asarray([x[3] for x in lines])
    ratio = np.log1p(np.asarray([len(x[0]) for x in lines]) / np.maximum(1, np.asarray([x[1] for x in lines])))
    smoothed = smooth(ratio)
    bar = SHARE * smoothed.mean()
    smoothed *= np.where(inside, NAMED, 1.0)
    content = smoothed >= bar
    opens = content & ~(np.concatenate([[False], content[:-1]]) & (run == np.concatenate([[-1], run[:-1]])))
    region = np.cumsum(opens) - 1  # of the lines that are content
    weight = np.bincount(region[content], smoothed[content])
    chosen = content & (weight >= LEAST * weight.max(initial=0.0))[region]
    return "\n".join(x[0] for x, c in zip(lines, chosen.tolist(), strict=True) if c)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2):
            if part.num_rows:
                texts = [main_text(x) for x in strings(part.column(2))]
                yield pa.record_batch([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
