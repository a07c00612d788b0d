"""Main text of web pages.

The standard library's streaming parser turns a page into lines, one for each block of text, with the tags seen
on the way. Each line has a text-to-tag ratio, in which what the markup says counts as text or tags that are not
there: a line in a menu, header, footer, aside, form, notice, advert or reader comment, by element, role or the
words of class and id, counts as many tags more as the page has characters; where the page marks its article, so
does a line outside of it, and a line inside counts as many characters more. The logarithms of the ratios are
smoothed with a Gaussian along the lines of either kind and split into two clusters by a threshold, with the line
of as many tags as characters as one more value. A region is content if it holds a line of the upper cluster; a
marked article is one region, so its short, linked or tag-heavy passages stay. Pages that mark no article have a
region for each container, and what is left of them is split once more by the plain ratio and the share of links.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import small_batches, spread

SIGMA = 1.5
#: Fixed lists of HTML element names, by their role here.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: No text that a reader sees, whatever its place.
SILENT = set("head title script style noscript template select textarea option iframe svg canvas object audio video map".split())
LEFT_OUT = set("nav header footer aside form button dialog menu".split())
BLOCKS = set(
    "address article blockquote body br caption center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = set("article body div main section td".split())
INLINE = set("a abbr b bdi bdo big cite code data del dfn em font i ins kbd mark q ruby s samp small span strike strong sub sup time tt u var".split())
LEFT_OUT_ROLES = set("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())
LEFT_OUT_WORDS = set(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs"
    " sidebar side aside footer header masthead topbar toolbar cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login"
    " share sharing social related recommended recommendations comment comments respond reply replies discussion disqus pagination pager widget widgets copyright legal disclaimer skip search form".split()
)
#: Words that name a layout; a heading or paragraph of that name is still part of the text.
LAYOUT_WORDS = set("banner nav navbar navigation side sidebar aside footer header masthead topbar toolbar skip search form widget".split())
#: Parts of a class name that say nothing of its element's role.
NEUTRAL_WORDS = set("area bar block box container inner item items link links list outer section slot unit wrap wrapper".split())
_words = re.compile(r"[a-z]+")


class Lines(HTMLParser):
    """Collects (text, tags, container, in article, link share, left out) for every block of text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, bool, float, bool]] = []
        self.open: list[tuple[str, bool, bool, int]] = [("", False, False, 0)]  # tag, left out, in article, container
        self.parts: list[str] = []
        self.others: list[str] = []  # what is left out of the same block
        self.linked = self.tags = self.links = self.silent = self.containers = 0
        self.places = (False, 0)
        self.marked = False

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """A declaration with a name the parser gives up on ends at its bracket."""
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:
            return self.rawdata.find(">", i + 3) + 1 or -1

    def end_line(self) -> None:
        article, container = self.places
        for parts, out in ((self.parts, False), (self.others, True)):
            text = " ".join("".join(parts).split())
            if text:
                self.lines.append((text, self.tags, container, article, 0.0 if out else min(1.0, self.linked / len(text)), out))
                self.tags = 0
        self.parts, self.others, self.linked = [], [], 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        inline = tag == "button" and any(x[0] == "p" for x in self.open[-6:])  # a word of a sentence
        if tag in BLOCKS or tag in LEFT_OUT and not inline:
            self.end_line()
        if tag in VOID:
            return
        if self.silent and (tag == "body" or tag in BLOCKS and tag != "html") and any(x[0] == "head" for x in self.open):  # never closed
            self.closed(next(k for k, x in enumerate(self.open) if x[0] == "head"))
        if tag == "p" or tag == "li":
            self.close_implied(tag)
        found = dict(attrs)
        _, out, article, container = self.open[-1]
        first = tag == "main" or tag == "article" and not self.marked
        named = self.named_out(tag, found)
        if first and not self.hidden(found) and (tag == "main" or not (named and out)):  # class words do not leave out the page's own article
            named = False
        if tag in ("article", "main") and not named:
            while len(self.open) > 1 and self.open[-1][0] in ("nav", "header", "p", "ul", "li", "a", "b"):  # never closed
                self.closed(len(self.open) - 1)
            _, out, article, container = self.open[-1]
            if first and out and all(x[0] not in LEFT_OUT for x in self.open):
                out = False
            article = article or not out
            self.marked = self.marked or article
        out = out or tag in LEFT_OUT and not inline or tag not in ("body", "html") and named
        if tag in CONTAINERS:
            self.containers += 1
            container = self.containers
        if tag == "a":
            self.links += 1
        if tag in SILENT:
            self.silent += 1
        self.open.append((tag, out, article, container))

    @staticmethod
    def hidden(attrs: dict) -> bool:
        """Whether role or visibility say that this is not main text."""
        role = (attrs.get("role") or "").lower()
        if role in LEFT_OUT_ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true":
            return True
        return "display:none" in (attrs.get("style") or "").replace(" ", "").lower()

    @classmethod
    def named_out(cls, tag: str, attrs: dict) -> bool:
        """Whether role, visibility, class or id say that this is not main text; a name counts by all its parts."""
        if not attrs:
            return False
        if cls.hidden(attrs):
            return True
        role = (attrs.get("role") or "").lower()
        if tag in HEADINGS or role in ("main", "article") or attrs.get("itemprop") == "articleBody":
            return False
        telling = LEFT_OUT_WORDS - LAYOUT_WORDS if tag == "p" or tag in INLINE else LEFT_OUT_WORDS
        names = [set(_words.findall(x)) for x in f"{attrs.get('class') or ''} {attrs.get('id') or ''}".lower().split()]
        return any(x & telling and x <= telling | NEUTRAL_WORDS for x in names)

    def close_implied(self, tag: str) -> None:
        """An open paragraph ends where the next begins; so does a list item of the same list."""
        for k in range(len(self.open) - 1, 0, -1):
            at = self.open[k][0]
            if at == tag:
                self.closed(k)
                return
            if at not in INLINE and at != "p":
                return

    def closed(self, k: int) -> None:
        """Forget the open elements from the k-th on."""
        for x in self.open[k:]:
            self.links -= x[0] == "a"
            self.silent -= x[0] in SILENT
        del self.open[k:]

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.end_line()

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS or tag in LEFT_OUT and not (tag == "button" and any(x[0] == "p" for x in self.open[-7:])):
            self.end_line()
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] == tag:
                self.closed(k)
                return
            if self.open[k][0] in ("article", "main", "td", "body") and tag in INLINE:
                return

    def handle_data(self, data: str) -> None:
        if self.silent > 0:
            return
        _, out, article, container = self.open[-1]
        if out:
            if not self.parts:
                self.places = (article, container)
            self.others.append(data)
            return
        self.parts.append(data)
        self.places = (article, container)
        if self.links > 0 and any(x[0] == "a" for x in self.open[-6:]):
            self.linked += len(data)

    def close(self) -> None:
        super().close()
        self.end_line()


def smooth(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing along the lines; at the ends the kernel is cut and normalised."""
    reach = max(1, math.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    full = np.convolve(values, kernel)[reach : reach + len(values)]
    return full / np.convolve(np.ones(len(values)), kernel)[reach : reach + len(values)]


def threshold(values: np.ndarray) -> float:
    """Between two clusters of the values (two means, from the extremes); the least value where they are alike."""
    low, high = float(values.min()), float(values.max())
    if high <= 2 * low:
        return low
    for _ in range(20):
        cut = (low + high) / 2
        below, above = values[values < cut], values[values >= cut]
        if not len(below) or not len(above) or (below.mean(), above.mean()) == (low, high):
            break
        low, high = float(below.mean()), float(above.mean())
    return (low + high) / 2


def upper_cluster(lines: list[tuple[str, int, int, bool, float, bool]]) -> list[tuple]:
    """The lines of the regions whose smoothed ratio, with what the markup says, is in the upper cluster."""
    marked = any(x[3] and not x[5] for x in lines)
    total = sum(len(x[0]) for x in lines)
    out = np.array([x[5] or marked and not x[3] for x in lines])
    chars, tags = np.array([len(x[0]) for x in lines]), np.maximum(1, [x[1] for x in lines])
    ratios = np.log(np.where(out, chars / (tags + total), 1 + (chars + total * marked) / tags))
    for kind in (out, ~out):
        if kind.any():
            ratios[kind] = smooth(ratios[kind])
    cut = max(threshold(np.r_[0.0, ratios]), 0.0)
    region = [(x[2] if o or not marked else -1, bool(o)) for x, o in zip(lines, out, strict=True)]
    kept = {c for c, r in zip(region, ratios.tolist(), strict=True) if r >= cut and r > 0}
    return [x for x, c in zip(lines, region, strict=True) if c in kept]


def content_lines(lines: list[tuple[str, int, int, bool, float, bool]]) -> list[str]:
    lines = upper_cluster(lines) if lines else []
    if not lines or any(x[3] for x in lines):
        return [x[0] for x in lines]
    ratios = smooth(np.array([len(x[0]) / max(1, x[1]) for x in lines]))
    cut = threshold(ratios)
    size: dict[int, list[float]] = {}
    for x, r in zip(lines, ratios.tolist(), strict=True):
        best = size.setdefault(x[2], [0.0, 0.0, 0.0])
        best[0] = max(best[0], r)
        best[1] += len(x[0])
        best[2] += len(x[0]) * x[4]
    kept = {c for c, (r, n, linked) in size.items() if r >= cut and linked <= 0.5 * n} or set(size)
    return [x[0] for x in lines if x[2] in kept]


def main_text(html: str | None) -> str:
    """The article's blocks in page order, joined by line feeds; empty for pages without any."""
    parser = Lines()
    try:
        parser.feed(html or "")
        parser.close()
    except AssertionError:  # the parser gives up on some broken declarations; what it has read so far counts
        parser.end_line()
    return "\n".join(content_lines(parser.lines))


def extract_pages(pages: DataFrame) -> DataFrame:
    """Per row: page_id, url, text, n_chars. A null html counts as empty; rows repeat as they do; empty stays empty."""
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return spread(own).mapInArrow(run, "page_id long, url string, text string, n_chars long")
