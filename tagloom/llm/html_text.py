"""Main text of web pages, from a stream of parser events and text-to-tag ratios.

The standard library's parser reports tags and text one after another; no tree is built. Every
block-level tag ends a line, so a line is the text of one block. A line's ratio is its characters
of text (those of links left out) to its tags. Structure weighs it: lines of elements and roles that
are furniture by their meaning (menus, footers, asides, forms, ...) weigh nothing, those of elements
whose class or id speaks of comments, adverts or notices, or outside articles of menus, headers and
footers, weigh WEAK. Weighed ratios are smoothed by a
Gaussian over neighbouring lines and compared with a threshold, a fraction of their standard
deviation.

Neighbouring lines of one kind (text, mostly links, weak) form runs, and the threshold decides run by
run: a run of text is content if any line of it reaches the threshold; a run of links, or of weak
lines, if its mean does. So a link in a sentence's place stays, a list of links goes, wherever it is.
Content clusters tell the page's content regions: the articles that hold any, or else all from the
first division that does to the last. Text of a content region stays even where it is short
(headings, one-word paragraphs); its links and weak lines stay if their runs are content.

Null and empty pages give the empty text, as do pages without text outside their furniture. Broken
markup is read as far as the parser gets. Repeated rows and rows without an id stay; an empty table
gives no rows. Other columns are kept, but the html and a column named `text`, which the result replaces.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Standard deviation of the smoothing, in lines, and its reach.
SIGMA, REACH = 1.0, 3
#: Lines above this part of the ratios' standard deviation are content.
THRESHOLD = 0.5

# Elements by their meaning in HTML.
DROPPED = frozenset("script style noscript template svg math iframe object canvas audio video map select textarea button datalist head title".split())
#: Elements that a head may hold; any other ends it.
IN_HEAD = frozenset("base link meta noscript script style template title".split())
FURNITURE = frozenset("nav footer aside form menu dialog search".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
REGIONS = frozenset("article main".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Words of class and id attributes that make a line weak, and those that take that back.
COMMENT_WORDS = frozenset("comment comments commentlist commenter reply replies respond disqus".split())
WEAK_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising banner sponsor sponsored promo promotion "
    "notice notices alert cookie cookies consent newsletter subscribe popup modal sidebar widget breadcrumb breadcrumbs".split()
)
#: Words of furniture that an article may have for parts of its own.
PAGE_WORDS = frozenset("menu menus nav navbar navigation header footer masthead topbar toolbar copyright social share sharing related login signup search".split())
CONTENT_WORDS = frozenset("article body content entry main post story text".split())
#: What a weak line's ratio counts.
WEAK = 0.1
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_SPACE = re.compile(r"\s+")
#: Elements that an opening block closes if they are still open (their end tags may be left out).
CLOSED_BY_BLOCK = frozenset(["p"])
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}


def is_furniture(tag: str, attrs: list[tuple[str, str | None]], in_article: bool) -> bool:
    if tag in FURNITURE or (tag == "header" and not in_article):
        return True
    for name, value in attrs:
        value = (value or "").lower()
        if name == "hidden" or (name == "role" and value.strip() in ROLES) or (name == "aria-hidden" and value.strip() == "true"):
            return True
        if name == "style" and "display:none" in value.replace(" ", ""):
            return True
    return False


def is_weak(tag: str, attrs: list[tuple[str, str | None]], in_article: bool) -> bool:
    if tag in ("html", "body", "main", "article"):
        return False
    words = {w.lower() for name, value in attrs if value and name in ("class", "id") for w in _WORDS.findall(value)}
    if not words.isdisjoint(COMMENT_WORDS):
        return True
    return words.isdisjoint(CONTENT_WORDS) and not (words.isdisjoint(WEAK_WORDS) and (in_article or words.isdisjoint(PAGE_WORDS)))


class Lines(HTMLParser):
    """Lines of a page: text, tags, characters in links, weight (0: furniture), and the region that holds them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, float]] = []  # tag, region, weight
        self.lines: list[tuple[str, int, int, float, int]] = []
        self.parents: dict[int, tuple[int | None, str]] = {0: (None, "body")}
        self.regions = 0
        self.text: list[str] = []
        self.tags = self.linked = self.links = self.dropped = 0

    def _state(self) -> tuple[int, float]:
        return self.stack[-1][1:] if self.stack else (0, 1.0)

    def _end_line(self) -> None:
        text = _SPACE.sub(" ", "".join(self.text)).strip()
        if text:
            region, weight = self._state()
            self.lines.append((text, self.tags, self.linked, weight, region))
        self.text, self.tags, self.linked = [], 0, 0

    def _end_head(self, tag: str) -> None:
        """A head whose end tag is left out ends at the body, or at the first element that it can't hold."""
        at = next((i for i, (t, _, _) in enumerate(self.stack) if t == "head"), None)
        if at is not None and (tag == "body" or (at == len(self.stack) - 1 and tag not in IN_HEAD)):
            while len(self.stack) > at:
                self._pop()

    def handle_starttag(self, tag, attrs):
        if self.dropped:
            self._end_head(tag)
        if tag in BLOCKS:
            self._end_line()
            top = self.stack[-1][0] if self.stack else ""
            if top in CLOSED_BY_BLOCK or top in SIBLINGS.get(tag, ()):
                self._pop()
        self.tags += 1
        if tag in VOID:
            if tag == "br":
                self.text.append(" ")
            return
        region, weight = self._state()
        in_article = any(t in REGIONS for t, _, _ in self.stack)
        if weight and is_furniture(tag, attrs, in_article):
            weight = 0.0
        elif attrs and is_weak(tag, attrs, in_article):
            weight = min(weight, WEAK)
        if tag in REGIONS or tag in ("div", "section", "td"):
            self.regions += 1
            self.parents[self.regions] = (region, tag)
            region = self.regions
        if tag in DROPPED:
            self.dropped += 1
        elif tag == "a":
            self.links += 1
        self.stack.append((tag, region, weight))

    def handle_startendtag(self, tag, attrs):
        if tag in VOID or tag not in BLOCKS:
            self.tags += 1
            if tag == "br":
                self.text.append(" ")
        else:
            self.handle_starttag(tag, attrs)  # a slash doesn't end an HTML element

    def _pop(self):
        tag = self.stack.pop()[0]
        if tag in DROPPED:
            self.dropped -= 1
        elif tag == "a":
            self.links -= 1

    def handle_endtag(self, tag):
        self.tags += 1
        if tag == "br":
            self.text.append(" ")
        if tag in BLOCKS:
            self._end_line()
        depth = next((i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i][0] == tag), None)
        if depth is None:
            return
        if tag not in BLOCKS and tag not in DROPPED and any(t in BLOCKS for t, _, _ in self.stack[depth + 1 :]):
            return  # an inline end tag doesn't close blocks
        while len(self.stack) > depth:
            self._pop()

    def handle_data(self, data):
        if self.dropped and data.strip():
            self._end_head("")
        if self.dropped:
            return
        self.text.append(data)
        if self.links:
            self.linked += len(data.strip())

    def close(self):
        if self.rawdata.startswith("<!--"):  # a comment without an end goes on to the end of the page
            self.rawdata = ""
        super().close()
        self._end_line()


def smooth(ratios: np.ndarray) -> np.ndarray:
    """Each line's mean of its neighbours, weighed by a Gaussian; beyond the page there is nothing."""
    kernel = np.exp(-0.5 * (np.arange(-REACH, REACH + 1) / SIGMA) ** 2)
    padded = np.pad(ratios, REACH)
    weight = np.convolve(np.pad(np.ones(len(ratios)), REACH), kernel, "valid")
    return np.convolve(padded, kernel, "valid") / weight


def content_lines(lines: list[tuple[str, int, int, float, int]]) -> np.ndarray:
    """Whether each line (text, tags, linked characters, weight, region) lies in a run that is content."""
    linked = np.array([x[2] for x in lines], float)
    length = np.array([len(x[0]) for x in lines], float)
    tags = np.array([max(1, x[1]) for x in lines], float)
    weight = np.array([x[3] for x in lines], float)
    ratios = weight * np.maximum(0, length - linked) / tags
    smoothed = smooth(ratios)
    threshold = min(THRESHOLD * ratios.std(), smoothed.max())
    kind = np.where(weight == 0, 3, np.where(weight < 1, 2, (2 * linked > length).astype(int)))
    found = np.zeros(len(lines), bool)
    at = np.flatnonzero(kind < 3)  # furniture doesn't part a run
    for run in np.split(at, np.flatnonzero(np.diff(kind[at])) + 1):
        if not len(run):
            continue
        reached = smoothed[run].max() if kind[run[0]] == 0 else (smoothed[run] * weight[run]).mean()
        found[run] = reached >= threshold
    return found


def extract(html: str | None) -> str:
    if not html:
        return ""
    page = Lines()
    page.feed(html)
    page.close()
    lines = page.lines
    if not any(x[3] for x in lines):
        return ""
    content = content_lines(lines)

    def region_of(r: int) -> int:
        """The article or main element around a region; else the region itself."""
        outer, at = None, r
        while at is not None:
            parent, tag = page.parents[at]
            if tag in REGIONS:
                outer = at
            at = parent
        return r if outer is None else outer

    homes = [region_of(x[4]) for x in lines]
    taken = {home for home, yes in zip(homes, content) if yes}
    articles = {h for h in taken if page.parents[h][1] in REGIONS}
    if articles:
        inside = [home in articles for home in homes]
    else:  # short regions among those of content are content too
        at = [i for i, (home, x) in enumerate(zip(homes, lines)) if home in taken and x[3]]
        inside = [at[0] <= i <= at[-1] for i in range(len(lines))] if at else [False] * len(lines)
    # text stays even where it is short; links and weak lines stay if the ratios say so
    return " ".join(x[0] for x, here, yes in zip(lines, inside, content) if here and x[3] and (yes or (x[3] == 1 and 2 * x[2] <= len(x[0]))))


def _extract_batches(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([extract(h) for h in batch.columns[-1].to_pylist()], pa.string())], [*batch.schema.names[:-1], "text"])


def extract_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """The columns of pages without the html, and `text`."""
    common.on_workers(pages.sparkSession)
    kept = [c for c in pages.columns if c not in (html, "text")]
    chosen = pages.select(*kept, F.col(html).cast("string").alias("_html"))
    return chosen.mapInArrow(_extract_batches, common.schema_with(chosen.drop("_html"), "text string"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_text(common.table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.withColumn("n_chars", F.length("text").cast("long"))
