"""Labelled values of web pages: finders (label, selector, attribute) applied to parser events.

Python reads a page once and reports the elements that a selector names, as rows; everything else
(which finders apply, order, first values, absolute links, tags of a page) is done on those rows.
Selectors are a tag, `.class`, `#id` and `[attribute='value']` (also `^=`) in any combination, and
descendants of such.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import resolve

# Labels, selectors and attributes ("" for an element's text) of the finders that apply to every site.
FINDERS = [
    ("URI", "meta[property='og:url']", "content"),
    ("URI", "link[rel='canonical']", "href"),
    ("URI", "div.post a[rel='bookmark']", "href"),
    ("URI", ".title a", "href"),
    ("URI", "a.permalink", "href"),
    ("Image", "meta[itemprop='image']", "content"),
    ("Image", "meta[property='og:image']", "content"),
    ("Image", "img.recipe_image", "src"),
    ("Image", "img.mainIMG", "src"),
    ("Image", "div.entry-content img", "src"),
    ("Image", "div.post-body img", "src"),
    ("Image", "img[itemprop='image']", "src"),
    ("Image", "link[itemprop='image']", "href"),
    ("Image", "link[rel='image_src']", "href"),
    ("Image", "img[itemprop='photo']", "src"),
    ("Image", ".entry img", "src"),
    ("Image", "img", "src"),
    ("Title", "meta[name='title']", "content"),
    ("Title", "meta[name='fb_title']", "content"),
    ("Title", "meta[property='og:title']", "content"),
    ("Title", "meta[property='dc:title']", "content"),
    ("Title", "title", ""),
    ("Author", "meta[name='author']", "content"),
    ("Author", "meta[itemprop='author']", "content"),
    ("Author", "meta[name='author.name']", "content"),
    ("Author", "meta[name='article.author']", "content"),
    ("Author Link", "link[rel='author']", "href"),
    ("Description", "meta[name='description']", "content"),
    ("Description", "meta[property='og:description']", "content"),
    ("Description", "meta[property='description']", "content"),
    ("Description", "meta[itemprop='description']", "content"),
    ("Tags", "meta[name='keywords']", "content"),
    ("Site Name", "meta[property='og:site_name']", "content"),
    ("Site Name", "meta[name='application_name']", "content"),
    ("RSS Feed", "link[type='application/rss+xml']", "href"),
]
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_STEP = re.compile(r"([\w-]*)((?:[.#][\w-]+|\[[\w:-]+\^?='[^']*'\])*)")


def _step(text: str):
    """A test of (tag, attributes) for one compound selector."""
    tag, rest = _STEP.fullmatch(text).groups()
    classes, ids = set(re.findall(r"\.([\w-]+)(?![^\[]*\])", rest)), re.findall(r"#([\w-]+)(?![^\[]*\])", rest)
    wanted = re.findall(r"\[([\w:-]+)(\^?)='([^']*)'\]", rest)

    def fits(name, attrs):
        if tag and name != tag or not classes <= set((attrs.get("class") or "").split()) or any(attrs.get("id") != i for i in ids):
            return False
        return all((attrs.get(k) or "").startswith(v) and (start or attrs.get(k) == v) for k, start, v in wanted)

    return fits


class _Found(HTMLParser):
    """Values of the selectors' elements in page order."""

    def __init__(self, selectors: list[tuple[list, str]]):
        super().__init__(convert_charrefs=True)
        self.selectors, self.stack, self.open, self.values = selectors, [], [], []

    def handle_starttag(self, tag, attrs):
        known = dict(attrs)
        self.stack.append((tag, known))
        for i, (steps, attribute) in enumerate(self.selectors):
            if not steps[-1](tag, known):
                continue
            at, left = len(self.stack) - 2, list(steps[:-1])
            while left and at >= 0:
                if left[-1](*self.stack[at]):
                    left.pop()
                at -= 1
            if left:
                continue
            if attribute:
                self.values.append([i, known.get(attribute) or ""])
            elif tag not in _VOID:
                self.values.append([i, ""])
                self.open.append((len(self.stack), len(self.values) - 1))
        if tag in _VOID:
            self.stack.pop()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        depth = next((d for d in range(len(self.stack), 0, -1) if self.stack[d - 1][0] == tag), 0)
        if depth:
            del self.stack[depth - 1 :]
            self.open = [(d, v) for d, v in self.open if d < depth]

    def handle_data(self, data):
        if not any(t in ("script", "style") for t, _ in self.stack):
            for _, v in self.open:
                self.values[v][1] += data


def _read_pages(pages: DataFrame, finders: list[tuple[str, str, str]], key: str, html: str, also: tuple[str, ...] = ()) -> DataFrame:
    """key, columns asked for also, finder, place, value: what each finder finds on each page, as it stands there."""
    selectors = [(s.split(), a) for _, s, a in finders]
    kept = [key, *also]

    def read(batches):
        compiled = [([_step(x) for x in steps], a) for steps, a in selectors]
        for part in batches:
            rows = []
            for *own, text in zip(*[part[c] for c in (*kept, html)]):
                page = _Found(compiled)
                page.feed(text or "")
                page.close()
                rows += [(*own, i, n, value) for n, (i, value) in enumerate(page.values)]
            yield pd.DataFrame(rows, columns=[*kept, "finder", "place", "value"])

    kinds = dict(pages.dtypes)
    return pages.select(*kept, html).mapInPandas(read, ", ".join([f"{c} {kinds[c]}" for c in kept] + ["finder int, place int, value string"]))


def finder_set(own: list[tuple[str, str, str, str]], only: list[str] | None = None, but: list[str] | None = None, general: list[tuple[str, str, str]] = FINDERS) -> list[tuple[str | None, str, str, str]]:
    """(site, label, selector, attribute): finders of sites, then those of all sites (site None); with certain labels only, or without some."""
    if only and but:
        raise ValueError("either labels that are asked for or labels that are left out")
    every = [*own, *[(None, *f) for f in general]]
    return [f for f in every if (not only or f[1] in only) and (not but or f[1] not in but)]


def found_by(pages: DataFrame, finders: list[tuple[str | None, str, str, str]], site: Column, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, site, finder (its place in the list), label, selector, attribute, value: what each finder finds on pages of its site (or of all, if it has none), each value once.

    site: the site of a page, an expression on pages' columns. Blank values are dropped.
    """
    table = F.array(*[F.struct(*[F.lit(v).cast("string").alias(n) for n, v in zip(("of", "label", "selector", "attribute"), f)]) for f in finders])
    raw = _read_pages(pages.select(key, html, site.alias("site")), [(f[1], f[2], f[3]) for f in finders], key, html, ("site",))
    named = raw.withColumn("_f", F.get(table, F.col("finder"))).filter("_f.of IS NULL OR _f.of = site")
    clean = named.withColumn("value", F.trim(F.regexp_replace("value", r"\s+", " "))).filter("value <> ''")
    return clean.select(key, "site", "finder", "_f.label", "_f.selector", "_f.attribute", "value").distinct()


def finder_votes(found: DataFrame, accepted: DataFrame, key: str = "page_id") -> DataFrame:
    """site, label, selector, attribute, hits: on how many pages of a site each finder found the value that was accepted (key, label, value)."""
    return found.join(accepted.select(key, "label", "value").distinct(), [key, "label", "value"], "left_semi").groupBy("site", "label", "selector", "attribute").agg(F.count("*").alias("hits"))


def glean(pages: DataFrame, finders: list[tuple[str, str, str]] = FINDERS, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, label, ord, value: what the finders find, by finder, then in page order; blanks and repeated values dropped.

    Null pages give no rows. ord counts from 1 within a page and label.
    """
    labels = [f[0] for f in finders]
    raw = _read_pages(pages, finders, key, html)
    named = raw.withColumn("label", F.get(F.array(*[F.lit(x) for x in labels]), F.col("finder"))).withColumn("value", F.trim(F.regexp_replace("value", r"\s+", " "))).filter("value <> ''")
    once = named.groupBy(key, "label", "value").agg(F.min(F.struct("finder", "place")).alias("at"))
    return once.withColumn("ord", F.row_number().over(Window.partitionBy(key, "label").orderBy("at"))).select(key, "label", "ord", "value")


def adopt(gleaned: DataFrame, urls: DataFrame, key: str = "page_id") -> DataFrame:
    """A row for each page: the first value of most labels, all tags and authors joined, all feeds, links made absolute."""
    firsts = gleaned.groupBy(key).pivot("label", ["URI", "Image", "Title", "Description", "Site Name"]).agg(F.min_by("value", "ord"))
    lists = gleaned.groupBy(key).agg(
        *[F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("label") == label, F.struct("ord", "value")))), lambda x: x["value"]), ", ").alias(name) for label, name in (("Author", "authors"), ("Tags", "tags"))],
        F.transform(F.array_sort(F.collect_list(F.when(F.col("label") == "RSS Feed", F.struct("ord", "value")))), lambda x: x["value"]).alias("feeds"),
    )
    joined = urls.join(firsts, key, "left").join(lists, key, "left")
    return joined.select(
        key,
        F.coalesce(F.col("URI"), F.col("url")).alias("uri"),
        resolve(F.col("url"), F.col("Image")).alias("image"),
        F.col("Title").alias("title"),
        F.col("Description").alias("description"),
        F.col("Site Name").alias("site_name"),
        *[F.when(F.col(c) != "", F.col(c)).alias(c) for c in ("authors", "tags")],
        F.transform("feeds", lambda f: resolve(F.col("url"), f)).alias("feeds"),
    )


def links(pages: DataFrame, key: str = "page_id", html: str = "html", url: str = "url") -> DataFrame:
    """key, link: absolute targets of a page's links, each once."""
    found = pages.select(key, url, F.explode(F.regexp_extract_all(html, F.lit(r"""(?i)<a\b[^>]*?\bhref\s*=\s*["']([^"'>]*)["']"""), F.lit(1))).alias("href"))
    return found.select(key, resolve(F.col(url), F.regexp_replace("href", "&amp;", "&")).alias("link")).distinct()


def feed_candidates(pages: DataFrame, key: str = "page_id", html: str = "html", url: str = "url") -> DataFrame:
    """key, link: links that may be feeds, by their address or their declared type."""
    declared = pages.select(key, url, F.explode(F.regexp_extract_all(html, F.lit(r"""(?i)<link\b[^>]*type\s*=\s*["']application/(?:rss|atom)[^>]*>"""), F.lit(0))).alias("tag"))
    declared = declared.select(key, resolve(F.col(url), F.regexp_extract("tag", r"""(?i)href\s*=\s*["']([^"']*)""", 1)).alias("link"))
    return links(pages, key, html, url).filter(F.lower("link").rlike("rss|feedburner|atom")).unionByName(declared).distinct()


def match_parts(existing: DataFrame, found: DataFrame, page: str = "page_id") -> DataFrame:
    """Which stored part of a page each found part is: by path, else by title, else any part left over; null: a new one.

    existing: page, part_id, path, title; found: page, n, path, title. Three joins, each on what the ones before left.
    """
    def once(pairs: DataFrame) -> DataFrame:
        a = Window.partitionBy(page, "n").orderBy("part_id")
        b = Window.partitionBy(page, "part_id").orderBy("n")
        return pairs.withColumn("_a", F.row_number().over(a)).filter("_a = 1").withColumn("_b", F.row_number().over(b)).filter("_b = 1").select(page, "n", "part_id")

    matched, old, new = None, existing, found
    for on in ("path", "title"):
        pairs = once(new.filter(f"{on} IS NOT NULL").join(old.select(page, on, "part_id"), [page, on]))
        matched = pairs if matched is None else matched.unionByName(pairs)
        old, new = old.join(pairs, [page, "part_id"], "left_anti"), new.join(pairs, [page, "n"], "left_anti")
    rank_new, rank_old = Window.partitionBy(page).orderBy("n"), Window.partitionBy(page).orderBy("part_id")
    rest = new.withColumn("_r", F.row_number().over(rank_new)).join(old.select(page, "part_id", F.row_number().over(rank_old).alias("_r")), [page, "_r"], "left")
    return matched.unionByName(rest.select(page, "n", "part_id"))
