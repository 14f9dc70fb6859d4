"""Queries of page elements: pages trimmed, cleaned, cut to a selection, and as ranges of tokens, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import elements
from ..sources import files, roles


def _nodes(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """All pages, and their nodes as a stored table."""
    pages = roles.table(spark, folder, "pages")
    return pages, files.stored(elements.nodes(pages, also=("url",)), "page-nodes")


def _html(pages: DataFrame, found: DataFrame) -> DataFrame:
    """page_id, html of every page; those without nodes have the empty text."""
    html = elements.assembled(found, ["doc", "page_id"]).drop("doc")
    return html.unionByName(pages.filter("coalesce(html, '') = ''").select("page_id", F.lit("").alias("html")))


def page_trimmed(spark: SparkSession, folder: str) -> DataFrame:
    """EXT-10: every page without menus, adverts, footers, heads and scripts, links absolute, white space deflated."""
    pages, found = _nodes(spark, folder)
    return _html(pages, elements.trimmed(found, ["nav", "body > div.ad, footer", "html head"], F.col("url")))


def page_cleaned(spark: SparkSession, folder: str) -> DataFrame:
    """EXT-9, EXT-11: every page without scripts and needless line breaks, line ends as blanks."""
    pages, found = _nodes(spark, folder)
    return _html(pages, elements.cleaned(elements.sanitised(found)))


def page_menus(spark: SparkSession, folder: str) -> DataFrame:
    """EXT-10: what trimming to the menus leaves of every page: their links, absolute."""
    pages, found = _nodes(spark, folder)
    kept = elements.trimmed(found, ["head", "article", "footer", "div"], F.col("url")).filter("kind <> 'comment'")
    return _html(pages, kept)


def page_selection(spark: SparkSession, folder: str) -> DataFrame:
    """EXT-15: of every page what lies from its second paragraph back to its heading."""
    pages, found = _nodes(spark, folder)
    asked = pages.select("page_id", F.lit(1).alias("selection"), F.lit("/HTML/body/article/p[2]").alias("anchor"), F.lit("/html/body/article/h1").alias("focus"))
    return elements.selected(found, asked).select("page_id", "html")


def page_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """TOK-1, TOK-3, TOK-4: every paragraph of every article as a range of its page's tokens, with the range's text."""
    _, found = _nodes(spark, folder)
    tokens, texts = (files.stored(f(found), name) for f, name in ((elements.page_tokens, "page-tokens"), (elements.page_texts, "page-texts")))
    ranges = elements.range_texts(elements.token_ranges(found, tokens, "article p"), tokens, texts)
    nth = F.row_number().over(Window.partitionBy("doc").orderBy("n"))
    return ranges.select("page_id", nth.alias("nth"), "first", "limit", "text")


QUERIES = {f.__name__: f for f in (page_trimmed, page_cleaned, page_menus, page_selection, page_ranges)}

#: Pages with the end tags that they leave out, without document types, scripts and what follows the body.
_WHOLE = r"""WITH w AS (SELECT page_id, url, html IS NULL OR html = '' AS blank,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '^<!DOCTYPE html>', ''), '<script>.*?</script>', '', 'gs'), '(</body>)?(</html>)?\s*$', '</body></html>'), '<p><b>([^<]*)<br>(</p>)?', '<p><b>\1<br></b></p>', 'g') AS raw FROM pages),
h AS (SELECT page_id, url, blank, replace(replace(raw, '&quot;', '"'), '&#x27;', '''') AS h FROM w)"""
_TEXT = "replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"
_FOOTED = "replace(replace(h, '&copy;', '©'), '&middot;', '·')"
ORACLE_SQL = {
    "page_trimmed": _WHOLE
    + r""" SELECT page_id, CASE WHEN blank THEN '' ELSE regexp_replace(regexp_replace(h, '<head>.*?</head>|<nav>.*?</nav>|<div class="ad">.*?</div>|<footer>.*?</footer>', '', 'gs'), '[ \t\r\f]+', ' ', 'g') END AS html FROM h""",
    "page_cleaned": _WHOLE + f" SELECT page_id, CASE WHEN blank THEN '' ELSE regexp_replace({_FOOTED}, '\\s*\\n+\\s*', ' ', 'g') END AS html FROM h",
    "page_menus": _WHOLE
    + r""" SELECT page_id, CASE WHEN blank THEN '' ELSE regexp_replace(regexp_replace(h, '<head>.*?</head>|<article>.*?</article>|<div class="ad">.*?</div>|<footer>.*?</footer>|<!--.*?-->', '', 'gs'),
  '<a href="/', '<a href="' || regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || '/', 'g') END AS html FROM h""",
    "page_selection": _WHOLE + r""", s AS (SELECT page_id, regexp_extract(h, '(?s)<article>(<h1>[^<]*</h1>(<p>.*?</p>){2})', 1) AS part FROM h)
SELECT page_id, CASE WHEN part <> '' THEN '<div>' || part || '</div>' END AS html FROM s""",
    "page_ranges": _WHOLE + r""", a AS (SELECT page_id, row_number() OVER () AS r, string_split(regexp_replace(regexp_extract(h, '(?s)^(.*)</article>', 1), '<style>.*?</style>', '', 'gs'), '<p>') AS parts FROM h),
p AS (SELECT page_id, i, regexp_replace(regexp_replace(array_to_string(parts[:i], ' '), '<(br|ul|li)[^>]*>', ' ', 'g'), '<[^>]*>', '', 'g') AS before, regexp_replace(parts[i + 1], '<[^>]*>', '', 'g') AS text
  FROM a, LATERAL (SELECT unnest(range(1, len(parts))) AS i)),
d AS (SELECT page_id, i, BEFORE AS before, trim(TEXT) AS text FROM p),
t AS (SELECT page_id, i, text, len(regexp_extract_all(before, '[\p{L}\p{N}_]+|\n\s*|[^\p{L}\p{N}_\s]')) AS n, len(regexp_extract_all(text, '[\p{L}\p{N}_]+|\n\s*|[^\p{L}\p{N}_\s]')) AS m FROM d)
SELECT page_id, CAST(i AS INTEGER) AS nth, CAST(n AS INTEGER) AS first, CAST(n + m AS INTEGER) AS "limit", text FROM t""".replace("BEFORE", _TEXT.format("before")).replace("TEXT", _TEXT.format("text")),
}
