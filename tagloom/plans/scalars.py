"""Queries of the scalar functions over urls and texts, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as s
from ..sources import roles


def url_parts(spark: SparkSession, folder: str) -> DataFrame:
    """URL-1, URL-4, URL-6..9, URL-11, URL-17, URL-18: what urls are made of."""
    url = F.col("url")
    return roles.table(spark, folder, "pages").select(
        "page_id",
        s.is_valid_link(url).alias("valid"),
        s.normalize_url(F.concat(F.lit("HTTP://"), s.strip_protocol(url))).alias("normal"),
        s.host_url(url).alias("host_url"),
        s.cleanpath(url).alias("cleanpath"),
        F.array_join(s.subpaths(url), " ").alias("subpaths"),
        s.indexing_url(url).alias("alias"),
        s.without_fragment(url).alias("standard"),
        s.domain_from_url(url).alias("domain"),
        s.path_from_url(url).alias("path"),
    )


def url_queries(spark: SparkSession, folder: str) -> DataFrame:
    """URL-10, URL-12..16, URL-19, URL-3: query strings read, changed and written; links resolved."""
    url = F.col("url")
    return roles.table(spark, folder, "pages").select(
        "page_id",
        F.element_at(s.query_to_map(s.query_of(url)), "page").alias("page"),
        s.assert_query(url, {"page": "9", "ref": None}).alias("asserted"),
        s.analyze_request(url, {"mode": "json"})["path"].alias("request"),
        s.resolve(url, F.lit("/x/y")).alias("rooted"),
        s.resolve(url, F.lit("next")).alias("relative"),
        s.resolve(url, F.lit("//cdn.example/z")).alias("schemeless"),
        s.same_url(url, F.concat(url, F.lit("#part"))).alias("same"),
        s.host_forbidden(url, ["spam-farm.example.org", "m.thth.example.net"]).alias("forbidden"),
        s.sanitize_url(F.concat(url, F.lit(" a<b>"))).alias("sanitized"),
    )


def url_sites(spark: SparkSession, folder: str) -> DataFrame:
    """JOIN-18..22, URL-8: every url's site is the longest of its subpaths that is a site's root."""
    pages = roles.page_refs(spark, folder)
    roots = pages.select(F.regexp_extract("domain", r"([^.]+\.[^.]+)$", 1).alias("base"), "domain").select(F.col("domain").alias("root")).distinct()
    deeper = pages.select(F.get(s.subpaths(F.col("url")), F.lit(1)).alias("root")).filter("root IS NOT NULL").distinct()
    sites = roots.unionByName(deeper).distinct()
    steps = pages.select("page_id", F.explode(s.subpaths(F.regexp_replace("url", r"://www\.", "://"))).alias("root"))
    return steps.join(sites, "root").groupBy("page_id").agg(F.max_by("root", F.length("root")).alias("site"))


def url_fragments(spark: SparkSession, folder: str) -> DataFrame:
    """URL-2, URL-5: fragments repaired; of a url, the same and one that is none, the normal forms without protocol."""
    url = F.regexp_replace("url", "#.*$", "")
    pages = roles.table(spark, folder, "pages")
    several = F.array(url, url, F.lit("no link"))
    return pages.select("page_id", s.repair_fragment(F.concat(url, F.lit("#é b"))).alias("repaired"), s.repair_fragment(url).alias("same"), F.size(s.normalize_urls(several, strip=True)).alias("links"))


def url_contained(spark: SparkSession, folder: str) -> DataFrame:
    """JOIN-17, FLT-6: pages under a domain and its subdomains, by suffix steps instead of a containment test."""
    pages = roles.page_refs(spark, folder)
    labels = F.split("domain", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    steps = pages.select("page_id", F.explode(suffixes).alias("suffix"))
    return steps.groupBy("suffix").agg(F.count("*").alias("pages"))


def text_functions(spark: SparkSession, folder: str) -> DataFrame:
    """TXT-3..6, TXT-10..15: text functions over parts' columns."""
    p = roles.table(spark, folder, "part")
    words, name = F.split("p_name", " "), F.col("p_name")
    return p.select(
        "p_partkey",
        s.labelled_quantity(F.col("p_size") % 3, "piece").alias("quantity"),
        s.strjoin(F.concat(words, F.array("p_type", "p_brand"))).alias("joined"),
        s.merge_word_strings(name, F.concat(F.lit("small "), name, F.lit(" large"))).alias("merged"),
        s.deflate(F.concat(F.lit("a \t b"), name, F.lit(" \n  c"))).alias("deflated"),
        s.cleanup(F.concat(name, F.lit("  , "), F.col("p_type"))).alias("clean"),
        s.trim_title(F.concat(name, F.lit(" | The Shop")), r"^(.*?) \| ").alias("title"),
        s.to_boolean((F.col("p_size") % 2).cast("string")).alias("odd"),
        s.if_present(F.when(F.col("p_size") > 25, name).otherwise(F.lit(" ")), F.lit("none")).alias("present"),
        s.with_article(F.lower("p_type")).alias("article"),
        s.extensions_to_classes(F.concat(F.lower("p_type"), F.lit("."), F.get(words, F.lit(0)))).alias("classes"),
        s.dim_scale(F.concat(F.col("p_size").cast("string"), F.lit("px")), 1.5).alias("scaled"),
        s.error_status(F.concat(F.lit("failed with "), (F.col("p_size") + 400).cast("string"), F.lit(" at once"))).alias("status"),
        s.type_number(F.col("p_type"), {"Small": 1, "Large": 2, "Economy": 3}).alias("type_number"),
    )


def text_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """TXT-1, TXT-2, TXT-7, TXT-9: tokens with offsets, wrapped lines, condensed words, bins."""
    p = roles.table(spark, folder, "part")
    text = F.concat(F.col("p_name"), F.lit(", "), F.col("p_brand"))
    tokens = s.tokenize(text)
    return p.select(
        "p_partkey",
        F.array_join(F.transform(tokens, lambda t: F.concat(t["start"].cast("string"), F.lit(":"), t["token"])), " ").alias("tokens"),
        F.array_join(s.wrap_words(F.concat(text, F.lit(" "), text), 14), "|").alias("lines"),
        F.array_join(s.condense_strings(F.array(F.col("p_name"), F.concat(F.col("p_name"), F.lit("s")), F.col("p_type"))), "|").alias("condensed"),
        s.bin_of(F.array(*[F.lit(x) for x in (0, 10, 20, 40)]), F.col("p_size")).alias("bin"),
    )


def numbers_and_flags(spark: SparkSession, folder: str) -> DataFrame:
    """NUM-1, NUM-2, BIT-1, BIT-2: number words and fractions, attribute flags."""
    p = roles.table(spark, folder, "part")
    n = F.col("p_partkey") % 5
    text = F.when(n == 0, F.lit("1 and 1/2")).when(n == 1, F.lit("3/4")).when(n == 2, F.lit("two")).when(n == 3, F.lit("2½")).otherwise(F.lit("some"))
    flags = F.col("p_size").cast("int")
    names = ["title", "author", "image"]
    return p.select(
        "p_partkey",
        s.number_value(text).alias("value"),
        s.ratio(F.col("p_retailprice"), F.col("p_size") - 1).alias("ratio"),
        s.accepts(flags, 1).alias("accepts"),
        F.array_join(s.flagged(flags, names, "needed"), ",").alias("needed"),
        F.array_join(s.flagged(flags, names, "ready"), ",").alias("ready"),
    )


QUERIES = {f.__name__: f for f in (url_parts, url_queries, url_fragments, url_sites, url_contained, text_functions, text_tokens, numbers_and_flags)}

_BARE = "regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', '')"
_CLEAN = f"regexp_replace(regexp_replace({_BARE}, '[?#].*$', ''), '/+$', '')"
ORACLE_SQL = {
    "url_parts": roles.with_roles("page_refs", query=f"""SELECT page_id, regexp_matches(url, '^https?://[^\\s/?#]+\\S*$', 'i') AS valid,
  'http://' || lower(regexp_extract({_BARE}, '^[^/?#]*')) || CASE WHEN regexp_extract({_BARE}, '^[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract({_BARE}, '^[^/?#]*([^?#]*)', 1) END
    || regexp_extract(url, '^[^?#]*(.*)$', 1) AS normal,
  lower(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*')) AS host_url, {_CLEAN} AS cleanpath,
  array_to_string(list_transform(range(1, len(string_split({_CLEAN}, '/')) + 1), lambda i: array_to_string(string_split({_CLEAN}, '/')[1:i], '/')), ' ') AS subpaths,
  alias, regexp_replace(url, '#[^#]*$', '') AS standard, domain, regexp_extract({_BARE}, '^[^/?#]*/?([^?#]*)', 1) AS path FROM page_refs"""),
    "url_queries": """WITH p AS (SELECT *, regexp_extract(url, '^[^?#]*') AS base, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS root,
    list_filter(string_split(regexp_extract(url, '[?]([^#]*)', 1), '&'), lambda x: x <> '') AS q FROM pages)
SELECT page_id, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page,
  base || '?' || array_to_string(list_sort(list_append(list_filter(q, lambda x: NOT starts_with(x, 'page=') AND NOT starts_with(x, 'ref=')), 'page=9')), '&') AS asserted,
  base AS request, root || '/x/y' AS rooted, root || CASE WHEN base = root THEN '/' ELSE regexp_replace(base[length(root) + 1:], '[^/]*$', '') END || 'next' AS relative,
  regexp_extract(url, '^[a-z]+:') || '//cdn.example/z' AS schemeless, true AS same,
  regexp_extract(url, '://([^/?#]*)', 1) IN ('spam-farm.example.org', 'm.thth.example.net') AS forbidden, url || '%20a%3Cb%3E' AS sanitized FROM p""",
    "url_fragments": "SELECT page_id, regexp_replace(url, '#.*$', '') || '#%C3%A9%20b' AS repaired, regexp_replace(url, '#.*$', '') AS same, CAST(1 AS INTEGER) AS links FROM pages",
    "url_sites": roles.with_roles("page_refs", then=f"""cut AS (SELECT page_id, string_split({_CLEAN}, '/') AS s, string_split(regexp_replace({_CLEAN}, '^www\\.', ''), '/') AS b, domain FROM page_refs),
  sites AS (SELECT DISTINCT domain AS root FROM page_refs UNION SELECT s[1] || '/' || s[2] FROM cut WHERE len(s) > 1),
  steps AS (SELECT page_id, array_to_string(b[1:i], '/') AS root FROM cut, (SELECT unnest(range(1, 12)) AS i) WHERE i <= len(b))""",
        query="SELECT page_id, arg_max(root, length(root)) AS site FROM steps JOIN sites USING (root) GROUP BY page_id"),
    "url_contained": roles.with_roles("page_refs", then="cut AS (SELECT page_id, string_split(domain, '.') AS s FROM page_refs)",
        query="SELECT suffix, count(*) AS pages FROM (SELECT array_to_string(s[i:], '.') AS suffix FROM cut, (SELECT unnest(range(1, 12)) AS i) WHERE i <= len(s)) GROUP BY suffix"),
    "text_functions": """SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'No pieces' WHEN 1 THEN '1 piece' ELSE '2 pieces' END AS quantity,
  replace(p_name, ' ', ', ') || ', ' || p_type || ' and ' || p_brand AS joined,
  array_to_string(list_concat(string_split(p_name, ' '), list_filter(['small', 'large'], lambda w: NOT list_contains(string_split(p_name, ' '), w))), ' ') AS merged,
  'a b' || p_name || chr(10) || 'c' AS deflated, p_name || ', ' || p_type AS clean, p_name AS title, p_size % 2 = 1 AS odd,
  CASE WHEN p_size > 25 THEN p_name ELSE 'none' END AS present, CASE WHEN regexp_matches(lower(p_type), '^[aeiou]') THEN 'an ' ELSE 'a ' END || lower(p_type) AS article,
  lower(p_type) || ' ' || lower(p_type) || '-' || string_split(p_name, ' ')[1] AS classes, CAST(p_size * 1.5 AS DOUBLE) || 'px' AS scaled, p_size + 400 AS status,
  CASE p_type WHEN 'SMALL' THEN 1 WHEN 'LARGE' THEN 2 WHEN 'ECONOMY' THEN 3 ELSE 0 END AS type_number FROM part""",
    "numbers_and_flags": """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 1.5 WHEN 1 THEN 0.75 WHEN 2 THEN 2.0 WHEN 3 THEN 2.5 END AS value,
  CASE WHEN p_size <> 1 THEN p_retailprice / (p_size - 1) END AS ratio, ((p_size >> 3) & 1) = 0 OR ((p_size >> 2) & 1) = 1 AS accepts,
  array_to_string(list_filter(['title', 'author', 'image'], lambda x, i: ((p_size >> CAST(2 * (i - 1) AS INTEGER)) & 1) = 1), ',') AS needed,
  array_to_string(list_filter(['title', 'author', 'image'], lambda x, i: ((p_size >> CAST(2 * (i - 1) + 1 AS INTEGER)) & 1) = 1), ',') AS ready FROM part""",
    "text_tokens": """WITH w AS (SELECT *, string_split(p_name, ' ') AS s, p_name || ', ' || p_brand AS t FROM part)
SELECT p_partkey, array_to_string(list_concat([
    '0:' || s[1]], list_transform(range(2, len(s) + 1), lambda i: CAST(length(array_to_string(s[1:i - 1], ' ')) + 1 AS VARCHAR) || ':' || s[i]), [length(p_name) || ':,', (length(p_name) + 2) || ':Brand', (length(p_name) + 7) || ':#', (length(p_name) + 8) || ':' || p_brand[7:]]), ' ') AS tokens,
  list_reduce(list_prepend('', string_split(t || ' ' || t, ' ')), lambda a, x: CASE WHEN a = '' THEN x WHEN length(string_split(a, '|')[-1]) + 1 + length(x) <= 14 THEN a || ' ' || x ELSE a || '|' || x END) AS lines,
  CASE WHEN p_type < p_name THEN p_type || '|' || p_name ELSE p_name || '|' || p_type END AS condensed,
  CASE WHEN p_size >= 40 THEN 40 WHEN p_size >= 20 THEN 20 WHEN p_size >= 10 THEN 10 ELSE 0 END AS bin FROM w""",
}
