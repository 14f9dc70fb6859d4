"""Queries of kept results, asserted dictionaries, nested data, bins and crawls, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import domain_from_url, resolve
from ..operators import bins, crawl, dictionary, elements, nested, results, search
from ..sources import files, roles
from . import search as plan

SOURCES = ("part", "orders", "lineitem")


def search_kept(spark: SparkSession, folder: str) -> DataFrame:
    """SRCH-1, AGG-2, WIN-6, STM-10: two windows of a search that is kept in a table, with its full size."""
    first = search.Search(("small", "ring"), offset=5, limit=5)
    kept = results.Kept(spark, files.shared_path(spark, "kept"), lambda a: plan._found(spark, folder, list(a.tags), a.viewer).select("entity_id", "title", "score"), search.order_of, [f"{folder}/{t}.parquet" for t in SOURCES])
    size = kept.ensure(first)
    after = search.next_window(first.offset, first.limit, size) or (size, size)
    second = search.Search(first.tags, offset=after[0], limit=after[1] - after[0])
    return kept.window(first).unionByName(kept.window(second)).select(F.col("rank").cast("int").alias("rank"), "entity_id", "title", "score", "full_size")


def _tag_ids(tags: DataFrame) -> DataFrame:
    """Tags with numbers, which come from their keys."""
    return tags.select(F.conv(F.substring(F.md5("tag"), 1, 7), 16, 10).cast("long").alias("id"), "name", "normalized_name")


def search_ids(spark: SparkSession, folder: str) -> DataFrame:
    """SRCH-3: a search whose tags are given by a number, by the negative number of a special tag, and by name."""
    tags = _tag_ids(roles.tags(spark, folder)).filter(F.col("id") > 0)
    number = tags.filter("name = 'red'").agg(F.min("id")).first()[0]  # one number
    asked = spark.createDataFrame([("s", i, t) for i, t in enumerate(search.split_tokens(f"{number}, -1, 'ring'"))], "session string, place int, token string")
    meant, _ = search.query_tags(asked, tags, spark.createDataFrame([("s", -1, "small")], "session string, id long, name string"))
    words = [r["name"] for r in meant.orderBy("place").collect()]  # one request's tags
    return plan._asked(spark, folder, search.Search(tuple(words))).select("rank", "entity_id", "title", "score")


def tag_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """TAG-7, TAG-8, SRC-11: the tag table after a dictionary of all nouns, brands and nations is asserted; words are free before."""
    tags = roles.tags(spark, folder).select("name", "normalized_name", F.when(F.col("tagtype") == roles.WORD, dictionary.FREE).otherwise(F.col("tagtype")).alias("tagtype"), F.lit(False).alias("is_global"))
    part = roles.table(spark, folder, "part")
    nouns = part.select(F.element_at(F.split("p_name", " "), -1).alias("name"), F.lit(4).alias("tagtype"), F.lit(None).cast("long").alias("user_id"))
    brands = part.select(F.col("p_brand").alias("name"), F.lit(roles.BRAND).alias("tagtype"), F.lit(None).cast("long").alias("user_id"))
    nations = roles.table(spark, folder, "nation").select(F.col("n_name").alias("name"), F.lit(dictionary.FREE).alias("tagtype"), F.col("n_nationkey").cast("long").alias("user_id"))
    owners = spark.createDataFrame([], "normalized_name string, tagtype int, user_id long")
    once = dictionary.assert_tags(tags, owners, nouns.union(brands).union(nations).distinct())
    owned = once.owners.groupBy("normalized_name", "tagtype").agg(F.count("*").alias("owners"))
    status = once.changes.groupBy("normalized_name", "tagtype").agg(F.max("action").alias("action"))
    return once.tags.join(owned, ["normalized_name", "tagtype"], "left").join(status, ["normalized_name", "tagtype"], "left").select("normalized_name", "tagtype", "is_global", F.coalesce("owners", F.lit(0)).alias("owners"), F.coalesce("action", F.lit("kept")).alias("action"))


def account_bins(spark: SparkSession, folder: str) -> DataFrame:
    """TXT-9: for every customer the supplier's balance that is next below (or equal to) their own."""
    customers = roles.table(spark, folder, "customer").select("c_custkey", "c_acctbal")
    return bins.bin_of_each(customers, "c_acctbal", roles.table(spark, folder, "supplier"), "s_acctbal")


def props_nested(spark: SparkSession, folder: str) -> DataFrame:
    """NEST-1, TXT-8: properties of all events as variants: a typed value, and what stands under a key anywhere, malformed ones null."""
    events = roles.table(spark, folder, "events").select("event_id", "event_type", "props")
    # errors hold their properties within another object; views' texts are cut short
    whole = F.when(F.col("event_type") == "error", F.concat(F.lit('{"error": {"of": ['), "props", F.lit(', {"k": "x"}]}}'))).when(F.col("event_type") == "view", F.expr("left(props, length(props) - 1)")).otherwise(F.col("props"))
    v = nested.parsed(whole)
    docs = events.select("event_id", whole.alias("doc"), F.coalesce(nested.value_at(v, "$.k", "long"), nested.value_at(v, "$.error.of[0].k", "long")).alias("k"))
    found = nested.collect_key(docs, "event_id", "doc", "k", also=("k",))
    return found.select("event_id", "k", F.array_join("vals", ",").alias("vals"))


def site_crawl(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-8: the pages that a crawl of each site visits, ten at most, from its first page on."""
    pages = roles.table(spark, folder, "pages").select("page_id", "url", "html")
    found = elements.nodes(pages, also=("url",)).filter("name = 'a'").withColumn("href", elements.attribute("href")).filter("href <> ''")
    links = found.select("url", F.col("n").alias("place"), resolve(F.col("url"), F.col("href")).alias("target"))
    starts = pages.groupBy(domain_from_url(F.col("url")).alias("site")).agg(F.min("url").alias("url"))
    return crawl.crawl(links, starts)


QUERIES = {f.__name__: f for f in (search_kept, search_ids, tag_upsert, account_bins, props_nested, site_crawl)}

_R = roles.with_roles


def _kept_sql() -> str:
    parts, query = plan._found_sql(["small", "ring"])
    ranked = f"SELECT CAST(row_number() OVER (ORDER BY score DESC, entity_id) AS INTEGER) AS rank, *, count(*) OVER () AS full_size FROM ({query})"
    return _R("parts", "pointers", "taggings", "tags", "expressions", then=parts, query=f"SELECT * FROM ({ranked}) WHERE rank BETWEEN 6 AND 15")


ORACLE_SQL = {
    "search_kept": _kept_sql(),
    "search_ids": plan._search_sql(["red", "small", "ring"], 0, 10),
    "tag_upsert": _R("tags", then="""before AS (SELECT normalized_name, CASE tagtype WHEN 3 THEN 0 ELSE tagtype END AS tagtype FROM tags),
nouns AS (SELECT DISTINCT lower(string_split(p_name, ' ')[-1]) AS n FROM part), brands AS (SELECT DISTINCT normalized_name AS n FROM tags WHERE tagtype = 1), nations AS (SELECT DISTINCT lower(replace(n_name, ' ', '-')) AS n, n_nationkey FROM nation),
moved AS (SELECT n FROM nouns WHERE n IN (SELECT normalized_name FROM before WHERE tagtype = 0) AND n NOT IN (SELECT normalized_name FROM before WHERE tagtype = 4)),
after AS (SELECT normalized_name, CASE WHEN tagtype = 0 AND normalized_name IN (SELECT n FROM moved) THEN 4 ELSE tagtype END AS tagtype FROM before)""",
        query="""SELECT normalized_name, tagtype, CASE tagtype WHEN 4 THEN normalized_name IN (SELECT n FROM nouns) WHEN 1 THEN true ELSE false END AS is_global, 0 AS owners,
  CASE tagtype WHEN 4 THEN CASE WHEN normalized_name IN (SELECT n FROM moved) THEN 'retyped' ELSE 'there' END WHEN 1 THEN 'there' ELSE 'kept' END AS action FROM after
UNION ALL SELECT n, 4, true, 0, 'added' FROM nouns WHERE n NOT IN (SELECT normalized_name FROM after WHERE tagtype = 4)
UNION ALL SELECT n, 0, false, count(*), 'added' FROM nations GROUP BY n"""),
    "account_bins": "SELECT c_custkey, c_acctbal, b AS bin FROM customer ASOF LEFT JOIN (SELECT DISTINCT s_acctbal AS b FROM supplier) ON c_acctbal >= b",
    "props_nested": """SELECT event_id, CASE event_type WHEN 'view' THEN NULL ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS k,
  CASE event_type WHEN 'view' THEN NULL WHEN 'error' THEN json_extract_string(props, '$.k') || ',"x"' ELSE json_extract_string(props, '$.k') END AS vals FROM events""",
    "site_crawl": _R("page_refs", query=r"""SELECT site, url, CAST(nth AS INTEGER) AS nth, CASE nth WHEN 1 THEN 0 ELSE 1 END AS step FROM (
  SELECT site, url, row_number() OVER (PARTITION BY site ORDER BY place) AS nth FROM (
    SELECT site, url, min(place) AS place FROM (
      SELECT domain AS site, min(url) AS url, -1 AS place FROM page_refs GROUP BY domain
      UNION ALL SELECT site, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || links[i], i FROM (
        SELECT p.site, p.url, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS links FROM (SELECT domain AS site, min(url) AS url FROM page_refs GROUP BY domain) p JOIN pages USING (url)), LATERAL (SELECT unnest(range(1, len(links) + 1)) AS i))
    GROUP BY site, url)) WHERE nth <= 10"""),
}
