"""Queries of page extraction, annotation, feeds and files, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import domain_from_url
from ..operators import annotate, extract
from ..sources import files, roles
from ..streaming import feeds

NOW = "2024-03-01 00:00:00"


def page_values(spark: SparkSession, folder: str) -> DataFrame:
    """EXT-1..5, SRC-4: what the finders find on every page, headings besides."""
    return extract.glean(roles.table(spark, folder, "pages"), [*extract.FINDERS, ("Heading", "h1", ""), ("Menu", "nav li a", "href")])


def page_attributes(spark: SparkSession, folder: str) -> DataFrame:
    """EXT-6, EXT-7: a row of attributes for every page."""
    pages = roles.table(spark, folder, "pages")
    found = extract.adopt(extract.glean(pages), pages.select("page_id", "url"))
    return found.withColumn("feeds", F.array_join("feeds", " "))


#: Finders of sites of their own, before those of all sites: (site, label, selector, attribute).
OWN = [("spam-farm.example.org", "Title", "article h1", ""), ("spam-farm.example.org", "Heading", "h1", ""), ("nowhere.example", "Title", "b", "")]


def page_finders(spark: SparkSession, folder: str) -> DataFrame:
    """EXT-3, EXT-8: titles by the finders of each page's site and those of all sites; votes for finders whose value is what the page's title says."""
    pages = roles.table(spark, folder, "pages")
    found = files.stored(extract.found_by(pages, extract.finder_set(OWN, only=["Title"]), domain_from_url(F.col("url"))), "found-values")
    accepted = extract.glean(pages, [("Title", "title", "")]).select("page_id", "label", "value")
    votes = extract.finder_votes(found, accepted)
    every = found.groupBy("site", "label", "selector", "attribute").agg(F.count("*").alias("values"))
    return every.join(votes, ["site", "label", "selector", "attribute"], "left").select("site", "label", "selector", "attribute", "values", F.coalesce("hits", F.lit(0)).alias("hits"))


def page_links(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-8, EXT-13: links of every page, and how many might be feeds."""
    pages = roles.table(spark, folder, "pages")
    return extract.links(pages).groupBy("page_id").agg(F.count("*").alias("links"), F.count_if(F.lower("link").rlike("rss|feedburner|atom")).alias("feeds"))


def phrase_matches(spark: SparkSession, folder: str) -> DataFrame:
    """LEX-1..3: the longest phrases of a lexicon of all part names and their words, in each name and its words turned round."""
    part = roles.table(spark, folder, "part")
    words = part.select(F.explode(F.split("p_name", " ")).alias("name")).union(part.select("p_name")).distinct().withColumn("tag", F.col("name"))
    turned = F.array_join(F.reverse(F.split("p_name", " ")), " ")
    found = annotate.tokens(part, "p_partkey", F.concat(F.lit("a "), "p_name", F.lit(", "), turned))
    return annotate.phrases(found, "p_partkey", annotate.lexicon(words)).select("p_partkey", "pos", "words", F.array_join("tags", ",").alias("tags"))


def phrase_lists(spark: SparkSession, folder: str) -> DataFrame:
    """LEX-4: lists of part names: each part's own, the next one's noun, which shares the first one's adjective, and a whole third."""
    part = roles.table(spark, folder, "part").select("p_partkey", "p_name")
    names = part.select(F.col("p_name").alias("name"), F.col("p_name").alias("tag")).distinct()
    second = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.element_at(F.split("p_name", " "), -1).alias("noun"))
    third = part.select((F.col("p_partkey") - 2).alias("p_partkey"), F.col("p_name").alias("other"))
    text = F.concat("p_name", F.lit(", "), "noun", F.lit(" and "), "other")
    found = annotate.phrase_lists(annotate.tokens(part.join(second.hint("merge"), "p_partkey").join(third.hint("merge"), "p_partkey"), "p_partkey", text), "p_partkey", annotate.lexicon(names))
    return found.select("p_partkey", "list", "nth", "pos", "words", F.array_join("tags", ",").alias("tags"))


def amounts(spark: SparkSession, folder: str) -> DataFrame:
    """PRS-8..10, NUM-2: numbers and units in texts."""
    part = roles.table(spark, folder, "part")
    units = annotate.lexicon(spark.createDataFrame([("cup", "cup"), ("fluid ounces", "ounce"), ("head", "head")], "name string, tag string"))
    n = F.col("p_partkey") % 4
    size = F.col("p_size").cast("string")
    text = F.when(n == 0, F.concat(size, F.lit(" 1/2 cup of "), "p_name")).when(n == 1, F.concat(F.lit("two fluid ounces "), "p_name")).when(n == 2, F.concat(size, F.lit(" small head"))).otherwise(F.concat(F.lit("some "), "p_name"))
    return annotate.amounts(annotate.tokens(part, "p_partkey", text), "p_partkey", units)


def feed_ingest(spark: SparkSession, folder: str) -> DataFrame:
    """STM-1..3, STM-9: entries of a second delivery added to the first; times missing or ahead made sensible."""
    entries = roles.feed_entries(spark, folder)
    known = entries.filter("guid < 2")
    again = entries.unionByName(entries.filter("guid = 2"))
    odd = again.withColumn("published_at", F.when(F.col("guid") % 3 == 0, None).otherwise(F.col("published_at")))
    return feeds.high_water(feeds.timed(feeds.fresh(odd, known), F.lit(NOW).cast("timestamp_ntz")))


def feed_ingest_stream(spark: SparkSession, folder: str) -> DataFrame:
    """STM-4, SRC-5: the conversations' files as a stream, read to their end into a table."""
    schema = roles.table(spark, folder, "conversations").schema
    raw = spark.readStream.schema(schema).parquet(f"{folder}/conversations.parque*")
    at = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.col("conv_id").cast("int"), F.col("turn").cast("int"))
    stream = raw.select(F.col("conv_id").alias("feed_id"), F.col("turn").alias("guid"), F.col("text").alias("title"), at.alias("published_at"))
    target, checkpoint = files.shared_path(spark, "feed-entries"), files.shared_path(spark, "feed-checkpoint")
    feeds.ingest(stream, target, checkpoint, NOW).awaitTermination()
    return feeds.high_water(feeds.ingested(spark, stream.schema, target))


def settings_merge(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-9, SRC-10: settings exported, and imported over others."""
    part = roles.table(spark, folder, "part").select("p_partkey", "p_name", "p_size")
    path = files.shared_path(spark, "settings")
    files.export_settings(part.filter("p_size > 25").withColumn("p_name", F.upper("p_name")), path, "p_partkey")
    return files.import_settings(part.filter("p_partkey % 2 = 0"), path, "p_partkey")


QUERIES = {f.__name__: f for f in (page_values, page_attributes, page_finders, page_links, phrase_matches, phrase_lists, amounts, feed_ingest, feed_ingest_stream, settings_merge)}

_CLEAN = "trim(regexp_replace(regexp_extract(html, '(?is){}', 1), '\\s+', ' ', 'g'))"
ORACLE_SQL = {
    "page_finders": roles.with_roles("page_refs", then=f"t AS (SELECT domain AS site, {_CLEAN.format('<title>(.*?)</title>')} AS title, {_CLEAN.format('<h1>(.*?)</h1>')} AS heading FROM page_refs JOIN pages USING (page_id))",
        query="""SELECT site, 'Title' AS label, 'title' AS selector, '' AS attribute, count(*) AS values, count(*) AS hits FROM t WHERE title <> '' GROUP BY site
UNION ALL SELECT site, 'Title', 'article h1', '', count(*), count(*) FILTER (heading = title) FROM t WHERE site = 'spam-farm.example.org' AND heading <> '' GROUP BY site"""),
    "phrase_matches": """WITH w AS (SELECT p_partkey, p_name, string_split(p_name, ' ') AS s, array_to_string(list_reverse(string_split(p_name, ' ')), ' ') AS turned FROM part),
k AS (SELECT *, turned IN (SELECT p_name FROM part) AS one FROM w)
SELECT p_partkey, CAST(1 AS INTEGER) AS pos, CAST(len(s) AS INTEGER) AS words, p_name AS tags FROM w
UNION ALL SELECT p_partkey, CAST(2 + len(s) AS INTEGER), CAST(len(s) AS INTEGER), turned FROM k WHERE one
UNION ALL SELECT p_partkey, CAST(1 + len(s) + i AS INTEGER), 1, s[len(s) + 1 - i] FROM k, (SELECT unnest(range(1, 9)) AS i) WHERE NOT one AND i <= len(s)""",
    "phrase_lists": """WITH j AS (SELECT a.p_partkey, a.p_name AS one, string_split(a.p_name, ' ')[1] || ' ' || string_split(b.p_name, ' ')[2] AS two, c.p_name AS three
  FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1 JOIN part c ON c.p_partkey = a.p_partkey + 2),
i AS (SELECT *, two IN (SELECT p_name FROM part) AS shared FROM j)
SELECT p_partkey, 0 AS list, 1 AS nth, 0 AS pos, 2 AS words, one AS tags FROM i
UNION ALL SELECT p_partkey, 0, 2, 3, 1, two FROM i WHERE shared
UNION ALL SELECT p_partkey, CASE WHEN shared THEN 0 ELSE 5 END, CASE WHEN shared THEN 3 ELSE 1 END, 5, 2, three FROM i""",
    "amounts": """SELECT p_partkey, 0 AS pos, CASE p_partkey % 4 WHEN 0 THEN 3 ELSE 3 END AS words, CASE p_partkey % 4 WHEN 0 THEN p_size + 0.5 WHEN 1 THEN 2.0 ELSE CAST(p_size AS DOUBLE) END AS value,
  CASE p_partkey % 4 WHEN 0 THEN 'cup' WHEN 1 THEN 'ounce' ELSE 'head' END AS unit FROM part WHERE p_partkey % 4 < 3""",
    "feed_ingest": roles.with_roles("feed_entries", query=f"""SELECT feed_id, max(CASE WHEN guid % 3 = 0 OR published_at > TIMESTAMP '{NOW}' THEN TIMESTAMP '{NOW}' ELSE published_at END) AS last_post, count(*) AS entries
  FROM feed_entries WHERE guid >= 2 GROUP BY feed_id"""),
    "feed_ingest_stream": roles.with_roles("feed_entries", query=f"SELECT feed_id, max(least(published_at, TIMESTAMP '{NOW}')) AS last_post, count(*) AS entries FROM feed_entries GROUP BY feed_id"),
    "settings_merge": "SELECT p_partkey, CASE WHEN p_size > 25 THEN upper(p_name) ELSE p_name END AS p_name, p_size FROM part WHERE p_size > 25 OR p_partkey % 2 = 0",
}
