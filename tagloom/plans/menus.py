"""Queries of users' menus and cards, tri-state and staleness filters, and lines of ingredients, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import annotate, lists, scopes
from ..sources import roles
from ..streaming import feeds
from . import collections as c

#: Now, for what is stale, and what a collection time is set to.
NOW = "2024-03-01 00:00:00"


def _feeds(spark: SparkSession, folder: str) -> DataFrame:
    """Feeds with their latest post and whether they are approved: those in which an assistant takes part."""
    turns = roles.table(spark, folder, "conversations").select(F.col("conv_id").alias("feed_id"), F.col("turn").alias("guid"), "role")
    entries = roles.feed_entries(spark, folder).select("feed_id", "guid", "published_at")
    return entries.join(turns, ["feed_id", "guid"]).groupBy("feed_id").agg(F.max("published_at").alias("last_post"), F.bool_or(F.col("role") == "assistant").alias("approved"))


def my_feeds(spark: SparkSession, folder: str) -> DataFrame:
    """COL-26: the viewer's feeds that are approved, those with the latest posts first, sixteen at most. Pointers' ids stand for feeds."""
    mine = lists.collection(roles.pointers(spark, folder), c.USER, c.USER).select(F.col("entity_id").alias("feed_id"))
    found = _feeds(spark, folder).filter("approved").join(mine, "feed_id", "left_semi")
    return found.orderBy(F.desc_nulls_last("last_post"), "feed_id").limit(16).select("feed_id", "last_post")


def my_lists(spark: SparkSession, folder: str) -> DataFrame:
    """COL-27: the viewer's lists with the names of their tags, sixteen at most."""
    tags = roles.tags(spark, folder).groupBy(F.col("tag").alias("name_tag")).agg(F.min("name").alias("name"))
    own = c._lists(spark, folder).filter(F.col("owner_id") == c.VIEWER)
    return own.join(tags, "name_tag", "left").orderBy(F.asc_nulls_last("name"), "list_id").limit(16).select("list_id", "name")


def latest_of_users(spark: SparkSession, folder: str) -> DataFrame:
    """COL-28: each user's latest part, and latest list, that the viewer may see."""
    pointers = roles.pointers(spark, folder)
    shown = pointers.filter(F.col("in_collection") & (~F.col("private") | (F.col("user_id") == c.VIEWER)))
    part = shown.groupBy("user_id").agg(F.max_by("entity_id", F.struct("created_at", "entity_id")).alias("part"))
    visible = lists.visible_lists(c._lists(spark, folder), c._follows(pointers), c.VIEWER)
    some = visible.groupBy(F.col("owner_id").alias("user_id")).agg(F.max("list_id").alias("list"))
    return roles.users(spark, folder).select("user_id").join(part, "user_id", "left").join(some, "user_id", "left").filter("part IS NOT NULL OR list IS NOT NULL")


def collected_again(spark: SparkSession, folder: str) -> DataFrame:
    """COL-20: pointers after all of them were collected: those that weren't before have a new collection time."""
    pointers = roles.pointers(spark, folder).filter(F.col("user_id") == c.USER)
    return lists.collect(pointers, F.lit(NOW).cast("timestamp_ntz")).select("entity_id", "in_collection", F.col("created_at").cast("timestamp_ntz").alias("created_at"))


def invitations(spark: SparkSession, folder: str) -> DataFrame:
    """AGG-20: per user the invitations sent, those accepted, and the size of the collection."""
    e = roles.table(spark, folder, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("invites"), F.count_if(F.col("event_type") == "signup").alias("accepted"))
    p = roles.pointers(spark, folder).groupBy("user_id").agg(F.count_if("in_collection").alias("collected"))
    joined = roles.users(spark, folder).select("user_id").join(e, "user_id", "left").join(p, "user_id", "left")
    return joined.select("user_id", *[F.coalesce(n, F.lit(0)).alias(n) for n in ("invites", "accepted", "collected")])


def ever_signed_in(spark: SparkSession, folder: str) -> DataFrame:
    """FLT-15: users who ever signed in."""
    logins = roles.table(spark, folder, "events").filter("event_type = 'view'")
    return roles.users(spark, folder).join(logins, "user_id", "left_semi").select("user_id")


def reachable(spark: SparkSession, folder: str) -> DataFrame:
    """FLT-23: orders by a state that is true, false or unknown, each asked for. Filled ones are reachable, open ones aren't."""
    o = roles.table(spark, folder, "orders")
    state = F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "O", False)
    return o.agg(*[F.count_if(scopes.tri_state(state, wanted)).alias(name) for name, wanted in (("good", True), ("bad", False), ("unknown", None))])


def stale_feeds(spark: SparkSession, folder: str) -> DataFrame:
    """FLT-24: feeds without a post in the last seven days."""
    return feeds.stale(_feeds(spark, folder), F.lit(NOW).cast("timestamp_ntz")).select("feed_id")


def newest_sites(spark: SparkSession, folder: str) -> DataFrame:
    """SORT-7: approved sites, newest first. A site is as new as its latest page, and approved if it has several."""
    found = roles.page_refs(spark, folder).filter("domain <> ''").groupBy("domain").agg(F.max("page_id").alias("newest"), F.count("*").alias("pages"))
    return found.filter("pages > 1").orderBy(F.desc("newest"), "domain").limit(20).select("domain", "newest")


def last_sort_key(spark: SparkSession, folder: str) -> DataFrame:
    """AGG-4: per entity the sort key that came last, of all pointers to it."""
    return roles.pointers(spark, folder).groupBy("entity_id").agg(F.max_by("comment", F.struct("updated_at", -F.col("user_id"))).alias("sort_key"))


def number_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """PRS-8: ranges of numbers in texts."""
    part = roles.table(spark, folder, "part")
    size = F.col("p_size").cast("string")
    text = F.concat(F.lit("about "), size, F.when(F.col("p_size") % 2 == 0, " to ").otherwise(" - "), (F.col("p_size") + 2).cast("string"), F.lit(" cups"))
    return annotate.ranges(annotate.tokens(part, "p_partkey", text), "p_partkey").select("p_partkey", "pos", "words", "low", "high")


def ingredients(spark: SparkSession, folder: str) -> DataFrame:
    """PRS-8, PRS-9: lines made of an amount, a part's name and a comment."""
    part = roles.table(spark, folder, "part").select("p_partkey", F.concat(F.col("p_size").cast("string"), F.lit(" 1/2 cups "), "p_name", F.lit(", finely chopped")).alias("line"), "p_name")
    units = annotate.lexicon(spark.createDataFrame([("cup", "cup"), ("cups", "cup")], "name string, tag string"))
    names = annotate.lexicon(part.select(F.col("p_name").alias("name"), F.col("p_name").alias("tag")).distinct())
    found = annotate.ingredient_lines(part, "p_partkey", F.col("line"), units, names)
    return found.select("p_partkey", "value", "unit", F.array_join("ingredients", "; ").alias("ingredients"), "comment")


QUERIES = {
    f.__name__: f
    for f in (my_feeds, my_lists, latest_of_users, collected_again, invitations, ever_signed_in, reachable, stale_feeds, newest_sites, last_sort_key, number_ranges, ingredients)
}

_R = roles.with_roles
_FEEDS = """feeds AS (SELECT feed_id, max(published_at) AS last_post, bool_or(role = 'assistant') AS approved FROM feed_entries JOIN conversations ON conv_id = feed_id AND turn = guid GROUP BY feed_id)"""
ORACLE_SQL = {
    "my_feeds": _R("feed_entries", "pointers", then=_FEEDS, query="""SELECT feed_id, last_post FROM feeds WHERE approved AND feed_id IN (SELECT entity_id FROM pointers WHERE user_id = 7 AND in_collection)
  ORDER BY last_post DESC NULLS LAST, feed_id LIMIT 16"""),
    "my_lists": _R("tags", then=c._LISTS, query="""SELECT list_id, name FROM lists LEFT JOIN (SELECT tag, min(name) AS name FROM tags GROUP BY tag) ON tag = name_tag WHERE owner_id = 11 ORDER BY name NULLS LAST, list_id LIMIT 16"""),
    "latest_of_users": _R("users", "pointers", then=f"{c._FOLLOWS}, {c._LISTS}", query="""SELECT u.user_id, part, list FROM users u
  LEFT JOIN (SELECT user_id, arg_max(entity_id, (created_at, entity_id)) AS part FROM pointers WHERE in_collection AND (NOT private OR user_id = 11) GROUP BY user_id) p ON p.user_id = u.user_id
  LEFT JOIN (SELECT owner_id, max(list_id) AS list FROM lists WHERE owner_id = 11 OR availability = 0 OR (availability = 1 AND owner_id IN (SELECT followee FROM follows WHERE follower = 11)) GROUP BY owner_id) l ON l.owner_id = u.user_id
  WHERE part IS NOT NULL OR list IS NOT NULL"""),
    "collected_again": _R("pointers", query=f"SELECT entity_id, true AS in_collection, CASE WHEN in_collection THEN CAST(created_at AS TIMESTAMP) ELSE TIMESTAMP '{NOW}' END AS created_at FROM pointers WHERE user_id = 7"),
    "invitations": _R("users", "pointers", query="""SELECT u.user_id, coalesce(invites, 0) AS invites, coalesce(accepted, 0) AS accepted, coalesce(collected, 0) AS collected FROM users u
  LEFT JOIN (SELECT user_id, count(*) FILTER (event_type = 'click') AS invites, count(*) FILTER (event_type = 'signup') AS accepted FROM events GROUP BY user_id) e ON e.user_id = u.user_id
  LEFT JOIN (SELECT user_id, count(*) FILTER (in_collection) AS collected FROM pointers GROUP BY user_id) p ON p.user_id = u.user_id"""),
    "ever_signed_in": _R("users", query="SELECT user_id FROM users WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'view')"),
    "reachable": "SELECT count(*) FILTER (o_orderstatus = 'F') AS good, count(*) FILTER (o_orderstatus = 'O') AS bad, count(*) FILTER (o_orderstatus NOT IN ('F', 'O') OR o_orderstatus IS NULL) AS unknown FROM orders",
    "stale_feeds": _R("feed_entries", then=_FEEDS, query=f"SELECT feed_id FROM feeds WHERE last_post IS NULL OR last_post < TIMESTAMP '{NOW}' - INTERVAL 7 DAYS"),
    "newest_sites": _R("page_refs", query="SELECT domain, max(page_id) AS newest FROM page_refs WHERE domain <> '' GROUP BY domain HAVING count(*) > 1 ORDER BY newest DESC, domain LIMIT 20"),
    "last_sort_key": _R("pointers", query="SELECT entity_id, comment AS sort_key FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY updated_at DESC, user_id) AS n FROM pointers) WHERE n = 1"),
    "number_ranges": "SELECT p_partkey, CAST(1 AS INTEGER) AS pos, CAST(3 AS INTEGER) AS words, CAST(p_size AS DOUBLE) AS low, CAST(p_size + 2 AS DOUBLE) AS high FROM part",
    "ingredients": "SELECT p_partkey, p_size + 0.5 AS value, 'cup' AS unit, p_name AS ingredients, 'finely chopped' AS comment FROM part",
}
