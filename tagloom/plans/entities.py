"""Queries of declared scopes, result classes, names, dictionary upkeep and jobs, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as s
from ..operators import lists, nested, scopes
from ..operators.scopes import Match
from ..sources import files, roles
from . import collections as c


def _sites(source) -> DataFrame:
    """Hosts, with the labels of their names for tags: site, word."""
    return roles.page_refs(*source).select(F.col("domain").alias("site"), F.explode(F.split("domain", r"\.")).alias("word")).distinct()


def _feeds(source) -> DataFrame:
    """Entries with the site that their feed belongs to (the page of the feed's number)."""
    pages = roles.page_refs(*source).select(F.col("page_id").alias("feed_id"), "domain")
    return roles.feed_entries(*source).join(pages, "feed_id", "left")


#: What a string is looked for in, by entity type.
SPECS = [
    Match("Part", "title or description", lambda x: roles.parts(*x), "entity_id", ("title", "description")),
    Match("Part", "tags", lambda x: roles.part_tags(*x), "entity_id", ("name",)),
    Match("PageRef", "domain", lambda x: roles.page_refs(*x), "page_id", ("domain",)),
    Match("Site", "root", _sites, "site", ("site",)),
    Match("Site", "tag", _sites, "site", ("word",)),
    Match("Feed", "title", lambda x: roles.feed_entries(*x), "feed_id", ("title",)),
    Match("Feed", "site", _feeds, "feed_id", ("domain",)),
    Match("User", "username", lambda x: roles.users(*x), "user_id", ("username",)),
    Match("User", "about", lambda x: roles.users(*x), "user_id", ("about",)),
    Match("List", "name tag", lambda x: c._lists(*x), "list_id", ("name_tag",)),
    Match("Tag", "normalized_name", lambda x: roles.tags(*x), "tag", ("normalized_name",)),
    Match("Referent", "tags", lambda x: roles.expressions(*x), "referent", ("tag",)),
]


def string_scopes(spark: SparkSession, folder: str) -> DataFrame:
    """STR-1..10, JOIN-12, JOIN-24, FLT-7: one string in every scope of every entity type."""
    return scopes.match(SPECS, (spark, folder), "re")


def result_classes(spark: SparkSession, folder: str) -> DataFrame:
    """SRCH-12, SRCH-13, SRCH-18, AGG-1, SRC-1..3 and the table of result classes: how many rows each kind of result has."""
    pointers, users = roles.pointers(spark, folder), roles.users(spark, folder)
    some, follows, entries = c._lists(spark, folder), c._follows(pointers), roles.feed_entries(spark, folder)
    friends = lists.followees(follows, c.VIEWER)
    shown = {
        "search_index": roles.parts(spark, folder),
        "users_collection": lists.collection(pointers, c.USER, c.VIEWER),
        "users_recent": lists.collection(pointers, c.USER, c.USER, collected_only=False),
        "users_biglist": pointers.filter("NOT private"),
        "lists_index": lists.visible_lists(some, follows, c.VIEWER),
        "lists_owned": some.filter(F.col("owner_id") == c.VIEWER),
        "users_index": users,
        "users_followed": users.join(friends, "user_id", "left_semi"),
        "users_relevant": users.filter(F.col("user_id") != c.VIEWER).join(friends, "user_id", "left_anti"),
        "tags_index": roles.tags(spark, folder).filter("tagtype = 3"),
        "tags_associated": roles.taggings(spark, folder).filter("tag = '3:blue'"),
        "feeds_index": entries.select("feed_id").distinct(),
        "feeds_show": entries.filter("feed_id = 3"),
        "sites_index": roles.page_refs(spark, folder).select("domain").distinct(),
        "integers": spark.range(31),
    }
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("rows")).select(F.lit(k).alias("class"), "rows") for k, df in shown.items()])


def optional_clauses(spark: SparkSession, folder: str) -> DataFrame:
    """FLT-13, FLT-14, FLT-17, FLT-18, FLT-21, FLT-22, JOIN-7: only the constraints that are given."""
    t = roles.taggings(spark, folder)
    asked = [{"tag": "3:red", "user_id": None}, {"tag": ["3:red", "3:blue"], "user_id": c.USER}, {"tagtype": 2, "user_id": [1, 2, 3]}, {}]
    return reduce(DataFrame.unionByName, [scopes.where(t, **a).agg(F.count("*").alias("taggings"), F.count_distinct("entity_id").alias("entities")).withColumn("n", F.lit(i)) for i, a in enumerate(asked)])


def exists_tagging(spark: SparkSession, folder: str) -> DataFrame:
    """JOIN-5, JOIN-10, JOIN-23, COL-8: parts with a tagging by any of some users under any of some tags."""
    wanted = roles.taggings(spark, folder).filter(F.col("tag").isin("3:red", "2:small") & F.col("user_id").isin(1, 5, 7, 9))
    return roles.parts(spark, folder).join(wanted, "entity_id", "left_semi").select("entity_id")


def people(spark: SparkSession, folder: str) -> DataFrame:
    """COL-24, COL-25, COL-30, COL-33, FLT-16: names and addresses of users."""
    n = F.col("user_id").cast("string")
    address = F.when(F.col("user_id") % 3 == 0, F.concat(F.col("username"), F.lit(" <U"), n, F.lit("@x.org>"))).when(F.col("user_id") % 3 == 1, F.concat(F.lit("u"), n, F.lit("@x.org"))).otherwise(F.lit("nobody"))
    parts = s.name_parts(address)
    full = F.concat(F.lit("Ann B "), F.lower("about"))
    return roles.users(spark, folder).select(
        "user_id", parts["name"].alias("name"), parts["email"].alias("email"), s.first_and_last(full)["last"].alias("last"), s.handle(F.lit(" "), parts["name"], parts["email"]).alias("handle"),
        F.coalesce(full.rlike("(?i)\\bbuild"), F.lit(False)).alias("matches"),
    )


def ratings(spark: SparkSession, folder: str) -> DataFrame:
    """COL-22, TXT-16: ratings in words."""
    value = (F.col("p_size") % 9).cast("int") - 4
    return roles.table(spark, folder, "part").select("p_partkey", s.rating_text(value, "bland", "spicy").alias("rating"))


def tag_sets(spark: SparkSession, folder: str) -> DataFrame:
    """COL-23, SET-3, SET-5: of a part's tags, how many one user may edit, and how many are locked."""
    on = roles.tagged(spark, folder, mine=F.bool_or(F.col("user_id") == c.USER))
    return on.groupBy("entity_id").agg(F.count("*").alias("visible"), F.count_if("mine").alias("editable"), F.count_if(~F.col("mine")).alias("locked"))


def tag_assert(spark: SparkSession, folder: str) -> DataFrame:
    """TAG-7, TAG-8, TAG-13, COL-16: asserted names: those that exist as words take the asserted type, others are added; global if a public list uses them."""
    asserted = spark.createDataFrame([("red", 4), ("ring", 4), ("saffron", 4), ("brand-3", 1)], "normalized_name string, wanted int")
    tags = roles.tags(spark, folder).select("normalized_name", "tagtype")
    joined = asserted.join(tags, "normalized_name", "left").groupBy("normalized_name", "wanted").agg(F.collect_set("tagtype").alias("types"))
    status = F.when(F.array_contains("types", F.col("wanted")), "there").when(F.array_contains("types", F.lit(3)), "retyped").otherwise("added")
    public = c._lists(spark, folder).groupBy(F.col("name_tag").alias("tag")).agg(F.bool_or(F.col("availability") != lists.PRIVATE).alias("is_global"))
    named = joined.withColumn("tag", F.concat_ws(":", "wanted", "normalized_name")).join(public, "tag", "left")
    return named.select("tag", status.alias("status"), F.coalesce("is_global", F.lit(False)).alias("is_global"))


def tag_aliases(spark: SparkSession, folder: str) -> DataFrame:
    """TAG-9: singular and plural of every word."""
    w = F.col("normalized_name")
    return roles.tags(spark, folder).filter("tagtype = 3").select("tag", s.plural(w).alias("plural"), s.singular(s.plural(w)).alias("singular"))


def expression_choice(spark: SparkSession, folder: str) -> DataFrame:
    """GRF-14, GRF-17, GRF-18: the tag that expresses a concept in a form and locale, else in the generic form, else any."""
    e = roles.expressions(spark, folder).withColumn("form", (F.length("tag") % 3).cast("int")).withColumn("locale", F.when(F.length("tag") % 2 == 0, "en"))
    found = scopes.preferred(e, "referent", [(F.col("form") == 2) & (F.col("locale") == "en"), F.col("form") == 1], "tag")
    return found.select("referent", "tag")


def type_audit(spark: SparkSession, folder: str) -> DataFrame:
    """GRF-19, JOIN-15: words that are also names of another type, with what they express."""
    other = roles.tags(spark, folder).filter("tagtype <> 3").select("normalized_name", "tagtype")
    word = F.regexp_replace("tag", "^3:", "")
    return roles.expressions(spark, folder).withColumn("normalized_name", word).join(other, "normalized_name").groupBy("normalized_name", "tagtype").agg(F.count("*").alias("referents"))


def questions(spark: SparkSession, folder: str) -> DataFrame:
    """COL-29: the first question that a user hasn't answered, else the first of all. Event types stand for questions."""
    e = roles.table(spark, folder, "events").select("user_id", "event_type")
    types = e.agg(F.collect_set("event_type").alias("asked"))  # one row
    answered = e.groupBy("user_id").agg(F.collect_set(F.when(F.col("event_type") != "view", F.col("event_type"))).alias("answered"))
    return answered.crossJoin(F.broadcast(types)).select("user_id", F.coalesce(F.array_min(F.array_except("asked", "answered")), F.array_min("asked")).alias("question"))


def jobs(spark: SparkSession, folder: str) -> DataFrame:
    """STM-6: what a launch and a landing make of jobs' states."""
    status = F.when(F.col("event_type") == "view", scopes.VIRGIN).when(F.col("event_type") == "click", scopes.PROCESSING).when(F.col("event_type") == "error", scopes.BAD).otherwise(scopes.GOOD)
    error = F.when(F.col("value") > 20, "failed")
    e = roles.table(spark, folder, "events")
    return e.groupBy(scopes.launched(status).alias("launched"), scopes.landed(scopes.launched(status), error).alias("landed")).agg(F.count("*").alias("jobs"))


def newsletter(spark: SparkSession, folder: str) -> DataFrame:
    """STM-11, AGG-10: letters to users behind the edition of their segment, five seconds apart in each."""
    latest = roles.table(spark, folder, "events").groupBy("user_id").agg(F.max("event_id").alias("read"))
    users = roles.users(spark, folder).join(latest, "user_id", "left")
    edition = users.groupBy("about").agg(F.max("read").alias("edition"))
    behind = users.join(edition, "about").filter("edition IS NOT NULL AND (read IS NULL OR read < edition)").select("user_id", "about")
    ranked = scopes.ranked(behind.withColumn("lane", F.col("user_id") % 16), ["about", "lane"], ["user_id"], files.shared_path(spark, "ranked"))
    return ranked.select("user_id", (F.col("rank") * 5).cast("int").alias("delay"))


def entity_decode(spark: SparkSession, folder: str) -> DataFrame:
    """TXT-17, TXT-8: titles with their character references decoded; values under a key of JSON documents."""
    title = F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1)
    doc = F.to_json(F.struct(F.struct(F.col("page_id").alias("k")).alias("a"), F.array(F.struct(F.lit("x").alias("k"))).alias("b")))
    pages = roles.table(spark, folder, "pages").select("page_id", s.decode_entities(title).alias("title"), doc.alias("doc"))
    return nested.collect_key(pages, "page_id", "doc", "k", also=("title",)).select("page_id", "title", F.array_join("vals", ",").alias("keys"))


QUERIES = {
    f.__name__: f
    for f in (string_scopes, result_classes, optional_clauses, exists_tagging, people, ratings, tag_sets, tag_assert, tag_aliases, expression_choice, type_audit, questions, jobs, newsletter, entity_decode)
}

_R = roles.with_roles
ORACLE_SQL = {
    "string_scopes": _R("parts", "part_tags", "page_refs", "feed_entries", "users", "tags", "expressions", then=f"{c._LISTS}, sites AS (SELECT DISTINCT domain AS site, unnest(string_split(domain, '.')) AS word FROM page_refs)", query="""
SELECT DISTINCT 'Part' AS entity_type, 'title or description' AS scope, CAST(entity_id AS VARCHAR) AS entity_id FROM parts WHERE title ILIKE '%re%' OR description ILIKE '%re%'
UNION ALL SELECT DISTINCT 'Part', 'tags', CAST(entity_id AS VARCHAR) FROM part_tags WHERE name ILIKE '%re%'
UNION ALL SELECT DISTINCT 'PageRef', 'domain', CAST(page_id AS VARCHAR) FROM page_refs WHERE domain ILIKE '%re%'
UNION ALL SELECT DISTINCT 'Site', 'root', site FROM sites WHERE site ILIKE '%re%'
UNION ALL SELECT DISTINCT 'Site', 'tag', site FROM sites WHERE word ILIKE '%re%'
UNION ALL SELECT DISTINCT 'Feed', 'title', CAST(feed_id AS VARCHAR) FROM feed_entries WHERE title ILIKE '%re%'
UNION ALL SELECT DISTINCT 'Feed', 'site', CAST(feed_id AS VARCHAR) FROM feed_entries JOIN page_refs ON feed_id = page_id WHERE domain ILIKE '%re%'
UNION ALL SELECT DISTINCT 'User', 'username', CAST(user_id AS VARCHAR) FROM users WHERE username ILIKE '%re%'
UNION ALL SELECT DISTINCT 'User', 'about', CAST(user_id AS VARCHAR) FROM users WHERE about ILIKE '%re%'
UNION ALL SELECT DISTINCT 'List', 'name tag', CAST(list_id AS VARCHAR) FROM lists WHERE name_tag ILIKE '%re%'
UNION ALL SELECT DISTINCT 'Tag', 'normalized_name', tag FROM tags WHERE normalized_name ILIKE '%re%'
UNION ALL SELECT DISTINCT 'Referent', 'tags', referent FROM expressions WHERE tag ILIKE '%re%'"""),
    "result_classes": _R("parts", "pointers", "users", "tags", "taggings", "feed_entries", "page_refs", then=f"{c._FOLLOWS}, {c._LISTS}, friends AS (SELECT followee FROM follows WHERE follower = 11)", query="""
SELECT 'search_index' AS class, count(*) AS rows FROM parts
UNION ALL SELECT 'users_collection', count(*) FROM pointers WHERE user_id = 7 AND in_collection AND NOT private
UNION ALL SELECT 'users_recent', count(*) FROM pointers WHERE user_id = 7
UNION ALL SELECT 'users_biglist', count(*) FROM pointers WHERE NOT private
UNION ALL SELECT 'lists_index', count(*) FROM lists WHERE owner_id = 11 OR availability = 0 OR (availability = 1 AND owner_id IN (SELECT followee FROM friends))
UNION ALL SELECT 'lists_owned', count(*) FROM lists WHERE owner_id = 11
UNION ALL SELECT 'users_index', count(*) FROM users
UNION ALL SELECT 'users_followed', count(*) FROM users WHERE user_id IN (SELECT followee FROM friends)
UNION ALL SELECT 'users_relevant', count(*) FROM users WHERE user_id <> 11 AND user_id NOT IN (SELECT followee FROM friends)
UNION ALL SELECT 'tags_index', count(*) FROM tags WHERE tagtype = 3
UNION ALL SELECT 'tags_associated', count(*) FROM taggings WHERE tag = '3:blue'
UNION ALL SELECT 'feeds_index', count(DISTINCT feed_id) FROM feed_entries
UNION ALL SELECT 'feeds_show', count(*) FROM feed_entries WHERE feed_id = 3
UNION ALL SELECT 'sites_index', count(DISTINCT domain) FROM page_refs
UNION ALL SELECT 'integers', 31"""),
    "optional_clauses": _R("taggings", query="""SELECT count(*) AS taggings, count(DISTINCT entity_id) AS entities, 0 AS n FROM taggings WHERE tag = '3:red'
UNION ALL SELECT count(*), count(DISTINCT entity_id), 1 FROM taggings WHERE tag IN ('3:red', '3:blue') AND user_id = 7
UNION ALL SELECT count(*), count(DISTINCT entity_id), 2 FROM taggings WHERE tagtype = 2 AND user_id IN (1, 2, 3) UNION ALL SELECT count(*), count(DISTINCT entity_id), 3 FROM taggings"""),
    "exists_tagging": _R("parts", "taggings", query="SELECT entity_id FROM parts WHERE entity_id IN (SELECT entity_id FROM taggings WHERE tag IN ('3:red', '2:small') AND user_id IN (1, 5, 7, 9))"),
    "people": _R("users", query="""SELECT user_id, CASE WHEN user_id % 3 = 0 THEN username END AS name, CASE WHEN user_id % 3 < 2 THEN 'u' || user_id || '@x.org' END AS email,
  string_split(lower(about), ' ')[-1] AS last, CASE user_id % 3 WHEN 0 THEN username WHEN 1 THEN 'u' || user_id END AS handle, about ILIKE 'build%' AS matches FROM users"""),
    "ratings": """SELECT p_partkey, CASE WHEN v = 0 THEN 'neutral' ELSE ['slightly', 'somewhat', 'quite', 'extremely'][CAST(abs(v) AS INTEGER)] || CASE WHEN v < 0 THEN ' bland' ELSE ' spicy' END END AS rating
  FROM (SELECT p_partkey, p_size % 9 - 4 AS v FROM part)""",
    "tag_sets": _R("taggings", query="""SELECT entity_id, count(*) AS visible, count(*) FILTER (mine) AS editable, count(*) FILTER (NOT mine) AS locked
  FROM (SELECT entity_id, tag, bool_or(user_id = 7) AS mine FROM taggings GROUP BY entity_id, tag) GROUP BY entity_id"""),
    "tag_assert": _R("tags", then=f"{c._LISTS}, a AS (SELECT * FROM (VALUES ('red', 4), ('ring', 4), ('saffron', 4), ('brand-3', 1)) t(n, w))", query="""
SELECT w || ':' || n AS tag, CASE WHEN EXISTS (SELECT 1 FROM tags WHERE normalized_name = n AND tagtype = w) THEN 'there' WHEN EXISTS (SELECT 1 FROM tags WHERE normalized_name = n AND tagtype = 3) THEN 'retyped' ELSE 'added' END AS status,
  EXISTS (SELECT 1 FROM lists WHERE name_tag = w || ':' || n AND availability <> 2) AS is_global FROM a"""),
    "tag_aliases": _R("tags", query="""SELECT tag, CASE WHEN regexp_matches(normalized_name, '(s|x|z|ch|sh)$') THEN normalized_name || 'es' WHEN regexp_matches(normalized_name, '[^aeiou]y$') THEN regexp_replace(normalized_name, 'y$', 'ies') ELSE normalized_name || 's' END AS plural,
  normalized_name AS singular FROM tags WHERE tagtype = 3"""),
    "expression_choice": _R("expressions", query="""SELECT referent, arg_min(tag, (CASE WHEN length(tag) % 3 = 2 AND length(tag) % 2 = 0 THEN 0 WHEN length(tag) % 3 = 1 THEN 1 ELSE 2 END, tag)) AS tag FROM expressions GROUP BY referent"""),
    "type_audit": _R("expressions", "tags", query="SELECT normalized_name, tagtype, count(*) AS referents FROM expressions e JOIN tags t ON e.tag = '3:' || normalized_name AND tagtype <> 3 GROUP BY normalized_name, tagtype"),
    "questions": """WITH u AS (SELECT DISTINCT user_id FROM events), q AS (SELECT DISTINCT event_type FROM events),
o AS (SELECT u.user_id, min(q.event_type) AS q FROM u, q WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = u.user_id AND e.event_type = q.event_type AND e.event_type <> 'view') GROUP BY u.user_id)
SELECT u.user_id, coalesce(o.q, (SELECT min(event_type) FROM events)) AS question FROM u LEFT JOIN o ON u.user_id = o.user_id""",
    "jobs": """WITH l AS (SELECT value, CASE event_type WHEN 'view' THEN 'processing' WHEN 'click' THEN 'processing' WHEN 'error' THEN 'processing' ELSE 'good' END AS launched FROM events)
SELECT launched, CASE WHEN launched <> 'processing' THEN launched WHEN value > 20 THEN 'bad' ELSE 'good' END AS landed, count(*) AS jobs FROM l GROUP BY 1, 2""",
    "newsletter": _R("users", then="""latest AS (SELECT user_id, max(event_id) AS read FROM events GROUP BY user_id), u AS (SELECT users.user_id, about, read, max(read) OVER (PARTITION BY about) AS edition FROM users LEFT JOIN latest USING (user_id))""",
        query="SELECT user_id, CAST((row_number() OVER (PARTITION BY about, user_id % 16 ORDER BY user_id) - 1) * 5 AS INTEGER) AS delay FROM u WHERE edition IS NOT NULL AND (read IS NULL OR read < edition)"),
    "entity_decode": """SELECT page_id, replace(replace(replace(replace(replace(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;', '&') AS title, page_id || ',"x"' AS keys FROM pages""",
}
