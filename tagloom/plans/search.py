"""Queries of ranked search, string scopes, filters and orderings, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import normalize_name
from ..operators import search
from ..sources import files, roles

SCOPES = [["title", "description"]]
#: Whose views the ordering by views goes by.
VIEWER = 7


def _found(spark: SparkSession, folder: str, words: list[str], viewer: int | None = None) -> DataFrame:
    tagged = roles.part_tags(spark, folder).select("entity_id", F.concat_ws(":", "tagtype", normalize_name(F.col("name"))).alias("tag")).distinct()
    tags, expressions = roles.tags(spark, folder), roles.expressions(spark, folder)
    return search.found(roles.parts(spark, folder), SCOPES, roles.pointers(spark, folder), tagged, tags, expressions, words, viewer)


def _asked(spark: SparkSession, folder: str, asked: search.Search) -> DataFrame:
    return search.page(_found(spark, folder, list(asked.tags), asked.viewer), search.order_of(asked), asked.offset, asked.limit)


def search_parts(spark: SparkSession, folder: str) -> DataFrame:
    """SRCH-5..9, STR-1, SET-4, SORT-8, TOPK-1: two tags, the ten best."""
    return _asked(spark, folder, search.Search(("small", "ring"))).select("rank", "entity_id", "title", "score")


def search_parts_next(spark: SparkSession, folder: str) -> DataFrame:
    """SRCH-1..3, WIN-2, WIN-3: the second window of a search that was parsed from text."""
    return _asked(spark, folder, search.Search.parse("'red', 5-LOW", offset=5, limit=5)).select("rank", "entity_id", "title", "score")


def search_orders(spark: SparkSession, folder: str) -> DataFrame:
    """SORT-1, SORT-2, SORT-4, SORT-5, SORT-11: what two tags find, the first five by each ordering, and by one the other way round."""
    found = common_rows(_found(spark, folder, ["small", "ring"], VIEWER))
    asked = [search.Search(("small", "ring"), org=org, limit=5, viewer=VIEWER) for org in search.ORGS]
    asked.append(search.Search(("small", "ring"), org="alphabetic", descending=False, limit=5))
    names = [*search.ORGS, "alphabetic, reversed"]
    pages = [search.page(found, search.order_of(a), a.offset, a.limit).select(F.lit(n).alias("org"), "rank", "entity_id") for a, n in zip(asked, names)]
    return reduce(DataFrame.unionByName, pages)


def common_rows(found: DataFrame) -> DataFrame:
    """found, stored in the shared folder: several windows are cut from the same result."""
    path = files.shared_path(found.sparkSession, "found")
    found.write.parquet(path)
    return found.sparkSession.read.schema(found.schema).parquet(path)


def search_no_tags(spark: SparkSession, folder: str) -> DataFrame:
    """SRCH-4, SORT-1, TOPK-1: without tags the scope itself, newest first, passes through."""
    part = roles.table(spark, folder, "part").select("p_partkey", "p_name", "p_retailprice")
    return part.orderBy(F.desc("p_retailprice"), "p_partkey").offset(20).limit(20)


def search_scopes(spark: SparkSession, folder: str) -> DataFrame:
    """SRCH-6, STR-2, STR-5, STR-6, JOIN-24: one word in the columns of several entity types, joined with a type."""
    word = "red"
    part = search.text_scores(roles.parts(spark, folder), [["title"], ["description"]], word).select(F.lit("Part").alias("entity_type"), "entity_id", "score")
    users = roles.users(spark, folder).select(F.col("user_id").alias("entity_id"), "username", "about")
    user = search.text_scores(users, [["username"], ["about"]], "BUILD").select(F.lit("User").alias("entity_type"), "entity_id", "score")
    entries = roles.feed_entries(spark, folder)
    entry = entries.filter(search.like(F.col("title"), "ti")).select(F.lit("FeedEntry").alias("entity_type"), (F.col("feed_id") * 1000 + F.col("guid")).alias("entity_id"), F.lit(1).alias("score"))
    return part.unionByName(user).unionByName(entry)


def tag_match(spark: SparkSession, folder: str) -> DataFrame:
    """TAG-3..6, TAG-15, TOPK-4, FLT-5: tags that hold a string, one a name, prefix matches first, 75 at most."""
    key = "re"
    name = F.col("normalized_name")
    matched = roles.tags(spark, folder).filter(F.contains(name, F.lit(key)) & F.col("tagtype").isin(2, 3))
    order = Window.partitionBy("normalized_name").orderBy(F.instr(name, key), "tagtype")
    folded = matched.withColumn("n", F.row_number().over(order)).withColumn("alternatives", F.count("*").over(Window.partitionBy("normalized_name"))).filter("n = 1")
    first = F.startswith(name, F.lit(key))
    return folded.orderBy(F.desc(first), "normalized_name").limit(75).select("tag", "normalized_name", first.alias("is_prefix"), "alternatives")


def tag_scores(spark: SparkSession, folder: str) -> DataFrame:
    """SRCH-10: tags by their own names: one for holding a text, one more for being it."""
    name = F.col("normalized_name")
    score = F.contains(name, F.lit("red")).cast("int") + (name == "red").cast("int")
    return roles.tags(spark, folder).select("tag", score.alias("score")).filter("score > 0")


def stored_hits(spark: SparkSession, folder: str) -> DataFrame:
    """SNK-1, TOPK-3: ranked hits of two types stored as type, id and score; a window of them, loaded type by type, in the stored order."""
    parts, users = roles.parts(spark, folder), roles.users(spark, folder).select(F.col("user_id").alias("entity_id"), "username", "about")
    hits = search.text_scores(parts, [["title"]], "small").select(F.lit("Part").alias("entity_type"), "entity_id", "score")
    hits = hits.unionByName(search.text_scores(users, [["about"]], "BUILD").select(F.lit("User").alias("entity_type"), "entity_id", "score"))
    order = [F.desc("score"), F.asc("entity_id"), F.asc("entity_type")]
    shown = search.page(common_rows(hits), order, 5, 10)
    loaded = [shown.filter(F.col("entity_type") == t).join(rows, "entity_id").select("rank", "entity_type", "entity_id", "name") for t, rows in (("Part", parts.withColumnRenamed("title", "name")), ("User", users.withColumnRenamed("username", "name")))]
    return reduce(DataFrame.unionByName, loaded).orderBy("rank")


def tag_clashes(spark: SparkSession, folder: str) -> DataFrame:
    """FLT-12, GRF-16, TAG-14: tags of equal names and different types."""
    a = roles.tags(spark, folder).select("normalized_name", "tagtype", "tag")
    b = a.select("normalized_name", F.col("tagtype").alias("other_type"), F.col("tag").alias("other_tag"))
    return a.join(b, "normalized_name").filter("tagtype <> other_type").select("tag", "other_tag")


def filters(spark: SparkSession, folder: str) -> DataFrame:
    """FLT-1..4, FLT-8, FLT-25: predicates of the scopes on one table, as counts."""
    o = roles.table(spark, folder, "orders")
    approved = F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "O", False)  # null: pending
    tests = {
        "in_list": F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"),
        "not_in_list": ~F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"),
        "in_range": F.col("o_totalprice").between(1000, 2000),
        "before": F.col("o_orderdate") < F.lit("1995-01-01").cast("timestamp_ntz"),
        "after": F.col("o_orderdate") > F.lit("1997-01-01").cast("timestamp_ntz"),
        "substring": search.like(F.col("o_orderpriority"), "low"),
        "approved": F.coalesce(approved, F.lit(False)),
        "pending": approved.isNull(),
        "hidden_or_pending": approved.isNull() | ~approved,
        "rank_at_least": F.substring("o_orderpriority", 1, 1).cast("int") >= 3,
    }
    return o.agg(*[F.count_if(c).alias(k) for k, c in tests.items()])


def report_sorted(spark: SparkSession, folder: str) -> DataFrame:
    """SNK-3, SORT-6, SORT-9, SORT-10: a report by two columns, nulls lowest, the first fifty rows."""
    s = roles.table(spark, folder, "supplier").select("s_suppkey", "s_name", F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("balance"))
    return s.orderBy(F.desc_nulls_last("balance"), F.asc("s_name")).limit(50)


def score_bands(spark: SparkSession, folder: str) -> DataFrame:
    """WIN-1, WIN-4, WIN-5: entities by the band of their score."""
    parts = roles.parts(spark, folder)
    scored = search.any_of([search.text_scores(parts, [["title"], ["description"]], w) for w in ("red", "small", "ring")])
    band = F.greatest(F.lit(1), F.least(F.lit(3), F.col("score")))
    return scored.groupBy(band.cast("int").alias("band")).agg(F.count("*").alias("entities"))


def normalised_audit(spark: SparkSession, folder: str) -> DataFrame:
    """TAG-1, TAG-2, TAG-17: names whose stored form isn't the normalised one."""
    return roles.tags(spark, folder).filter(normalize_name(F.col("name")) != F.col("name")).select("tag", "name", "normalized_name")


QUERIES = {f.__name__: f for f in (tag_scores, stored_hits, search_parts, search_parts_next, search_orders, search_no_tags, search_scopes, tag_match, tag_clashes, filters, report_sorted, score_bands, normalised_audit)}


def _found_sql(words: list[str]) -> tuple[str, str]:
    parts = []
    for i, w in enumerate(words):
        n = w.lower()
        parts.append(f"""
text{i} AS (SELECT entity_id, CAST(title ILIKE '%{w}%' OR description ILIKE '%{w}%' AS INTEGER) + CAST(lower(title) = '{n}' OR lower(description) = '{n}' AS INTEGER) AS score FROM parts),
exact{i} AS (SELECT tag FROM tags WHERE normalized_name = '{n}'),
fuzzy{i} AS (SELECT tag FROM tags WHERE contains(normalized_name, '{n}')),
meant{i} AS (SELECT referent FROM expressions WHERE tag IN (SELECT tag FROM exact{i})),
similar{i} AS (SELECT tag FROM expressions WHERE referent IN (SELECT referent FROM meant{i}) AND tag NOT IN (SELECT tag FROM exact{i})),
hits{i} AS (
  SELECT entity_id, score FROM text{i} WHERE score > 0
  UNION ALL SELECT DISTINCT entity_id, 1 FROM taggings WHERE tag IN (SELECT tag FROM fuzzy{i})
  UNION ALL SELECT DISTINCT entity_id, 1 FROM taggings WHERE tag IN (SELECT tag FROM exact{i})
  UNION ALL SELECT DISTINCT entity_id, 1 FROM taggings WHERE tag IN (SELECT tag FROM similar{i})
  UNION ALL SELECT DISTINCT entity_id, 1 FROM pointers WHERE comment ILIKE '%{w}%'),
found{i} AS (SELECT entity_id, sum(score) AS score FROM hits{i} GROUP BY entity_id)""")
    total = " + ".join(f"found{i}.score" for i in range(len(words)))
    joins = "".join(f" JOIN found{i} USING (entity_id)" for i in range(1, len(words)))
    return ",".join(parts), f"SELECT entity_id, title, CAST({total} AS INTEGER) AS score FROM found0{joins} JOIN parts USING (entity_id)"


def _search_sql(words: list[str], offset: int, limit: int) -> str:
    parts, query = _found_sql(words)
    ranked = f"SELECT CAST(row_number() OVER (ORDER BY score DESC, entity_id) AS INTEGER) AS rank, * FROM ({query}) ORDER BY rank LIMIT {limit} OFFSET {offset}"
    return roles.with_roles("parts", "pointers", "taggings", "tags", "expressions", then=parts, query=ranked)


def _orders_sql(words: list[str], limit: int) -> str:
    parts, query = _found_sql(words)
    stats = f"""stats AS (SELECT entity_id, min(created_at) AS created_at, max(updated_at) AS updated_at, count(*) FILTER (in_collection) AS popularity, max(updated_at) FILTER (user_id = {VIEWER}) AS viewed_at,
  max(created_at) AS posted_at, sum(edit_count) AS activity, CAST(count(*) FILTER (in_collection) AS DOUBLE) / count(*) AS rating, max(created_at) FILTER (in_collection AND NOT private) AS approved_at FROM pointers GROUP BY entity_id),
hit AS (SELECT f.*, created_at, updated_at, coalesce(popularity, 0) AS popularity, viewed_at, posted_at, activity, rating, approved_at, md5(CAST(f.entity_id AS VARCHAR)) AS chance FROM ({query}) f LEFT JOIN stats USING (entity_id))"""
    orders = [(n, c, "DESC" if down else "ASC") for n, (c, down) in search.ORGS.items()] + [("alphabetic, reversed", "title", "DESC")]
    pages = [f"SELECT * FROM (SELECT '{n}' AS org, CAST(row_number() OVER (ORDER BY {c} {way} NULLS LAST, entity_id) AS INTEGER) AS rank, entity_id FROM hit) WHERE rank <= {limit}" for n, c, way in orders]
    return roles.with_roles("parts", "pointers", "taggings", "tags", "expressions", then=f"{parts}, {stats}", query=" UNION ALL ".join(pages))


ORACLE_SQL = {
    "tag_scores": roles.with_roles("tags", query="SELECT tag, CAST(contains(normalized_name, 'red') AS INTEGER) + CAST(normalized_name = 'red' AS INTEGER) AS score FROM tags WHERE contains(normalized_name, 'red')"),
    "stored_hits": roles.with_roles("parts", "users", query="""SELECT * FROM (SELECT CAST(row_number() OVER (ORDER BY score DESC, entity_id, entity_type) AS INTEGER) AS rank, entity_type, entity_id, name FROM (
  SELECT 'Part' AS entity_type, entity_id, title AS name, 1 + CAST(lower(title) = 'small' AS INTEGER) AS score FROM parts WHERE title ILIKE '%small%'
  UNION ALL SELECT 'User', user_id, username, 1 + CAST(lower(about) = 'build' AS INTEGER) FROM users WHERE about ILIKE '%build%')) WHERE rank BETWEEN 6 AND 15"""),
    "search_parts": _search_sql(["small", "ring"], 0, 10),
    "search_parts_next": _search_sql(["red", "5-LOW"], 5, 5),
    "search_orders": _orders_sql(["small", "ring"], 5),
    "search_no_tags": "SELECT p_partkey, p_name, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20 OFFSET 20",
    "search_scopes": roles.with_roles("parts", "users", "feed_entries", query="""SELECT 'Part' AS entity_type, entity_id,
  CAST(title ILIKE '%red%' AS INTEGER) + CAST(lower(title) = 'red' AS INTEGER) + CAST(description ILIKE '%red%' AS INTEGER) + CAST(lower(description) = 'red' AS INTEGER) AS score
  FROM parts WHERE title ILIKE '%red%' OR description ILIKE '%red%'
UNION ALL SELECT 'User', user_id, CAST(username ILIKE '%BUILD%' AS INTEGER) + CAST(lower(username) = 'build' AS INTEGER) + CAST(about ILIKE '%BUILD%' AS INTEGER) + CAST(lower(about) = 'build' AS INTEGER)
  FROM users WHERE username ILIKE '%BUILD%' OR about ILIKE '%BUILD%'
UNION ALL SELECT 'FeedEntry', feed_id * 1000 + guid, 1 FROM feed_entries WHERE title ILIKE '%ti%'"""),
    "tag_match": roles.with_roles("tags", query="""SELECT tag, normalized_name, starts_with(normalized_name, 're') AS is_prefix, alternatives FROM (
  SELECT *, row_number() OVER (PARTITION BY normalized_name ORDER BY instr(normalized_name, 're'), tagtype) AS n, count(*) OVER (PARTITION BY normalized_name) AS alternatives
  FROM tags WHERE contains(normalized_name, 're') AND tagtype IN (2, 3)) WHERE n = 1 ORDER BY is_prefix DESC, normalized_name LIMIT 75"""),
    "tag_clashes": roles.with_roles("tags", query="SELECT a.tag, b.tag AS other_tag FROM tags a JOIN tags b ON a.normalized_name = b.normalized_name AND a.tagtype <> b.tagtype"),
    "filters": """SELECT count(*) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH')) AS in_list, count(*) FILTER (o_orderpriority NOT IN ('1-URGENT', '2-HIGH')) AS not_in_list,
  count(*) FILTER (o_totalprice BETWEEN 1000 AND 2000) AS in_range, count(*) FILTER (o_orderdate < TIMESTAMP '1995-01-01') AS before, count(*) FILTER (o_orderdate > TIMESTAMP '1997-01-01') AS after,
  count(*) FILTER (o_orderpriority ILIKE '%low%') AS substring, count(*) FILTER (o_orderstatus = 'F') AS approved, count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS pending,
  count(*) FILTER (o_orderstatus <> 'F') AS hidden_or_pending, count(*) FILTER (CAST(substr(o_orderpriority, 1, 1) AS INTEGER) >= 3) AS rank_at_least FROM orders""",
    "report_sorted": "SELECT s_suppkey, s_name, CASE WHEN s_acctbal > 0 THEN s_acctbal END AS balance FROM supplier ORDER BY balance DESC NULLS LAST, s_name LIMIT 50",
    "score_bands": roles.with_roles("parts", query="""SELECT CAST(least(3, greatest(1, score)) AS INTEGER) AS band, count(*) AS entities FROM (
  SELECT entity_id, sum(CAST(title ILIKE '%' || w || '%' AS INTEGER) + CAST(lower(title) = w AS INTEGER) + CAST(description ILIKE '%' || w || '%' AS INTEGER) + CAST(lower(description) = w AS INTEGER)) AS score
  FROM parts, (VALUES ('red'), ('small'), ('ring')) t(w) GROUP BY entity_id) WHERE score > 0 GROUP BY 1"""),
    "normalised_audit": roles.with_roles("tags", query="SELECT tag, name, normalized_name FROM tags WHERE normalized_name <> name"),
}
