"""Queries of the concept graph and the tag dictionary, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, search
from ..sources import files, roles


def _nodes(spark: SparkSession, *names: str) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], "node string")


def tag_synonyms(spark: SparkSession, folder: str) -> DataFrame:
    """GRF-1..3, GRF-15: what shares a meaning with a tag."""
    return search.synonyms(roles.expressions(spark, folder), spark.createDataFrame([("3:small",)], "tag string"))


def concept_children(spark: SparkSession, folder: str) -> DataFrame:
    """GRF-4, GRF-7: direct children of two concepts."""
    r = roles.relations(spark, folder)
    first = r.filter(F.startswith("parent", F.lit("region:"))).agg(F.min("parent").alias("node"))
    return graph.children(r, first)


def concept_parents(spark: SparkSession, folder: str) -> DataFrame:
    """GRF-5, GRF-7: direct parents of all suppliers."""
    r = roles.relations(spark, folder)
    suppliers = roles.table(spark, folder, "supplier").select(F.concat(F.lit("supplier:"), "s_name").alias("node"))
    return graph.parents(r, suppliers)


def concept_siblings(spark: SparkSession, folder: str) -> DataFrame:
    """GRF-6: nodes with a parent in common with the first supplier."""
    first = roles.table(spark, folder, "supplier").agg(F.concat(F.lit("supplier:"), F.min("s_name")).alias("node"))
    return graph.siblings(roles.relations(spark, folder), first)


def concept_neighbourhood(spark: SparkSession, folder: str) -> DataFrame:
    """GRF-8: weights that halve from level to level, down to 0.2."""
    r = roles.relations(spark, folder)
    first = r.filter(F.startswith("parent", F.lit("region:"))).agg(F.max("parent").alias("node"))
    return graph.neighbourhood(r, first, 0.2)


def concept_paths(spark: SparkSession, folder: str) -> DataFrame:
    """GRF-10: all ways from the roots down, as text."""
    r = roles.relations(spark, folder)
    roots = r.select(F.col("parent").alias("node")).distinct().join(r.select(F.col("child").alias("node")), "node", "left_anti")
    return graph.paths(r, roots).select("node", F.array_join("path", "/").alias("path"), (F.size("path") - 1).alias("depth"))


def concept_ancestry(spark: SparkSession, folder: str) -> DataFrame:
    """GRF-9: the way up from the first supplier to its region."""
    r = roles.relations(spark, folder)
    low = roles.table(spark, folder, "supplier").agg(F.min("s_name")).first()[0]  # one name
    up = r.select(F.col("child").alias("parent"), F.col("parent").alias("child"))
    region = F.startswith("node", F.lit("region:"))
    return graph.shortest(up, _nodes(spark, f"supplier:{low}"), region).filter(region).select(F.array_join("path", ">").alias("path"))


def concept_cycles(spark: SparkSession, folder: str) -> DataFrame:
    """GRF-11, GRF-12: nodes on a cycle, after links from nations back to two regions were added."""
    nation, region = roles.table(spark, folder, "nation"), roles.table(spark, folder, "region")
    back = nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).filter("r_regionkey < 2").select(F.concat(F.lit("nation:"), "n_name").alias("parent"), F.concat(F.lit("region:"), "r_name").alias("child"))
    return graph.cycles(roles.relations(spark, folder).unionByName(back))


def concept_tree(spark: SparkSession, folder: str) -> DataFrame:
    """GRF-22: all concepts as an indented tree, with links from nations back to two regions."""
    nation, region = roles.table(spark, folder, "nation"), roles.table(spark, folder, "region")
    back = nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).filter("r_regionkey < 2").select(F.concat(F.lit("nation:"), "n_name").alias("parent"), F.concat(F.lit("region:"), "r_name").alias("child"))
    return graph.tree(roles.relations(spark, folder).unionByName(back), region.select(F.concat(F.lit("region:"), "r_name").alias("node")))


def best_first_search(spark: SparkSession, folder: str) -> DataFrame:
    """NODE-1..4: values of the paths from a region, weights by key, highest first."""
    r = roles.relations(spark, folder)
    weight = 0.9 - 0.1 * (F.length("child") % 4)
    roots = r.filter(F.startswith("parent", F.lit("region:"))).select(F.col("parent").alias("node")).distinct()
    return graph.best_first(r.withColumn("weight", weight), roots, 0.6).select("node", F.round("value", 6).alias("value"))


def best_members(spark: SparkSession, folder: str) -> DataFrame:
    """NODE-4, NODE-5, TOPK-5: parts recommended through the tags of a user's parts, the best twenty."""
    tagged = files.stored(roles.tagged(spark, folder, mine=F.coalesce(F.bool_or(F.col("user_id") == 7), F.lit(False))), "tagged")
    weights = tagged.filter("mine").groupBy("tag").agg(F.sum("names").cast("double").alias("value"))
    others = tagged.filter("NOT mine")
    return graph.aggregate_members(others.join(weights, "tag").select(F.col("entity_id").alias("node"), "value"), 20)


def related_entities(spark: SparkSession, folder: str) -> DataFrame:
    """GRF-13, GRF-20, JOIN-25, JOIN-26: parts that carry a tag or a synonym of it, by how they were found."""
    e = roles.expressions(spark, folder)
    tag = spark.createDataFrame([("3:blue",)], "tag string")
    on = files.stored(roles.tagged(spark, folder).select("tag", "entity_id"), "tagged")
    direct = on.join(tag, "tag", "left_semi").select("entity_id").distinct()
    near = on.join(search.synonyms(e, tag), "tag", "left_semi").select("entity_id").distinct()
    return direct.withColumn("found", F.lit("tag")).unionByName(near.join(direct, "entity_id", "left_anti").withColumn("found", F.lit("synonym")))


QUERIES = {
    f.__name__: f
    for f in (tag_synonyms, concept_children, concept_parents, concept_siblings, concept_neighbourhood, concept_paths, concept_ancestry, concept_cycles, concept_tree, best_first_search, best_members, related_entities)
}

_R = roles.with_roles
_FIRST_SUPPLIER = "(SELECT 'supplier:' || min(s_name) FROM supplier)"
ORACLE_SQL = {
    "tag_synonyms": _R("expressions", query="SELECT DISTINCT tag FROM expressions WHERE referent IN (SELECT referent FROM expressions WHERE tag = '3:small') AND tag <> '3:small'"),
    "concept_children": _R("relations", query="SELECT DISTINCT child AS node FROM relations WHERE parent = (SELECT min(parent) FROM relations WHERE parent LIKE 'region:%')"),
    "concept_parents": _R("relations", query="SELECT DISTINCT parent AS node FROM relations WHERE child IN (SELECT 'supplier:' || s_name FROM supplier)"),
    "concept_siblings": _R("relations", query=f"SELECT DISTINCT child AS node FROM relations WHERE parent IN (SELECT parent FROM relations WHERE child = {_FIRST_SUPPLIER})"),
    "concept_neighbourhood": _R("relations", recursive=True, then="""near AS (SELECT max(parent) AS node, 1.0::DOUBLE AS weight FROM relations WHERE parent LIKE 'region:%'
  UNION ALL SELECT child, weight / 2 FROM near JOIN relations ON node = parent WHERE weight / 2 >= 0.2)""", query="SELECT node, max(weight) AS weight FROM near GROUP BY node"),
    "concept_paths": _R("relations", recursive=True, then="""paths AS (SELECT DISTINCT parent AS node, parent AS path, 0 AS depth FROM relations WHERE parent NOT IN (SELECT child FROM relations)
  UNION ALL SELECT child, path || '/' || child, depth + 1 FROM paths JOIN relations ON node = parent)""", query="SELECT node, path, depth FROM paths"),
    "concept_ancestry": _R("relations", query=f"""SELECT a.child || '>' || a.parent || '>' || b.parent AS path FROM relations a JOIN relations b ON a.parent = b.child WHERE a.child = {_FIRST_SUPPLIER}"""),
    "concept_cycles": """SELECT 'nation:' || n_name AS node FROM nation WHERE n_regionkey < 2 UNION SELECT 'region:' || r_name FROM region JOIN nation ON r_regionkey = n_regionkey WHERE r_regionkey < 2""",
    "concept_tree": _R("relations", recursive=True, then="""rel AS (SELECT parent, child FROM relations
  UNION ALL SELECT 'nation:' || n_name, 'region:' || r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey < 2),
t AS (SELECT 'region:' || r_name AS node, ['region:' || r_name] AS path, false AS loop FROM region UNION ALL SELECT child, list_append(path, child), list_contains(path, child) FROM t JOIN rel ON node = parent WHERE NOT loop)""",
        query="SELECT array_to_string(path, '/') AS place, repeat('    ', len(path) - 1) || CASE WHEN loop THEN '!!Loop back to ' ELSE '' END || node AS line FROM t"),
    "best_first_search": _R("relations", recursive=True, then="""found AS (SELECT DISTINCT parent AS node, 1.0::DOUBLE AS value FROM relations WHERE parent LIKE 'region:%'
  UNION ALL SELECT child, value * (0.9 - 0.1 * (length(child) % 4)) FROM found JOIN relations ON node = parent WHERE value * (0.9 - 0.1 * (length(child) % 4)) >= 0.6)""", query="SELECT node, round(value, 6) AS value FROM found"),
    "best_members": _R("taggings", then="""own AS (SELECT * FROM taggings WHERE user_id = 7), w AS (SELECT tag, CAST(count(*) AS DOUBLE) AS value FROM own GROUP BY tag),
  sums AS (SELECT entity_id AS node, sum(value) AS value FROM (SELECT DISTINCT tag, entity_id FROM taggings WHERE entity_id NOT IN (SELECT entity_id FROM own)) JOIN w USING (tag) GROUP BY entity_id)""",
        query="SELECT node, value FROM sums WHERE value >= (SELECT max(value) * 0.05 FROM sums) ORDER BY value DESC, node LIMIT 20"),
    "related_entities": _R("expressions", "taggings", then="""near AS (SELECT tag FROM expressions WHERE referent IN (SELECT referent FROM expressions WHERE tag = '3:blue') AND tag <> '3:blue'),
  direct AS (SELECT DISTINCT entity_id FROM taggings WHERE tag = '3:blue')""", query="""SELECT entity_id, 'tag' AS found FROM direct
  UNION ALL SELECT DISTINCT entity_id, 'synonym' FROM taggings WHERE tag IN (SELECT tag FROM near) AND entity_id NOT IN (SELECT entity_id FROM direct)"""),
}
