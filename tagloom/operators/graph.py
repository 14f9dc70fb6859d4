"""The graph of concepts: synonyms, parents, children, neighbourhoods, paths and cycles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import files


def children(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Direct children of nodes, those among the nodes left out."""
    found = relations.join(nodes.select(F.col("node").alias("parent")), "parent", "left_semi").select(F.col("child").alias("node")).distinct()
    return found.join(nodes, "node", "left_anti")


def parents(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    return children(relations.select(F.col("child").alias("parent"), F.col("parent").alias("child")), nodes)


def siblings(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes with a parent in common, the nodes themselves included."""
    shared = relations.join(nodes.select(F.col("node").alias("child")), "child", "left_semi").select("parent").distinct()
    return relations.join(shared, "parent", "left_semi").select(F.col("child").alias("node")).distinct()


def of_tags(step, expressions: DataFrame, relations: DataFrame, tags: DataFrame) -> DataFrame:
    """Tags of what is one step (children, parents, siblings) from what the given tags mean."""
    meant = expressions.join(tags, "tag", "left_semi").select(F.col("referent").alias("node")).distinct()
    found = step(relations, meant).select(F.col("node").alias("referent"))
    return expressions.join(found, "referent", "left_semi").select("tag").distinct()


def neighbourhood(relations: DataFrame, nodes: DataFrame, least: float = 0.4, fading: float = 0.5) -> DataFrame:
    """node, weight: the nodes with 1, then children with `fading` of their parents' weight while it is at least `least`.

    A node keeps the weight of its first visit, which is its highest. Rounds are bounded by the weights.
    """
    level, weight = files.stored(nodes.select("node").distinct().withColumn("weight", F.lit(1.0)), "graph-level"), 1.0
    found = level
    while weight * fading >= least:
        weight *= fading
        level = relations.join(level.select(F.col("node").alias("parent")), "parent", "left_semi").select(F.col("child").alias("node")).distinct()
        level = files.stored(level.join(found, "node", "left_anti").withColumn("weight", F.lit(weight)), "graph-level")
        found = found.unionByName(level)
    return found


def best_first(edges: DataFrame, start: DataFrame, cutoff: float) -> DataFrame:
    """node, value of every path from start nodes (value 1) along weighted edges whose product is at least the cutoff, highest first.

    edges: parent, child, weight (at most 1). A node that several paths reach appears once for each. Cycles of weight 1 have
    no end: ValueError.
    """
    edges = files.stored(edges.select("parent", "child", "weight"), "graph-edges")
    level = files.stored(start.select("node").withColumn("value", F.lit(1.0)), "graph-level")
    full = edges.filter("weight >= 1")
    if not full.isEmpty() and not cycles(full).isEmpty():
        raise ValueError("edges of weight 1 form a cycle")
    found = level
    while not level.isEmpty():
        step = level.join(edges, level["node"] == edges["parent"]).select(F.col("child").alias("node"), (F.col("value") * F.col("weight")).alias("value"))
        level = files.stored(step.filter(F.col("value") >= cutoff), "graph-level")
        found = found.unionByName(level)
    return found.orderBy(F.desc("value"), "node")


def aggregate_members(members: DataFrame, limit: int, share: float = 0.05) -> DataFrame:
    """The `limit` members with the highest sums, while they have at least `share` of the highest."""
    sums = files.stored(members.groupBy("node").agg(F.sum("value").alias("value")), "member-sums")
    top = sums.agg(F.max("value")).first()[0]  # one number
    return sums.filter(F.col("value") >= F.lit(top) * share).orderBy(F.desc("value"), "node").limit(limit)


def paths(relations: DataFrame, roots: DataFrame) -> DataFrame:
    """node, path (array from a root down), cycle (whether the next step led back into the path): all ways, each level stored once.

    Ways are as many as the graph has; for the shortest ones see `shortest`.
    """
    level = files.stored(roots.select("node", F.array("node").alias("path"), F.lit(False).alias("cycle")), "graph-level")
    found = level
    while not level.isEmpty():
        step = level.filter("NOT cycle").join(relations, F.col("node") == F.col("parent"))
        level = files.stored(step.select(F.col("child").alias("node"), F.concat("path", F.array("child")).alias("path"), F.array_contains("path", F.col("child")).alias("cycle")), "graph-level")
        found = found.unionByName(level)
    return found


def tree(relations: DataFrame, roots: DataFrame) -> DataFrame:
    """place, line: the tree below the roots as indented lines, in order of their places; a node that leads back says so and ends its branch."""
    line = F.concat(F.repeat(F.lit("    "), F.size("path") - 1), F.when(F.col("cycle"), "!!Loop back to ").otherwise(""), F.col("node"))
    return paths(relations, roots).select(F.array_join("path", "/").alias("place"), line.alias("line"))


def _linked(relations: DataFrame) -> DataFrame:
    """Each link once, without those that lack an end."""
    return relations.filter("parent IS NOT NULL AND child IS NOT NULL").select("parent", "child").distinct()


def shortest(relations: DataFrame, start: DataFrame, until: Column | None = None) -> DataFrame:
    """node, path (array, from a start node down): the shortest way to every node that can be reached, of equals the least.

    Breadth first, one stored level a step; nodes that were visited are kept in a table of their own and never met again, so a walk
    takes as many steps as its farthest node lies away, however many ways there are. until: a condition on `node`; the
    walk ends with the level that has such nodes.
    """
    spark = relations.sparkSession
    edges, seen = files.stored(_linked(relations), "graph-edges"), files.shared_path(spark, "graph-visited")
    level = start.filter("node IS NOT NULL").select("node").distinct().select("node", F.array("node").alias("path"))
    found = files.shared_path(spark, "graph-paths")
    while True:
        level = files.stored(level, "graph-level")
        level.select("node").write.mode("append").parquet(seen)
        level.write.mode("append").parquet(found)
        if level.isEmpty() or (until is not None and not level.filter(until).isEmpty()):
            return spark.read.schema(level.schema).parquet(found)
        step = level.join(edges, F.col("node") == F.col("parent")).groupBy("child").agg(F.min(F.concat("path", F.array("child"))).alias("path")).select(F.col("child").alias("node"), "path")
        level = step.join(spark.read.schema(level.select("node").schema).parquet(seen), "node", "left_anti")


def path_between(relations: DataFrame, low: str, high: str) -> DataFrame:
    """The shortest way up from one node to another, as an array; no row if there is none."""
    up = relations.select(F.col("child").alias("parent"), F.col("parent").alias("child"))
    start = relations.sparkSession.createDataFrame([(low,)], "node string")
    return shortest(up, start, F.col("node") == high).filter(F.col("node") == high).select("path")


def _trimmed(edges: DataFrame) -> DataFrame:
    """Links without those that can't lie on a cycle for want of a link into their parent or out of their child, layer by layer while that
    takes a tenth of them or more away."""
    n = edges.count()
    while n:
        inward, outward = edges.select(F.col("child").alias("parent")).distinct(), edges.select(F.col("parent").alias("child")).distinct()
        edges, before = files.stored(edges.join(inward, "parent", "left_semi").join(outward, "child", "left_semi").select("parent", "child"), "graph-edges"), n
        n = edges.count()
        if n > 0.9 * before:
            break
    return edges


def _least_above(edges: DataFrame) -> DataFrame:
    """node, label: the least of the nodes that reach it, itself included. Only labels that changed are passed on."""
    labels = files.stored(edges.select(F.explode(F.array("parent", "child")).alias("node")).distinct().select("node", F.col("node").alias("label")), "graph-labels")
    changed = labels
    while not changed.isEmpty():
        told = changed.join(edges, changed["node"] == edges["parent"]).groupBy("child").agg(F.min("label").alias("_told"))
        after = labels.join(told, labels["node"] == told["child"], "left").select("node", F.least("label", "_told").alias("label"), (F.col("_told") < F.col("label")).alias("_new"))
        after = files.stored(after, "graph-labels")
        labels, changed = after.select("node", "label"), after.filter("_new").select("node", "label")
    return labels


def cycles(relations: DataFrame) -> DataFrame:
    """Nodes that lie on a cycle, links of a node to itself included.

    Links without a way in or out are trimmed first. What is left is labelled by the least node that reaches it; from each node that keeps
    its own name a walk back within its label gives the nodes that it reaches and that reach it. They form cycles if they
    are more than one; they go, and the rest is labelled anew. Steps are bounded by the length of the ways, nothing by a depth.
    """
    edges = files.stored(_linked(relations), "graph-edges")
    parts = [edges.filter("parent = child").select(F.col("parent").alias("node"))]
    edges = _trimmed(edges.filter("parent <> child"))
    while not edges.isEmpty():
        labels = _least_above(edges)
        parent, child = (labels.select(F.col("node").alias(end), F.col("label").alias(f"_{end}")) for end in ("parent", "child"))
        inner = edges.join(parent, "parent").join(child, "child").filter("_parent = _child").select(F.col("child").alias("parent"), F.col("parent").alias("child"))
        members = shortest(inner, labels.filter("node = label").select("node")).select("node")
        members = files.stored(members.join(labels, "node"), "graph-members")
        several = members.groupBy("label").count().filter("count > 1").select("label")
        parts.append(members.join(several, "label", "left_semi").select("node"))
        gone = members.select("node")
        rest = edges.join(gone, edges["parent"] == gone["node"], "left_anti").join(gone, F.col("child") == gone["node"], "left_anti")
        edges = _trimmed(files.stored(rest, "graph-edges"))
    return reduce(DataFrame.unionByName, parts).distinct()


def add_relation(relations: DataFrame, parent: str, child: str) -> DataFrame:
    """The relations with one more; refused (ValueError) if it would close a cycle."""
    if parent == child or not path_between(relations, parent, child).isEmpty():
        raise ValueError(f"{child} is an ancestor of {parent}")
    new = relations.sparkSession.createDataFrame([(parent, child)], "parent string, child string")
    return relations.select("parent", "child").unionByName(new).distinct()
