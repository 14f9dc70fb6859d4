"""A dictionary of tags asserted at once: a change set from one join, and the tables after it.

A tag is known by its normalised name and its type; type 0 is free. A name asserted with a type is the tag of that name and type if there is one;
else a free tag of that name takes the type (of several types that want it, the least); else a tag is added. Asserted free, a
name is whatever tag of that name exists, the free one first. Tags that have a type, or are asserted by nobody in
particular, become visible to all; a free tag that isn't becomes one of its asserting users' own. Asserting the same again changes nothing.
"""

from __future__ import annotations

from collections import namedtuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import normalize_name

FREE = 0
#: changes: action (there, retyped, added), normalized_name, tagtype, from_type; tags and owners: the tables afterwards.
Asserted = namedtuple("Asserted", "changes tags owners")


def assert_tags(tags: DataFrame, owners: DataFrame, asserted: DataFrame) -> Asserted:
    """tags: name, normalized_name, tagtype, is_global. owners: normalized_name, tagtype, user_id. asserted: name, tagtype (null: free), user_id (null: nobody).

    Names without a letter, digit or underscore are passed over. Null flags count as false.
    """
    wanted = asserted.select("name", normalize_name(F.col("name")).alias("normalized_name"), F.coalesce("tagtype", F.lit(FREE)).alias("wanted"), "user_id").filter("normalized_name <> ''")
    each = wanted.groupBy("normalized_name", "wanted").agg(F.min("name").alias("asserted_name"), F.count_if(F.col("user_id").isNull()).alias("nobody"))
    known = tags.groupBy("normalized_name").agg(F.collect_set("tagtype").alias("types"))
    met = each.join(known, "normalized_name", "left")
    has = F.coalesce(F.array_contains("types", F.col("wanted")), F.lit(False))
    free = F.coalesce(F.array_contains("types", F.lit(FREE)), F.lit(False))
    # whatever there is serves a name that is asserted free
    final = F.when(has | (F.col("wanted") != FREE) | F.col("types").isNull(), F.col("wanted")).otherwise(F.array_min("types"))
    met = met.withColumn("tagtype", final).withColumn("_has", has | ((F.col("wanted") == FREE) & F.col("types").isNotNull()))
    first = F.min(F.when(~F.col("_has"), F.col("wanted"))).over(Window.partitionBy("normalized_name"))  # of the types that want a name
    action = F.when(F.col("_has"), "there").when(free & (F.col("wanted") == first), "retyped").otherwise("added")
    changes = met.withColumn("action", action).select("action", "normalized_name", "tagtype", F.when(F.col("action") == "retyped", F.lit(FREE)).alias("from_type"), "wanted", "asserted_name", "nobody")
    # one full join gives every tag as it is afterwards
    after = changes.groupBy("normalized_name", "tagtype").agg(F.min("asserted_name").alias("asserted_name"), F.sum("nobody").alias("nobody"))
    moved = changes.filter("action = 'retyped'").select("normalized_name", F.col("from_type").alias("tagtype"), F.col("tagtype").alias("_new"))
    current = tags.join(moved, ["normalized_name", "tagtype"], "left").withColumn("tagtype", F.coalesce("_new", "tagtype")).drop("_new")
    joined = current.join(after, ["normalized_name", "tagtype"], "full")
    was_global = F.coalesce("is_global", F.lit(False))
    admitted = F.col("asserted_name").isNotNull() & ((F.col("tagtype") != FREE) | (F.col("nobody") > 0))
    new_tags = joined.select(F.coalesce("name", "asserted_name").alias("name"), "normalized_name", "tagtype", (was_global | F.coalesce(admitted, F.lit(False))).alias("is_global"))
    closed = joined.filter(~(was_global | F.coalesce(admitted, F.lit(False))) & F.col("asserted_name").isNotNull()).select("normalized_name", "tagtype")
    users = wanted.filter("user_id IS NOT NULL").select("normalized_name", "wanted", "user_id").distinct()
    own = users.join(changes.select("normalized_name", "wanted", "tagtype"), ["normalized_name", "wanted"]).join(closed, ["normalized_name", "tagtype"], "left_semi").select("normalized_name", "tagtype", "user_id")
    kept = owners.join(moved, ["normalized_name", "tagtype"], "left").select("normalized_name", F.coalesce("_new", "tagtype").alias("tagtype"), "user_id")
    return Asserted(changes.select("action", "normalized_name", "tagtype", "from_type"), new_tags, kept.unionByName(own).distinct())
