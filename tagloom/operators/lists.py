"""Collections, lists and who may see them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PUBLIC, FRIENDS, PRIVATE = 0, 1, 2


def collection(pointers: DataFrame, user: int, viewer: int | None = None, collected_only: bool = True) -> DataFrame:
    """A user's pointers that a viewer may see: private ones are the user's own."""
    found = pointers.filter(F.col("user_id") == user)
    if collected_only:
        found = found.filter("in_collection")
    return found if viewer == user else found.filter("NOT private")


def collect(pointers: DataFrame, now: Column) -> DataFrame:
    """The pointers, all collected; the collection time of those that weren't is now."""
    return pointers.withColumn("created_at", F.when(F.col("in_collection"), F.col("created_at")).otherwise(now)).withColumn("in_collection", F.lit(True))


def followees(follows: DataFrame, user: int) -> DataFrame:
    return follows.filter(F.col("follower") == user).select(F.col("followee").alias("user_id")).distinct()


def visible_lists(lists: DataFrame, follows: DataFrame, viewer: int, with_owned: bool = True, super_ids: tuple[int, ...] = ()) -> DataFrame:
    """Public lists, friends' lists if the viewer follows their owner (or the owner is everybody's friend), and own ones."""
    friends = followees(follows, viewer).select(F.col("user_id").alias("owner_id")).withColumn("_friend", F.lit(True))
    joined = lists.join(friends, "owner_id", "left")
    friend = F.coalesce("_friend", F.lit(False)) | F.col("owner_id").isin(list(super_ids))
    others = (F.col("availability") == PUBLIC) | ((F.col("availability") == FRIENDS) & friend)
    own = F.col("owner_id") == viewer
    return joined.filter(others | own if with_owned else others & ~own).drop("_friend")


def list_contents(taggings: DataFrame, lists: DataFrame, pulled: DataFrame, viewer: int) -> DataFrame:
    """list_id, entity_type, entity_id, each once: taggings of a list's name tag by its owner or the viewer, and of its pulled-in tags by anyone."""
    columns = ["list_id", "entity_type", "entity_id"]
    named = lists.select("list_id", F.col("owner_id").alias("user_id"), F.col("name_tag").alias("tag"))
    by_owner = taggings.join(named, ["tag", "user_id"])
    by_viewer = taggings.filter(F.col("user_id") == viewer).join(named.drop("user_id"), "tag")
    # who tagged doesn't matter to what is pulled in: each tagged entity once before the join multiplies it
    tagged = taggings.select("tag", "entity_type", "entity_id").distinct()
    drawn = tagged.join(pulled.join(lists.filter("pullin").select("list_id"), "list_id", "left_semi"), "tag")
    return by_owner.select(columns).unionByName(by_viewer.select(columns)).unionByName(drawn.select(columns)).distinct()


def list_sizes(taggings: DataFrame, lists: DataFrame, pulled: DataFrame, viewer: int, tagged: DataFrame | None = None) -> DataFrame:
    """list_id, entities: how many rows list_contents has for each list, without making them; lists that hold nothing are left out.

    Lists that pull in the same tags draw the same entities, which are found and counted once; to these come the entities of the name tag
    that aren't among them. tagged: tag, entity_type, entity_id of all taggings, if it is known more cheaply.
    """
    entity = ["entity_type", "entity_id"]
    users = lists.select(F.col("owner_id").alias("user_id")).union(lists.sparkSession.range(1).select(F.lit(viewer).alias("user_id"))).distinct()
    theirs = taggings.join(users, "user_id", "left_semi").select("user_id", "tag", *entity)
    names = lists.select("list_id", F.col("name_tag").alias("tag"), F.explode(F.array("owner_id", F.lit(viewer))).alias("user_id"))
    named = theirs.join(names, ["tag", "user_id"]).select("list_id", *entity).distinct()
    sources = pulled.join(lists.filter("pullin"), "list_id", "left_semi").groupBy("list_id").agg(F.array_sort(F.collect_set("tag")).alias("_tags"))
    each = sources.select("_tags").distinct().select("_tags", F.explode("_tags").alias("tag"))
    drawn = each.join((taggings if tagged is None else tagged).select("tag", *entity).distinct(), "tag").select("_tags", *entity).distinct()
    counts = sources.join(drawn.groupBy("_tags").agg(F.count("*").alias("n")), "_tags").select("list_id", "n")
    more = named.join(sources, "list_id", "left").join(drawn, ["_tags", *entity], "left_anti").groupBy("list_id").agg(F.count("*").alias("n"))
    return counts.unionByName(more).groupBy("list_id").agg(F.sum("n").alias("entities"))


def first_claim(candidates: DataFrame, key: str, rank: str = "rank") -> DataFrame:
    """For each key the row of the least rank: owned before contributed before friends' before public."""
    return candidates.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(rank))).filter("_n = 1").drop("_n")


def load_ordering(text: Column) -> Column:
    """The stored ordering of a list, lines of `id:1<tab>klass:Part`, as an array of structs."""
    lines = F.filter(F.split(text, r"\\n|\n"), lambda line: line != "")
    fields = F.transform(lines, lambda line: F.str_to_map(line, F.lit("\t"), F.lit(":")))
    return F.transform(fields, lambda m: F.struct(F.element_at(m, "klass").alias("klass"), F.element_at(m, "id").cast("long").alias("id")))


def dump_ordering(ordering: Column) -> Column:
    return F.array_join(F.transform(ordering, lambda x: F.concat(F.lit("id:"), x["id"].cast("string"), F.lit("\tklass:"), x["klass"])), "\n")


def store(ordering: Column, klass: str, entity: Column) -> Column:
    """The ordering with an entity at its end, unless it is there."""
    return F.array_union(ordering, F.array(F.struct(F.lit(klass).alias("klass"), entity.cast("long").alias("id"))))


def remove(ordering: Column, klass: str, entity: Column) -> Column:
    return F.filter(ordering, lambda x: ~((x["klass"] == klass) & (x["id"] == entity)))


def remap(rows: DataFrame, column: str, mapping: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with ids replaced by those they were merged into (mapping: old, new); rows that become equal by `keys` once."""
    mapped = rows.join(mapping.select(F.col("old").alias("_old"), F.col("new").alias("_new")), rows[column] == F.col("_old"), "left")
    return mapped.withColumn(column, F.coalesce("_new", column)).drop("_old", "_new").dropDuplicates(keys)


def absorb(pointers: DataFrame, mapping: DataFrame) -> DataFrame:
    """Pointers after entities were merged: one for a user and entity; flags are joined, the first comment that isn't blank stays."""
    mapped = pointers.join(mapping.select(F.col("old").alias("_old"), F.col("new").alias("_new")), F.col("entity_id") == F.col("_old"), "left")
    own_first = F.struct(F.when(F.trim("comment") != "", 0).otherwise(1).alias("blank"), F.col("_new").isNotNull().alias("moved"), "entity_id")
    return (
        mapped.withColumn("target", F.coalesce("_new", "entity_id"))
        .groupBy("user_id", "target")
        .agg(
            F.bool_or("in_collection").alias("in_collection"),
            F.bool_and("private").alias("private"),
            F.min_by("comment", own_first).alias("comment"),
            F.min("created_at").alias("created_at"),
            F.max("updated_at").alias("updated_at"),
        )
        .withColumnRenamed("target", "entity_id")
    )


def upsert(target: DataFrame, changes: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Target rows and changes, the latest of each key (a change wins over a target row of the same time)."""
    both = target.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    order = Window.partitionBy(*keys).orderBy(F.col(at).desc_nulls_last(), F.desc("_new"))
    return both.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n", "_new")


def dependents(entities: DataFrame, key: str, references: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """key, kind, uses: what refers to each entity, by the kind of what does; entities to which nothing refers have one row without a kind.

    references: for each kind a table and its column. Each is counted before it meets the entities, however often it names one.
    """
    counted = [rows.filter(F.col(c).isNotNull()).groupBy(F.col(c).cast(entities.schema[key].dataType).alias(key)).agg(F.count("*").alias("uses")).select(key, F.lit(kind).alias("kind"), "uses") for kind, (rows, c) in references.items()]
    return entities.select(key).distinct().join(reduce(DataFrame.unionByName, counted), key, "left").select(key, "kind", F.coalesce("uses", F.lit(0)).alias("uses"))
