"""Nested data of no fixed schema, as variants: parsed once, read by path, walked level by level in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import files


def parsed(text: Column) -> Column:
    """JSON as a variant; null where it isn't JSON."""
    return F.try_parse_json(text)


def value_at(document: Column, path: str, kind: str) -> Column:
    """The value at a path ($.a.b[0]) as a type; null where there is none, or where it is no such value."""
    return F.try_variant_get(document, path, kind)


def schema_of(documents: DataFrame, column: str) -> str:
    """The schema that all documents of a column fit, as DDL."""
    return documents.agg(F.schema_of_variant_agg(column)).first()[0]  # one text


def collect_key(docs: DataFrame, key: str, document: str, name: str, also: tuple[str, ...] = ()) -> DataFrame:
    """key, columns that are asked for also, vals: all values under a name anywhere in each JSON document, as JSON texts; documents that aren't JSON (or null) have null.

    A value stands before those within it; the members of an object come in the order of their names. One step a level of the deepest document. Documents
    and what is found in them meet by grouping: a join would send all of one side through the driver, for the size of a few columns beside a variant is underrated.
    """
    spark = docs.sparkSession
    rows = files.stored(docs.select(key, *also, F.monotonically_increasing_id().alias("_row"), parsed(F.col(document)).alias("_v")), "variants")
    level = rows.filter("_v IS NOT NULL").select("_row", F.array().cast("array<int>").alias("_path"), "_v")
    parts = []
    while True:
        inner = level.lateralJoin(spark.tvf.variant_explode(F.col("_v").outer())).select("_row", F.concat("_path", F.array("pos")).alias("_path"), F.col("key").alias("_key"), F.col("value").alias("_v"))
        level = files.stored(inner, "variants")
        if level.isEmpty():
            break
        parts.append(level.filter(F.col("_key") == name).select("_row", "_path", F.to_json("_v").alias("_json")))
    empty = F.array().cast("array<string>")
    if not parts:
        return rows.select(key, *also, F.when(F.col("_v").isNotNull(), empty).alias("vals"))
    whole = rows.select("_row", F.struct(key, *also, F.col("_v").isNotNull().alias("_is")).alias("_of"))
    hits = reduce(DataFrame.unionByName, parts).select("_row", F.struct("_path", "_json").alias("_hit"))
    found = whole.unionByName(hits, allowMissingColumns=True).groupBy("_row").agg(F.first("_of", ignorenulls=True).alias("_of"), F.array_sort(F.collect_list("_hit")).alias("_hits"))
    return found.select(*[F.col(f"_of.`{c}`").alias(c) for c in (key, *also)], F.when(F.col("_of._is"), F.transform("_hits", lambda x: x["_json"])).alias("vals"))
