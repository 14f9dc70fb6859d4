"""The bin of each value among many edges: a join of two tables by range, without comparing each with each.

Edges and values are dealt out to buckets by quantiles of the values. Within a bucket both stand in one order and each value takes
the last edge before it; values below a bucket's first edge take the greatest edge of the buckets before. A bucket that holds
many equal values, or is large for other reasons, is dealt to several tasks, its edges to each of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType
from pyspark.sql.window import Window

#: Buckets at most, and rows of one from which it is dealt to several tasks.
BUCKETS, ROWS = 1024, 1_000_000


def bin_of_each(values: DataFrame, value: str, edges: DataFrame, edge: str, buckets: int | None = None, rows: int = ROWS) -> DataFrame:
    """values with `bin`: the greatest edge that is at most the value; null where there is none, or no value.

    Values that aren't a number (NaN) lie above all numbers. Null edges count for nothing, repeated ones once.
    """
    spark = values.sparkSession
    n = buckets or min(BUCKETS, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    kind = values.schema[value].dataType
    edges = edges.select(F.col(edge).cast(kind).alias("_edge")).filter("_edge IS NOT NULL").distinct()
    cuts = values.agg(F.percentile_approx(value, [i / n for i in range(1, n)], 10_000).alias("q")).first()["q"] if n > 1 else []
    cuts = sorted({c for c in cuts or [] if c is not None and c == c})  # n numbers at most

    at = F.lit(cuts).cast(ArrayType(kind)) if cuts else None
    steps = [1 << i for i in reversed(range(len(cuts).bit_length()))]

    def bucket(c):
        """Cuts that aren't above a value, by halving: a fold over the steps, so that the expression doesn't double with each."""
        if not cuts:
            return F.lit(0)
        return F.aggregate(F.lit(steps), F.lit(0), lambda found, step: F.when((found + step <= len(cuts)) & (F.get(at, found + step - 1) <= c), found + step).otherwise(found))

    placed = values.withColumn("_bucket", bucket(F.col(value)))
    edged = edges.withColumn("_bucket", bucket(F.col("_edge")))
    # a row for each bucket: how many tasks it takes, and the greatest edge before it
    counts = {r[0]: r[1] for r in placed.groupBy("_bucket").count().collect()}
    greatest = {r[0]: r[1] for r in edged.groupBy("_bucket").agg(F.max("_edge")).collect()}
    table, before = [], None
    for b in range(len(cuts) + 1):
        table.append((b, max(1, -(-counts.get(b, 0) // rows)), before))
        before = greatest.get(b, before)
    table = F.broadcast(spark.createDataFrame(table, f"_bucket int, _parts int, _before {kind.simpleString()}"))  # a row a bucket
    names = values.columns
    left = placed.join(table, "_bucket", "left").select(*names, "_bucket", F.floor(F.rand(7) * F.col("_parts")).cast("int").alias("_part"), "_before", F.col(value).alias("_at"), F.lit(1).alias("_kind"))
    right = edged.join(table, "_bucket").select("_bucket", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"), F.col("_edge").alias("_at"), F.lit(0).alias("_kind"))
    order = Window.partitionBy("_bucket", "_part").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = left.unionByName(right, allowMissingColumns=True).withColumn("_last", F.last(F.when(F.col("_kind") == 0, F.col("_at")), ignorenulls=True).over(order))
    return met.filter("_kind = 1").select(*names, F.when(F.col("_at").isNotNull(), F.coalesce("_last", "_before")).alias("bin"))
