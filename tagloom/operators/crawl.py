"""Crawls of many sites at once, each with a budget of pages of its own: breadth first, one stored level a step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources import files


def crawl(links: DataFrame, starts: DataFrame, budget: int = 10) -> DataFrame:
    """site, url, nth, step: the pages of each site that are visited, in order; at most `budget` a site.

    links: url, place, target (places order a page's links; pages without rows lead nowhere). starts: site, url. A page's links come
    in the order of their places, those of pages visited earlier first; a page is visited once. What a step has to rank
    for a site is bounded by the budget and the links of a page.
    """
    spark = starts.sparkSession
    links = files.stored(links.select("url", "place", "target").filter("url IS NOT NULL AND target IS NOT NULL"), "crawl-links")
    path = files.shared_path(spark, "crawl-visited")
    by_url = Window.partitionBy("site").orderBy("url")
    level = starts.select("site", "url").filter("url IS NOT NULL").distinct().withColumn("nth", F.row_number().over(by_url)).filter(F.col("nth") <= budget).withColumn("step", F.lit(0))
    step = 0
    while True:
        level = files.stored(level, "crawl-level")
        level.write.mode("append").parquet(path)
        visited = spark.read.schema(level.schema).parquet(path)
        if level.isEmpty():
            return visited
        step += 1
        so_far = visited.groupBy("site").agg(F.max("nth").alias("_before"))
        found = level.join(links, "url").groupBy("site", F.col("target").alias("url")).agg(F.min(F.struct("nth", "place")).alias("_at"))
        fresh = found.join(visited.select("site", "url"), ["site", "url"], "left_anti").withColumn("_n", F.row_number().over(Window.partitionBy("site").orderBy("_at", "url")))
        level = fresh.join(so_far, "site").withColumn("nth", (F.col("_before") + F.col("_n")).cast("int")).filter(F.col("nth") <= budget).select("site", "url", "nth", F.lit(step).alias("step"))
