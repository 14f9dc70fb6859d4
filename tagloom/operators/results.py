"""Results of searches kept in a table across requests and sessions, with their full size.

Rows of a result lie in a partition of their own, named by the search's key, ranked from 1. A search is built when it is first asked for, or
when a source table has changed since; its partition alone is replaced (dynamic partition overwrite), so others, and writers of others,
are left alone. A mark of the sources' files (bytes, number, time of the last change) is taken before the search is built and kept
with its size, so a change during the build makes the result stale, not wrong. Windows of a search read its partition alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files
from .scopes import ranked
from .search import Search


def mark(spark: SparkSession, paths: list[str]) -> str:
    """The state of tables on disk: bytes, files and the time of the last change of each; changes with every write."""
    found = []
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        store = place.getFileSystem(spark._jsc.hadoopConfiguration())
        all_of = store.getContentSummary(place)
        found.append(f"{path}:{all_of.getLength()}:{all_of.getFileCount()}:{store.getFileStatus(place).getModificationTime()}")
    return hashlib.sha256("\n".join(found).encode()).hexdigest()


class Kept:
    """Results below a path. build: the rows of a search; order: what they are ranked by; sources: paths of the tables that they come from."""

    def __init__(self, spark: SparkSession, path: str, build: Callable[[Search], DataFrame], order: Callable[[Search], list[Column]], sources: list[str]):
        self.spark, self.path, self.build, self.order, self.sources = spark, path, build, order, sources

    @staticmethod
    def key(asked: Search) -> str:
        """Equal for searches that differ in their window alone."""
        return hashlib.sha256(repr(replace(asked, offset=0, limit=0)).encode()).hexdigest()[:32]

    def _size(self, key: str) -> tuple[str, int] | None:
        """Mark and full size of a kept result."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/sizes/search={key}")
        if not place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place):
            return None
        row = self.spark.read.schema("mark string, size long").parquet(f"{self.path}/sizes/search={key}").first()
        return tuple(row) if row else None

    def _replace(self, rows: DataFrame, name: str) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("search").parquet(f"{self.path}/{name}")

    def ensure(self, asked: Search) -> int:
        """Builds the search's result if there is none or its sources changed; its full size."""
        key, now = self.key(asked), mark(self.spark, self.sources)
        known = self._size(key)
        if known and known[0] == now:
            return known[1]
        rows = self.build(asked).withColumn("search", F.lit(key))
        placed = ranked(rows, ["search"], self.order(asked), files.shared_path(self.spark, "ranked")).withColumn("rank", F.col("rank") + 1)
        placed = files.stored(placed, "kept")
        size = placed.count()
        if size:
            self._replace(placed, "rows")
        self._replace(self.spark.createDataFrame([(now, size, key)], "mark string, size long, search string"), "sizes")
        return size

    def window(self, asked: Search) -> DataFrame:
        """The rows of the search's window, with their ranks and the result's full size."""
        size = self.ensure(asked)
        if not size:
            return self.build(asked).limit(0).withColumn("rank", F.lit(0).cast("long")).withColumn("full_size", F.lit(0).cast("long"))
        rows = self.spark.read.parquet(f"{self.path}/rows/search={self.key(asked)}")
        return rows.filter((F.col("rank") > asked.offset) & (F.col("rank") <= asked.offset + asked.limit)).withColumn("full_size", F.lit(size).cast("long"))


def full_size(kept: Kept | None, asked: Search, scopes: list[DataFrame]) -> int:
    """Of a kept result its size; otherwise the rows of the search's scopes."""
    known = kept._size(kept.key(asked)) if kept else None
    return known[1] if known else sum(s.count() for s in scopes)
