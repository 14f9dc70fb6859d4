"""Feed entries: incremental ingestion without repeats, publishing times made sensible, high-water marks."""

from __future__ import annotations

import hashlib

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType
from pyspark.sql.window import Window


def fresh(entries: DataFrame, known: DataFrame | None) -> DataFrame:
    """Entries whose guid its feed doesn't have yet, each once (the first to be published)."""
    order = Window.partitionBy("feed_id", "guid").orderBy(F.col("published_at").asc_nulls_last(), "title")
    once = entries.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")
    return once if known is None else once.join(known.select("feed_id", "guid"), ["feed_id", "guid"], "left_anti")


def timed(entries: DataFrame, now: Column) -> DataFrame:
    """Publishing times that are missing or lie ahead become now, less a second for each such entry of the feed before it."""
    odd = F.col("published_at").isNull() | (F.col("published_at") > now)
    n = F.row_number().over(Window.partitionBy("feed_id", odd).orderBy("guid")) - 1
    return entries.withColumn("published_at", F.when(odd, now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), n.cast("decimal(18,6)"))).otherwise(F.col("published_at")))


def high_water(entries: DataFrame) -> DataFrame:
    return entries.groupBy("feed_id").agg(F.max("published_at").alias("last_post"), F.count("*").alias("entries"))


def entries_since(entries: DataFrame, marks: DataFrame) -> DataFrame:
    """Entries that were published after their feed's mark (all, if it has none)."""
    return entries.join(marks, "feed_id", "left").filter(F.col("last_post").isNull() | (F.col("published_at") > F.col("last_post"))).drop("last_post")


def stale(marks: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Feeds whose last post is older than so many days, or that have none."""
    return marks.filter(F.col("last_post").isNull() | (F.col("last_post") < now - F.make_dt_interval(F.lit(days))))


#: Folders of a batch, each with the feeds of one hash.
BUCKETS = 64


def _bucket() -> Column:
    return F.pmod(F.xxhash64("feed_id"), F.lit(BUCKETS)).cast("int")


def _table(spark: SparkSession, schema: StructType | str, target: str) -> DataFrame:
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return spark.read.schema(StructType([*schema.fields, *StructType.fromDDL("run string, epoch bigint, bucket int").fields])).parquet(target)


def ingested(spark: SparkSession, schema: StructType | str, target: str) -> DataFrame:
    """The table that `ingest` writes: the entries' columns, and run and epoch of the batch that added them."""
    return _table(spark, schema, target).drop("bucket")


def ingest(stream: DataFrame, target: str, checkpoint: str, now: str) -> StreamingQuery:
    """Appends a stream's new entries to a table in files; what it holds already is left out, however old.

    A batch's folder bears the checkpoint's name and the batch's number: run again after a failure, a
    batch finds what all others have added and writes its own folder anew, and another checkpoint adds to the table.
    Within it entries lie in buckets of feeds, so a small batch reads the keys of its own feeds' buckets, not of the whole table.
    """
    spark = stream.sparkSession
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def add(batch: DataFrame, epoch: int) -> None:
        path = spark._jvm.org.apache.hadoop.fs.Path(target)
        known = None
        batch = batch.persist(StorageLevel.DISK_ONLY)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):  # the keys alone are read
            own = [r[0] for r in batch.select(_bucket().alias("b")).distinct().collect()]  # BUCKETS numbers at most
            known = _table(spark, batch.schema, target).filter(F.col("bucket").isin(own) & ((F.col("run") != run) | (F.col("epoch") != epoch)))
        new = timed(fresh(batch, known), F.lit(now).cast("timestamp_ntz")).withColumn("bucket", _bucket())
        new.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/run={run}/epoch={epoch}")
        batch.unpersist()

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_seen(stream: DataFrame, delay: str = "7 days") -> DataFrame:
    """A stream's entries each once, as long as repeats come within the delay: bounded state, for endless feeds."""
    return stream.withWatermark("seen_at", delay).dropDuplicatesWithinWatermark(["feed_id", "guid"])


def event_counts(stream: DataFrame, size: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Events by type in windows of event time, late ones within the delay included."""
    return stream.withWatermark("ts", delay).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
