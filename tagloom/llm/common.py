"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import os
import sys
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the session's checkpoint folder. Only a local session, which has one machine, gets one here."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir()
    if not found:
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and sc.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        found = found or tempfile.mkdtemp(prefix="spark-checkpoint-")
        sc.setCheckpointDir(found)
        found = sc.getCheckpointDir()
    return found


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Deletes what a job wrote in the shared folder and nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: cuts the lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of an Arrow batch that goes to a Python worker: texts are long, and both sides hold a batch or two.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def on_workers(spark: SparkSession) -> None:
    """Ships this package to Python workers that don't find it on their path, and keeps the batches they get small."""
    if int(spark.conf.get(_BATCH).rstrip("bB") or 0) > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if root in map(os.path.abspath, filter(None, paths)) or getattr(spark.sparkContext, "_tagloom_shipped", False):
        return
    import zipfile

    path = os.path.join(tempfile.mkdtemp(prefix="tagloom-"), "tagloom.zip")
    with zipfile.ZipFile(path, "w") as out:
        for top, _, names in os.walk(os.path.join(root, "tagloom")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(top, name)
                    out.write(full, os.path.relpath(full, root))
    spark.sparkContext.addPyFile(path)
    spark.sparkContext._tagloom_shipped = True
    if root not in sys.path:
        sys.path.insert(0, root)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo `modulus`; a null key's is that of the empty text (0)."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


#: Bits of the hash by which samples are cut, and of each of the two histograms that find where.
_CUT_BITS, _ROUND_BITS = 24, 12


def least_hashed(rows: DataFrame, group: str, key: str, n: int) -> DataFrame:
    """About n rows of each group (all, if it has fewer): those whose keys have the least hashes. Groups must be few.

    Two histograms by group and bits of the hash find the greatest hash up to which a group has n rows at
    most, so no task ranks a group. Rows whose keys have the same hash stay or go together; the first ones always stay.
    """
    hashed = rows.withColumn("_h", F.pmod(F.xxhash64(F.lit(1), F.col(key)), F.lit(1 << _CUT_BITS)))
    limits: dict = {}

    def cut(part: DataFrame, shift: int, before: dict) -> dict:
        """Per group: the bucket in which its n-th row lies (None: it has no more than n), and the rows before it."""
        found: dict = {}
        for g, b, count in sorted(part.groupBy(group, F.shiftright("_h", shift).alias("_b")).count().collect(), key=lambda r: r[1]):  # a row for each group and bucket
            at, total = found.setdefault(g, (None, before.get(g, 0)))
            if at is None:
                found[g] = (b, total) if total + count > n else (None, total + count)
        return found

    first = cut(hashed, _CUT_BITS - _ROUND_BITS, {})
    full = {g: x for g, x in first.items() if x[0] is not None}
    if not full:
        return rows
    spark = rows.sparkSession
    kind = rows.schema[group].dataType.simpleString()
    bounds = spark.createDataFrame([(g, int(b)) for g, (b, _) in full.items()], f"{group} {kind}, _first long")
    inside = hashed.join(F.broadcast(bounds), group).filter(F.shiftright("_h", _CUT_BITS - _ROUND_BITS) == F.col("_first"))
    for g, (b, total) in cut(inside, 0, {g: x[1] for g, x in full.items()}).items():
        limits[g] = b if total == 0 else b - 1  # never an empty sample
    limits = spark.createDataFrame([(g, int(x)) for g, x in limits.items()], f"{group} {kind}, _limit long")
    return hashed.join(F.broadcast(limits), group, "left").filter(F.col("_limit").isNull() | (F.col("_h") <= F.col("_limit"))).select(*rows.columns)


#: Cut points that are taken from the data; finer ranges divide the room between two of them evenly.
MOST_BOUNDS = 1024


def range_bounds(ids: DataFrame, key: str, parts: int) -> list[int]:
    """Ascending cut points, the least and the greatest key among them, that split a long column into about `parts` equal
    ranges, MOST_BOUNDS at most. One pass over the key alone; the result's size doesn't follow the input's.
    """
    n = max(1, min(parts, MOST_BOUNDS))
    at = [i / n for i in range(n + 1)]
    found = ids.agg(F.percentile_approx(key, at, 10 * max(n, 1000)).alias("q")).first()["q"]
    return sorted(set(found or []))


def range_shard(rows: DataFrame, key: str, parts: int) -> Column:
    """A number for each row that ascends with a long column (nulls first) and parts rows into shards of about equal size: rows of a key that
    holds several shards' worth (or without a key) are dealt out by their place in the table, in no order among themselves.
    """
    n = max(1, min(parts, MOST_BOUNDS))
    found = rows.agg(F.percentile_approx(key, [i / n for i in range(n + 1)], 10 * max(n, 1000)).alias("q"), F.count("*").alias("n"), F.count_if(F.col(key).isNull()).alias("without")).first()
    cuts = found["q"] or []
    bounds = sorted(set(cuts))
    hot = {b: c for b in bounds if (c := cuts.count(b)) > 2}  # as often as it holds ranges
    without = max(1, round(parts * found["without"] / max(1, found["n"])))
    spread = max([without, *hot.values()]) + 1
    bucket = range_bucket(F.col(key), bounds, parts) if len(bounds) > 1 else F.when(F.col(key).isNull(), 0).otherwise(1)
    dealt = F.monotonically_increasing_id()
    place = F.when(F.col(key).isNull(), dealt % without)
    for b, c in hot.items():
        place = place.when(F.col(key) == b, dealt % c)
    return (bucket * spread + place.otherwise(spread - 1)).cast("int")


def range_bucket(key: Column, bounds: list[int], parts: int) -> Column:
    """A bucket of about `parts` (null keys: 0) that ascends with the key."""
    if len(bounds) < 2:
        return F.lit(0)
    edges = F.array(*[F.lit(b).cast("long") for b in bounds])
    coarse = F.size(F.filter(edges, lambda e: e <= key))
    splits = -(-parts // (len(bounds) - 1))
    if splits < 2:
        return F.when(key.isNull(), 0).otherwise(coarse)
    low, high = F.get(edges, coarse - 1), F.get(edges, coarse)
    fine = F.floor((key - low).cast("double") / (high - low).cast("double") * splits).cast("int")
    return F.when(key.isNull(), 0).otherwise(coarse * splits + F.coalesce(F.least(fine, F.lit(splits - 1)), F.lit(0)))


def schema_with(df: DataFrame, more: str) -> StructType:
    """df's schema and further fields, given as DDL."""
    return StructType([*df.schema.fields, *StructType.fromDDL(more).fields])
