"""Files that settings and dictionaries are kept in, and the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names. Only a local session, which has one machine, gets a folder here."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="tagloom-shared-")
        spark.sparkContext.setCheckpointDir(folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written in the shared folder and read again: what several steps use is computed once, and lost executors cost no more than a step."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def export_settings(settings: DataFrame, path: str, key: str) -> None:
    """Settings as JSON lines, ordered by key within and across files."""
    settings.orderBy(key).write.mode("overwrite").json(path)


def import_settings(current: DataFrame, path: str, key: str) -> DataFrame:
    """Current settings with those of a file: rows of the file replace or join rows of the same key."""
    new = current.sparkSession.read.schema(current.schema).json(path)
    return current.join(new, key, "left_anti").unionByName(new.select(current.columns))


def tag_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """line, name, tagtype, url of a CSV dictionary whose first column lists synonyms between semicolons."""
    rows = spark.read.schema("names string, tagtype string, url string").csv(path)
    named = rows.select(F.sha2(F.concat_ws("|", "names", "tagtype", "url"), 256).alias("line"), F.explode(F.split("names", ";")).alias("name"), "tagtype", "url")
    return named.withColumn("name", F.trim("name")).filter("name <> ''")


def server_events(rows: DataFrame, event: str) -> DataFrame:
    """Rows as frames of a server-sent event stream."""
    return rows.select(F.concat(F.lit(f"event: {event}\ndata: "), F.to_json(F.struct(*rows.columns)), F.lit("\n\n")).alias("frame"))
