"""Streams give what batches give, whatever order files arrive in."""

import datetime as dt

from pyspark.sql import functions as F

from tagloom.streaming import feeds

AT = dt.datetime(2024, 1, 1)
SCHEMA = "feed_id long, guid long, title string, published_at timestamp_ntz"
NOW = "2024-02-01 00:00:00"


def entries(*rows):
    return [(f, g, f"t{f}.{g}", None if day is None else AT + dt.timedelta(days=day)) for f, g, day in rows]


FIRST, SECOND = entries((1, 1, 0), (1, 2, 1), (2, 1, None), (1, 1, 5)), entries((1, 2, 9), (1, 3, 90), (1, 4, 91), (2, 2, 3))


def test_times_are_made_sensible(spark):
    now = F.lit(NOW).cast("timestamp_ntz")
    found = {(r["feed_id"], r["guid"]): r["published_at"] for r in feeds.timed(spark.createDataFrame(SECOND, SCHEMA), now).collect()}
    assert found[1, 3] == dt.datetime(2024, 2, 1) and found[1, 4] == dt.datetime(2024, 1, 31, 23, 59, 59) and found[2, 2] == AT + dt.timedelta(days=3)


def test_stream_equals_batch(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    for n, rows in enumerate((FIRST, SECOND)):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(SCHEMA).parquet(str(source))
        feeds.ingest(stream, target, str(tmp_path / "checkpoint"), NOW).awaitTermination()
        assert n < 2
    got = feeds.ingested(spark, SCHEMA, target).drop("run", "epoch")
    first = feeds.fresh(spark.createDataFrame(FIRST, SCHEMA), None)
    now = F.lit(NOW).cast("timestamp_ntz")
    want = feeds.timed(first, now).unionByName(feeds.timed(feeds.fresh(spark.createDataFrame(SECOND, SCHEMA), first), now))
    key = lambda r: (r["feed_id"], r["guid"])
    assert sorted(got.collect(), key=key) == sorted(want.select(got.columns).collect(), key=key) and got.count() == 6
    marks = {r["feed_id"]: r["entries"] for r in feeds.high_water(got).collect()}
    assert marks == {1: 4, 2: 2}


def keys_of(spark, target):
    return sorted((r["feed_id"], r["guid"]) for r in feeds.ingested(spark, SCHEMA, target).collect())


def test_a_batch_run_again_loses_nothing(spark, tmp_path):
    source, target, checkpoint = tmp_path / "in", str(tmp_path / "out"), tmp_path / "checkpoint"
    for rows in (FIRST, SECOND):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
        feeds.ingest(spark.readStream.schema(SCHEMA).parquet(str(source)), target, str(checkpoint), NOW).awaitTermination()
    before = keys_of(spark, target)
    for commit in ("1", ".1.crc"):  # as if the driver had died before the last batch was committed
        (checkpoint / "commits" / commit).unlink(missing_ok=True)
    feeds.ingest(spark.readStream.schema(SCHEMA).parquet(str(source)), target, str(checkpoint), NOW).awaitTermination()
    assert keys_of(spark, target) == before and len(before) == 6


def test_a_new_checkpoint_adds_to_an_old_table(spark, tmp_path):
    target = str(tmp_path / "out")
    for n, rows in enumerate((FIRST, SECOND)):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in{n}"))
        feeds.ingest(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / f"in{n}")), target, str(tmp_path / f"checkpoint{n}"), NOW).awaitTermination()
    assert keys_of(spark, target) == [(1, 1), (1, 2), (1, 3), (1, 4), (2, 1), (2, 2)]


def test_entries_since(spark):
    rows = spark.createDataFrame(entries((1, 1, 0), (1, 2, 2), (2, 1, 0)), SCHEMA)
    marks = spark.createDataFrame([(1, AT + dt.timedelta(days=1))], "feed_id long, last_post timestamp_ntz")
    assert sorted((r["feed_id"], r["guid"]) for r in feeds.entries_since(rows, marks).collect()) == [(1, 2), (2, 1)]


def test_windowed_counts_and_first_seen(spark, tmp_path):
    events = [(AT, "view", 1.0), (AT + dt.timedelta(hours=5), "view", 2.0), (AT + dt.timedelta(days=3), "click", 1.0)]
    spark.createDataFrame(events, "ts timestamp, event_type string, value double").write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "e"))
    query = feeds.event_counts(stream).writeStream.format("memory").queryName("counted").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [(r["event_type"], r["n"], r["total"]) for r in spark.table("counted").collect()] == [("view", 2, 3.0)]
    spark.createDataFrame([(1, 1, AT), (1, 1, AT), (1, 2, AT)], "feed_id long, guid long, seen_at timestamp").write.parquet(str(tmp_path / "s"))
    seen = spark.readStream.schema("feed_id long, guid long, seen_at timestamp").parquet(str(tmp_path / "s"))
    query = feeds.first_seen(seen).writeStream.format("memory").queryName("seen").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("seen").count() == 2
