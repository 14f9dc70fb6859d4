"""Mixing sources to target weights by hash-threshold histograms.

Every document has a hash of its id. A source that gives fewer words than it has takes its
documents with hashes up to a threshold; one that gives more takes all of them, and those up to the
threshold once more. The threshold is found without sorting: words are summed by source and hash
bucket, the bucket in which the budget ends is split into finer buckets by the next bits of the
hash, and so on until the hash has no more bits. The rows of the boundary buckets are stored after the
first round, and later rounds read these alone: all rows' sizes are read twice, whatever the number of rounds.

Targets: the share of all words that is to be taken is dealt to sources by weight; a target stops
at `repeats` times its source's words, and the excess is dealt out again until none is above.

The mix takes the largest set of documents, by ascending hash, that does not exceed the budget.
Documents with the same hash (the same id, repeated) go together; null ids hash as NULL_ID, so all
rows without an id go together too. Null texts have no words and null sources are a source of their
own, last in order. An empty table gives no rows. Columns of the table named like new ones (size, source_size, target, copies,
taken) are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Weights of sources in order of their names, repeating.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
REPEATS = 2
#: What a null id hashes as: the empty text, which no id is.
NULL_ID = ""
#: Bits of the hash, and of each round's histogram.
HASH_BITS = 60
ROUND_BITS = 12
#: Rows of all sources' histograms together in a round: with very many sources rounds take fewer bits.
HISTOGRAM_ROWS = 1 << 20
#: Sources up to which their targets are sent to every task; beyond it Spark joins by shuffle.
BROADCAST_SOURCES = 50_000


def hash60(key: Column) -> Column:
    """The first 60 bits of the md5 of the key as text (null: NULL_ID)."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(NULL_ID)).cast("binary")), 1, 15), 16, 10).cast("long")


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("long")


def targets(sizes: dict[str | None, int], weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> dict[str | None, float]:
    """Words to take from each source."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    rest, open_, found = share * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * rest / total > repeats * sizes[s]}
        if not full:
            return found | {s: weight[s] * rest / total for s in open_}
        for s in full:
            found[s] = float(repeats * sizes[s])
            rest -= repeats * sizes[s]
        open_ -= full
    return found


def thresholds(sized: DataFrame, repeats: int = REPEATS, share: float = SHARE, weights=WEIGHTS) -> DataFrame:
    """Per source: source_size, target, whole (times all documents are taken) and limit (of hashes taken once more).

    sized: source, size and _hash of every document, stored, for it is read in every round.
    """
    spark = sized.sparkSession
    sums = {r["source"]: r["n"] for r in sized.groupBy("source").agg(F.sum("size").alias("n")).collect()}  # one row a source
    goal = targets(sums, weights, share, repeats)
    state = {}
    for s, n in sums.items():
        whole = min(repeats, int(goal[s] // n)) if n else 0
        # prefix: the boundary bucket so far; room: words that it may still give
        state[s] = {"whole": whole, "prefix": 0, "room": goal[s] - whole * n, "done": whole == repeats or n == 0}
    bits = 0
    while bits < HASH_BITS and not all(x["done"] for x in state.values()):
        open_ = [(s, x["prefix"]) for s, x in state.items() if not x["done"]]
        step = max(1, min(ROUND_BITS, HASH_BITS - bits, (HISTOGRAM_ROWS // len(open_)).bit_length() - 1))
        bits += step
        shift = HASH_BITS - bits
        at = spark.createDataFrame(open_, "_source string, _prefix long")
        at = F.broadcast(at) if len(open_) <= BROADCAST_SOURCES else at
        bucket = F.shiftright("_hash", shift)
        inside = sized.join(at, sized["source"].eqNullSafe(at["_source"]) & (F.shiftright(bucket, step) == F.col("_prefix")))
        histogram: dict = {}
        for s, b, n in inside.groupBy("source", bucket.alias("_bucket")).agg(F.sum("size")).collect():  # HISTOGRAM_ROWS or two rows a source at most
            histogram.setdefault(s, []).append((b, n))
        for s, _ in open_:
            x = state[s]
            x["limit"] = (x["prefix"] + 1 << step + shift) - 1 if s in histogram else (x["prefix"] << step + shift) - 1
            for b, n in sorted(histogram.get(s, [])):
                if n > x["room"]:
                    x["prefix"], x["limit"] = b, (b << shift) - 1
                    break
                x["room"] -= n
            else:
                x["done"] = True
        split = [(s, x["prefix"]) for s, x in state.items() if not x["done"]]
        if bits == step and split and bits < HASH_BITS:
            kept = spark.createDataFrame(split, "_source string, _prefix long")
            kept = F.broadcast(kept) if len(split) <= BROADCAST_SOURCES else kept
            sized = common.stored(sized.join(kept, sized["source"].eqNullSafe(kept["_source"]) & (bucket == F.col("_prefix"))).select("source", "size", "_hash"), "mixing-boundary")
    rows = [(s, sums[s], float(goal[s]), x["whole"], x.get("limit", -1)) for s, x in state.items()]
    return spark.createDataFrame(rows, "_source string, source_size long, target double, _whole int, _limit long")


def mix(docs: DataFrame, repeats: int = REPEATS, share: float = SHARE, weights=WEIGHTS) -> DataFrame:
    """docs with size, source_size, target, copies and taken (copies times size)."""
    sized = docs.withColumn("size", words(F.col("text"))).withColumn("_hash", hash60(F.col("doc_id")))
    limits = thresholds(common.stored(sized.select("source", "size", "_hash"), "mixing-sizes"), repeats, share, weights)
    limits = F.broadcast(limits) if limits.count() <= BROADCAST_SOURCES else limits
    return (
        sized.join(limits, sized["source"].eqNullSafe(limits["_source"]))
        .withColumn("copies", F.col("_whole") + (F.col("_hash") <= F.col("_limit")).cast("int"))
        .withColumn("taken", F.col("copies") * F.col("size"))
        .drop("_source", "_whole", "_limit", "_hash")
    )


def take(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as many times as the mix takes it, with the columns of docs."""
    mixed = mix(docs, **options)
    return mixed.filter("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = """
WITH sized AS (
  SELECT doc_id, source, CAST(CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) END AS BIGINT) AS size,
         CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS h
  FROM documents),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS n FROM sized GROUP BY source),
weighed AS (
  SELECT source, n, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w,
         1.5::DOUBLE * (SELECT sum(n) FROM sums) AS budget
  FROM sums),
filled AS (
  SELECT *, budget - coalesce(sum(2 * n) OVER before, 0) AS rest, sum(w) OVER after AS open_w
  FROM weighed
  WINDOW before AS (ORDER BY 2.0 * n / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         after AS (ORDER BY 2.0 * n / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
cut AS (
  SELECT rest, open_w FROM filled WHERE NOT (w * rest / open_w > 2 * n) ORDER BY 2.0 * n / w, source NULLS LAST LIMIT 1),
goals AS (
  SELECT source, n, CASE WHEN (SELECT count(*) FROM cut) = 0 OR w * (SELECT rest FROM cut) / (SELECT open_w FROM cut) > 2 * n
                         THEN CAST(2 * n AS DOUBLE) ELSE CAST(w * (SELECT rest FROM cut) / (SELECT open_w FROM cut) AS DOUBLE) END AS target
  FROM weighed),
wholes AS (SELECT *, CASE WHEN n = 0 THEN 0 ELSE least(2, CAST(floor(target / n) AS BIGINT)) END AS whole FROM goals),
ranked AS (
  SELECT s.*, g.n, g.target, g.whole, g.target - g.whole * g.n AS room,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM sized s JOIN wholes g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, CAST(n AS BIGINT) AS source_size, target,
       CAST(size * (whole + CASE WHEN whole < 2 AND n > 0 AND upto <= room THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM ranked
"""
