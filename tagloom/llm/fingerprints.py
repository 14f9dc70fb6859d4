"""Document fingerprints by consistent weighted sampling, with DataFrame functions alone.

A text's terms are its pairs of neighbouring words (the last word pairs with nothing), weighted by
how often they occur. For each of the samples k, a term draws r, c ~ Gamma(2, 1) and b ~ Uniform(0, 1)
from its hash; with weight w it gets t = floor(ln(w) / r + b) and a = c * exp(-r * (t + 1 - b)), and
the text's sample is the term (with its t) of the least a. Two texts draw the same sample with
probability sum(min(w)) / sum(max(w)), their generalised Jaccard similarity; the share of equal
samples estimates it.

r * b and r * (1 - b) are independent exponential variables, so two uniform numbers u, v give r, b
and exp(-r * (1 - b)) = u at once, and a = u * c * exp(-r * t): for w = 1 (t = 0) one logarithm does.
The least a itself serves as the sample, for it tells term and t apart. A fingerprint holds 16 bits
of each sample's hash as four hexadecimal digits.

Rows are dealt into buckets of consecutive ids. In its bucket, every row sees the next one; the
last sees a copy of the next bucket's first row (of the first bucket's, if it is the last row).
A bucket's texts, terms and samples stay in one task, which holds a bounded part of the rows; rows that repeat an id
lie in one bucket, however many they are (ids are thought to be different).

Cases: null texts count as empty; an empty text has one term, the empty word, so all empty texts
have equal fingerprints. Null ids come first. Rows with the same id are ordered by their texts. A
single row is its own next row. Columns other than id and text are not carried. An empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

SAMPLES = 64
#: Buckets for each task of a shuffle.
BUCKETS_PER_TASK = 3
#: ASCII white space.
_SPACE = r"[\x09-\x0D\x20]+"


def _unit(h: Column, at: int, bits: int) -> Column:
    """`bits` bits of a hash as a number between 0 and 1."""
    return (F.shiftrightunsigned(h, at).bitwiseAND(F.lit((1 << bits) - 1)).cast("double") + 0.5) * F.lit(1.0 / (1 << bits))


def draw(term: Column, weight: Column, k: int) -> Column:
    """a of a hashed term in sample k."""
    h = F.xxhash64(term, F.lit(k))
    u, v = _unit(h, 0, 22), _unit(h, 22, 12)
    c = -F.log(_unit(h, 34, 15) * _unit(h, 49, 15))
    rb, r = -F.log(v), -F.log(u * v)  # r = r b + r (1 - b)
    t = F.floor((F.log(weight.cast("double")) + rb) / r).cast("double")
    return u * c * F.when(weight == 1, F.lit(1.0)).otherwise(F.exp(-r * t))


def terms(words: Column) -> Column:
    """Pairs of neighbouring words, as an array of structs."""
    return F.arrays_zip(words.alias("x"), F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1))).alias("y"))


def _with_next(docs: DataFrame, parts: int) -> DataFrame:
    """bucket, n (place in it), ghost, doc_id, text, next: ghosts are first rows of other buckets."""
    spark = docs.sparkSession
    buckets = parts * BUCKETS_PER_TASK
    bounds = common.range_bounds(docs, "doc_id", buckets)
    dealt = docs.withColumn("bucket", common.range_bucket(F.col("doc_id"), bounds, buckets))
    least = F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "text"))  # null ids first
    firsts = dealt.groupBy("bucket").agg(least.alias("f")).select("bucket", "f.doc_id", F.xxhash64("f.text").alias("h"))
    firsts = sorted(((r["bucket"], r["doc_id"], r["h"]) for r in firsts.collect()), key=lambda r: r[0])  # one row a bucket
    targets = [(b, i, h, firsts[j - 1][0]) for j, (b, i, h) in enumerate(firsts)]
    targets = F.broadcast(spark.createDataFrame(targets, "bucket int, first_id long, h long, target int"))
    first = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.xxhash64("text") == F.col("h"))
    ghosts = dealt.join(targets, "bucket").filter(first).groupBy("target").agg(F.min("first_id").alias("doc_id"), F.min("text").alias("text"))  # one row a bucket
    placed = dealt.select("bucket", F.lit(False).alias("ghost"), "doc_id", "text").unionByName(ghosts.select(F.col("target").alias("bucket"), F.lit(True).alias("ghost"), "doc_id", "text"))
    order = Window.partitionBy("bucket").orderBy("ghost", F.col("doc_id").asc_nulls_first(), "text")
    return (
        placed.repartition(parts, "bucket")
        .withColumn("next", F.lead("text").over(order))
        .withColumn("n", F.row_number().over(order))
    )


def _edited(text: Column, following: Column) -> Column:
    """The last quarter of the code points replaced by the next text's first."""
    size = F.length(text)
    return F.concat(F.substring(text, F.lit(1), size - F.floor(size / 4).cast("int")), F.substring(F.coalesce(following, F.lit("")), F.lit(1), F.floor(size / 4).cast("int")))


def signatures(rows: DataFrame, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """keys, old, new: samples (16 bits each) of the texts in columns text and edited.

    rows must be partitioned by some of the keys; then nothing is shuffled. Terms that both texts
    hold with the same weight are drawn once for both.
    """
    words = F.explode(F.array(*[F.struct(F.lit(v).alias("v"), F.split(text, _SPACE).alias("words")) for v, text in enumerate(("text", "edited"))]))
    both = rows.select(*keys, words.alias("e")).select(*keys, F.col("e.v").alias("v"), F.explode(terms(F.col("e.words"))).alias("p"))
    counts = both.groupBy(*keys, F.xxhash64("p.x", "p.y").alias("term")).agg(F.sum(1 - F.col("v")).alias("w0"), F.sum("v").alias("w1"))

    def side(of: int, w: Column) -> Column:
        return F.struct(F.lit(of).alias("of"), w.alias("w"))

    w0, w1 = F.col("w0"), F.col("w1")
    sides = F.when(w0 == w1, F.array(side(3, w0))).when(w0 == 0, F.array(side(2, w1))).when(w1 == 0, F.array(side(1, w0))).otherwise(F.array(side(1, w0), side(2, w1)))
    drawn = counts.select(*keys, "term", F.explode(sides).alias("s")).select(*keys, "term", "s.of", "s.w")
    least = drawn.groupBy(*keys, "of").agg(*[F.min(draw(F.col("term"), F.col("w"), k)).alias(f"a{k}") for k in range(samples)])
    found = least.groupBy(*keys).agg(*[F.min(F.when(F.col("of").bitwiseAND(bit) != 0, F.col(f"a{k}"))).alias(f"{name}{k}") for name, bit in (("o", 1), ("n", 2)) for k in range(samples)])

    def packed(name: str) -> Column:
        return F.array(*[F.xxhash64(F.col(f"{name}{k}")).bitwiseAND(F.lit(0xFFFF)).cast("int") for k in range(samples)])

    return found.select(*keys, packed("o").alias("old"), packed("n").alias("new"))


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """The share of equal samples."""
    return sum((F.get(a, F.lit(k)) == F.get(b, F.lit(k))).cast("int") for k in range(samples)) / F.lit(float(samples))


def text_of(signature: Column, samples: int = SAMPLES) -> Column:
    return F.concat(*[F.lower(F.lpad(F.hex(F.get(signature, F.lit(k))), 4, "0")) for k in range(samples)])


def fingerprint(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row of docs (doc_id, text)."""
    parts = 4 * common.shuffle_partitions(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = _with_next(docs, parts).withColumn("edited", _edited(F.col("text"), F.col("next")))
    found = signatures(rows, ["bucket", "n"], samples)
    found = found.withColumn("following", F.lead("old").over(Window.partitionBy("bucket").orderBy("n")))
    named = rows.filter(~F.col("ghost")).select("bucket", "n", "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited"), 256).alias("edited_sha256"))
    return named.join(found, ["bucket", "n"]).select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        text_of(F.col("old"), samples).alias("fingerprint"),
        text_of(F.col("new"), samples).alias("edited_fingerprint"),
        likeness(F.col("old"), F.col("new"), samples).alias("near_edited"),
        likeness(F.col("old"), F.col("following"), samples).alias("near_next"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint(common.table(spark, sf_dir, "documents"))
