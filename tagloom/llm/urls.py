"""URL filters: exact membership by a cascade of Bloom filters, and block and allow rules on top.

A Bloom filter of the listed keys also passes some keys that aren't listed. All keys that will ever
be asked for are at hand (they come from the corpus), so those false positives are known and form
the set of a second filter; the listed keys that the second one passes form the set of a third, and
so on until no mistake is left. Then the first level that doesn't pass a key tells whether it is
listed, for every key of the corpus, without a join and without an error.

Rules are pairs of a host and a path prefix. The keys of a url are its host's suffixes joined with
its path's prefixes, of those lengths alone that rules have; the longest key that is listed gives
the rule. Urls that are null or hold no `://` have an empty host and path and fit no rule; urls
without a rule are allowed. Columns of the caller that are named like results are replaced. Repeated rows stay; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Bits per key of the first level, and of the later ones (whose sets are fractions of the first).
FIRST_BITS, LATER_BITS = 12, 3
HASHES_FIRST, HASHES_LATER = 8, 2
#: Bits that the first level may have: a filter is sent to all tasks. Longer lists are joined instead.
MOST_BITS = 1 << 28
LEVELS = 64
_STEP = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Cascade:
    """Levels of bits; asked with two 64-bit hashes of a key."""

    levels: list[tuple[bytes, int, int]] = field(default_factory=list)  # bits, number of bits, hashes

    @staticmethod
    def positions(h1: np.ndarray, h2: np.ndarray, level: int, bits: int, hashes: int) -> np.ndarray:
        a, b = h1.astype(np.uint64), h2.astype(np.uint64) | np.uint64(1)
        with np.errstate(over="ignore"):
            a = a + np.uint64(level + 1) * _STEP * (b ^ (b >> np.uint64(29)))
            i = np.arange(hashes, dtype=np.uint64)[:, None]
            x = a[None, :] + i * b[None, :] + i * i * i
            x ^= x >> np.uint64(31)
            x *= _STEP
            x ^= x >> np.uint64(29)
        return x % np.uint64(bits)

    def passes(self, level: int, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        raw, bits, hashes = self.levels[level]
        table = np.frombuffer(raw, np.uint8)
        at = self.positions(h1, h2, level, bits, hashes)
        return ((table[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0)

    def contains(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Odd levels hold exceptions: a key is listed if the first level that doesn't pass it is one of those."""
        out = np.zeros(len(h1), bool)
        open_ = np.arange(len(h1))
        for level in range(len(self.levels)):
            ok = self.passes(level, h1[open_], h2[open_])
            out[open_[~ok]] = level % 2 == 1
            open_ = open_[ok]
        out[open_] = len(self.levels) % 2 == 1
        return out


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(key, F.lit(1)).alias("h2")]


def _bits(keys: DataFrame, level: int, bits: int, hashes: int) -> bytes:
    """The filter of all keys: each task sets bits in 64-bit words, words are joined by OR."""

    def run(batches):
        for part in batches:
            at = np.unique(Cascade.positions(part["h1"].to_numpy(), part["h2"].to_numpy(), level, bits, hashes))
            word = (at >> np.uint64(6)).astype(np.int64)
            bit = np.left_shift(np.uint64(1), at & np.uint64(63)).view(np.int64)
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(word) else []
            yield pd.DataFrame({"word": word[first], "bits": np.bitwise_or.reduceat(bit, first) if len(word) else bit})

    words = keys.select("h1", "h2").mapInPandas(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    table = np.zeros(-(-bits // 64), np.int64)
    found = words.toArrow()  # at most MOST_BITS / 64 rows
    table[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return table.tobytes()


def build(listed: DataFrame, universe: DataFrame) -> Cascade:
    """A cascade that is exact on `universe`. Both: distinct keys in a column `key`.

    Listed keys that the universe lacks can't be asked for and are left out.
    """
    spark = universe.sparkSession
    listed = F.broadcast(listed) if listed.count() <= 100_000 else listed
    marked = universe.join(listed.withColumn("_in", F.lit(True)), "key", "left")
    marked = common.stored(marked.select(*_hashes(F.col("key")), F.col("_in").isNotNull().alias("listed")), "cascade-keys")
    cascade = Cascade()
    inside, outside = marked.filter("listed"), marked.filter("NOT listed")
    for level in range(LEVELS):
        n = inside.count()
        if n == 0:
            break
        per, hashes = (FIRST_BITS, HASHES_FIRST) if level == 0 else (LATER_BITS, HASHES_LATER)
        bits = max(64, n * per)
        if bits > MOST_BITS:
            raise ValueError(f"{n} keys need more than {MOST_BITS} bits")
        cascade.levels.append((_bits(inside, level, bits, hashes), bits, hashes))
        passes = _passes(spark, cascade, level)
        # what this level passes by mistake is the next level's set; what it holds is what that one may mistake
        inside, outside = common.stored(outside.filter(passes), "cascade-level"), inside
    else:
        raise ValueError("the cascade doesn't end: keys with equal hashes are both listed and not")
    return cascade


def _passes(spark: SparkSession, cascade: Cascade, level: int) -> Column:
    shared = spark.sparkContext.broadcast(cascade)

    @F.pandas_udf("boolean")
    def test(h1: pd.Series, h2: pd.Series) -> pd.Series:
        return pd.Series(shared.value.passes(level, h1.to_numpy(), h2.to_numpy()))

    return test("h1", "h2")


def member(spark: SparkSession, cascade: Cascade, key: Column) -> Column:
    """Whether each key (null: no) is listed."""
    shared = spark.sparkContext.broadcast(cascade)

    @F.pandas_udf("boolean")
    def test(h1: pd.Series, h2: pd.Series) -> pd.Series:
        return pd.Series(shared.value.contains(h1.to_numpy(), h2.to_numpy()))

    return key.isNotNull() & test(*_hashes(key))


def listed(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """df with a column `listed` (in place of one of that name): whether its key is among `keys` (a column `key`).

    By a cascade; a list whose first level would be longer than MOST_BITS is joined.
    """
    keys = keys.select("key").filter("key IS NOT NULL").distinct()
    df = df.select(*[c for c in df.columns if c != "listed" or c == key])
    if keys.count() * FIRST_BITS > MOST_BITS:
        found = keys.select(F.col("key").alias("_listed_key"))
        return df.join(found, df[key] == found["_listed_key"], "left").withColumn("listed", F.col("_listed_key").isNotNull()).drop("_listed_key")
    universe = df.select(F.col(key).alias("key")).filter("key IS NOT NULL").distinct()
    return df.withColumn("listed", member(df.sparkSession, build(keys, universe), F.col(key)))


# ---------------------------------------------------------------------------------------- rules

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def candidates(host: Column, path: Column, shapes: list[tuple[int, int]]) -> list[tuple[int, Column]]:
    """The keys of a url, one for each shape (lengths of a rule's host and path); null where the url has none."""
    found = []
    for h, p in shapes:
        fits = (F.length(host) == h) | ((F.length(host) > h) & (F.substring(host, -(h + 1), 1) == "."))
        found.append((h + p, F.when(fits & (F.length(path) >= p), F.concat(F.substring(host, -h, h) if h else F.lit(""), F.substring(path, 1, p)))))
    return found


def judge(pages: DataFrame, block: list[tuple[str, str]], allow: list[tuple[str, str]]) -> DataFrame:
    """pages with host, path, rule and verdict, which take the place of columns of these names. Rules: (host, path prefix)."""
    spark = pages.sparkSession
    common.on_workers(spark)
    shapes = sorted({(len(h), len(p)) for h, p in [*block, *allow]}, key=lambda s: (-sum(s), -s[0]))
    own = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    parsed = pages.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(own)], host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    keys = [k for _, k in candidates(F.col("host"), F.col("path"), shapes)]
    universe = parsed.select(F.explode(F.array(*keys)).alias("key")).filter("key IS NOT NULL").distinct()
    universe = common.stored(universe, "url-keys")
    lists = {v: spark.createDataFrame([(h + p,) for h, p in rules] or [], "key string").distinct() for v, rules in (("block", block), ("allow", allow))}
    shared = spark.sparkContext.broadcast([build(lists[v], universe) for v in ("block", "allow")])

    @F.pandas_udf("int")
    def first_rule(*columns: pd.Series) -> pd.Series:
        """The first shape whose key is listed, times two, and one more if it is allowed; -1 if none is."""
        found = np.full(len(columns[0]), -1, np.int32)
        for i in range(len(columns) // 3):
            there, h1, h2 = (c.to_numpy() for c in columns[3 * i : 3 * i + 3])
            for j, cascade in enumerate(shared.value):
                at = np.flatnonzero((found < 0) & there.astype(bool))
                if len(at):
                    at = at[cascade.contains(h1[at], h2[at])]
                    found[at] = 2 * i + j
        return pd.Series(found)

    asked = [x for k in keys for x in (k.isNotNull(), *_hashes(k))]
    judged = parsed.withColumn("_first", first_rule(*asked) if keys else F.lit(-1))
    rule, verdict = F.lit(None).cast("string"), F.lit("allow")
    for i, key in enumerate(keys):
        rule = F.when(F.floor(F.col("_first") / 2) == i, key).otherwise(rule)
    verdict = F.when((F.col("_first") >= 0) & (F.col("_first") % 2 == 0), F.lit("block")).otherwise(verdict)
    return judged.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(own)], "host", "path", rule.alias("rule"), verdict.alias("verdict"))


#: The rules of the query: host and path prefix.
BLOCK = [("com", "/en/"), ("example.net", "/de/8"), ("org", "/es/")]
ALLOW = [("example.com", "/en/7"), ("net", "/de/")]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, BLOCK, ALLOW).select("page_id", "host", "path", "rule", "verdict")


ORACLE = """
WITH parsed AS (
  SELECT page_id,
         CASE WHEN contains(url, '://') THEN translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
fits AS (
  SELECT *, '.' || host AS h FROM parsed),
ruled AS (
  SELECT page_id, host, path,
         CASE WHEN ends_with(h, '.example.com') AND starts_with(path, '/en/7') THEN 'example.com/en/7'
              WHEN ends_with(h, '.example.net') AND starts_with(path, '/de/8') THEN 'example.net/de/8'
              WHEN ends_with(h, '.com') AND starts_with(path, '/en/') THEN 'com/en/'
              WHEN ends_with(h, '.net') AND starts_with(path, '/de/') THEN 'net/de/'
              WHEN ends_with(h, '.org') AND starts_with(path, '/es/') THEN 'org/es/' END AS rule
  FROM fits)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('com/en/', 'example.net/de/8', 'org/es/') THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""
