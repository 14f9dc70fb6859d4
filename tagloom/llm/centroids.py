"""Centroid clustering of integer vectors, with Hamerly's bounds.

Each vector keeps two numbers from round to round: an upper bound of its distance to its own centroid and
a lower bound of its distance to the second nearest. When centroids move, the first grows by the way of
its own centroid and the second shrinks by the longest way of the others. A vector whose upper bound
is below its lower bound, or below half the way from its centroid to the next one, stays where it is
without being looked at. The others first have their own distance measured; those that are still ambiguous are
held against all centroids, in integers. Bounds are rounded outwards, and equal bounds count as ambiguous,
so the result is that of comparing everything with everything.

Vectors lie in blocks in a table bucketed by block, written once; the bounds lie in a small table of
their own, bucketed alike, so that a round joins the two without a shuffle and writes the bounds alone. A block
also gives the sums of the vectors that changed their cluster; the centroids' sums follow from these. Each
round's bounds are written before the next round reads them, so lost executors cost one round at most; older
ones are deleted. What reaches the driver is `k` centroids and their sums.

Vectors of another length, null, or with null or non-finite components take no part. Components beyond
`limit(dim)` (2**27 for 64 components) count as that number, so squared distances fit a long; sums of distances
beyond a long count as the greatest long. Null ids take part but never seed; equal ids seed in the order of
their vectors; fewer vectors than `k` give as many clusters. Repeated rows count as rows of their
own. Empty tables give no rows. Other columns aren't read, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections import namedtuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Vectors of a block, and of a bucket of blocks.
BLOCK_ROWS, BUCKET_ROWS = 1024, 1 << 20
#: Spark's own limit of buckets.
MOST_BUCKETS = 100_000
#: Every bound is rounded outwards by this share.
SLACK = 1e-12
GREATEST = (1 << 63) - 1

#: One round's centroids: integer coordinates, half the way to the next centroid, own way and longest way of the others since last round.
Centres = namedtuple("Centres", "at half way others")
Clusters = namedtuple("Clusters", "rows centroids looked")


def limit(dim: int) -> int:
    """Greatest magnitude of a component for which squared distances of `dim` components fit a long."""
    return 1 << ((62 - (dim - 1).bit_length()) // 2 - 1)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of x to rows of c, both int64."""
    dim = x.shape[1]
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if dim * most * most < 1 << 50:  # all sums are integers that float64 holds
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)
    out = np.empty((len(x), len(c)), np.int64)
    for j in range(len(c)):
        d = x - c[j]
        out[:, j] = (d * d).sum(1)
    return out


def own_squared(x: np.ndarray, c: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Exact squared distance of each row of x to the row of c that owns it."""
    d = x - c[owner]
    return (d * d).sum(1)


def centres(at: list[list[int]], before: list[list[int]] | None) -> Centres:
    def way(a, b) -> float:
        return math.sqrt(sum((p - q) ** 2 for p, q in zip(a, b)))

    k = len(at)
    half = [min((way(a, b) for j, b in enumerate(at) if j != i), default=math.inf) / 2 * (1 - SLACK) for i, a in enumerate(at)]
    moved = [way(a, b) * (1 + SLACK) for a, b in zip(at, before)] if before else [0.0] * k
    others = [max((w for j, w in enumerate(moved) if j != i), default=0.0) for i in range(k)]
    return Centres(np.array(at, np.int64).reshape(k, -1), np.array(half), np.array(moved), np.array(others))


def scan(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner (ties: the smaller number), upper and lower bound of each row by full comparison."""
    d = squared(x, c)
    owner = d.argmin(axis=1)  # the first of equal ones
    rows = np.arange(len(x))
    upper = np.sqrt(d[rows, owner].astype(np.float64)) * (1 + SLACK)
    if len(c) < 2:
        return owner, upper, np.full(len(x), np.inf)
    d[rows, owner] = GREATEST
    return owner, upper, np.sqrt(d.min(axis=1).astype(np.float64)) * (1 - SLACK)


def reassign(x: np.ndarray, owner: np.ndarray, upper: np.ndarray, lower: np.ndarray, now: Centres) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """A round: owners and bounds after the centroids moved, and how many rows were held against all of them."""
    upper = (upper + now.way[owner]) * (1 + SLACK)
    lower = lower - now.others[owner]
    lower -= np.abs(lower) * SLACK
    owner = owner.copy()
    at = np.flatnonzero(~(upper < np.maximum(lower, now.half[owner])))
    if len(at):
        upper[at] = np.sqrt(own_squared(x[at], now.at, owner[at]).astype(np.float64)) * (1 + SLACK)
        at = at[~(upper[at] < np.maximum(lower[at], now.half[owner[at]]))]
    if len(at):
        owner[at], upper[at], lower[at] = scan(x[at], now.at)
    return owner, upper, lower, len(at)


def _blocks(dim: int):
    """Rows of (id, vector) as blocks with a number of their own."""

    def run(batches):
        first, made = TaskContext.get().partitionId() << 36, 0
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(lo, BLOCK_ROWS)
                x = np.asarray(part.column(1).flatten(), dtype=np.int64).reshape(-1, dim)
                ids = pa.array([part.column(0).to_pylist()], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([first + made]), ids, pa.array([x.astype("<i4").tobytes()], pa.binary())], ["block", "ids", "vecs"])
                made += 1

    return run


_STATE = "block long, owner binary, upper binary, lower binary, looked long, change array<struct<cluster:int,n:long,sums:array<long>>>"
_CHANGE = pa.list_(pa.struct([("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))]))


def _rows(batch: pa.RecordBatch, dim: int):
    """(block, vectors, owner, upper, lower) of each row; without bounds in the first round."""
    names = batch.schema.names
    for i in range(batch.num_rows):
        value = {c: batch.column(c)[i].as_py() for c in names if c not in ("ids", "change")}
        x = np.frombuffer(value["vecs"], "<i4").reshape(-1, dim).astype(np.int64)
        if "owner" in value:
            yield i, value["block"], x, np.frombuffer(value["owner"], "<i4").astype(np.int64), np.frombuffer(value["upper"], "<f8"), np.frombuffer(value["lower"], "<f8")
        else:
            yield i, value["block"], x, None, None, None


def _round(dim: int, now: Centres):
    """Bounds after a round, with the sums of what came to and left each cluster."""

    def run(batches):
        for batch in batches:
            for _, block, x, before, upper, lower in _rows(batch, dim):
                if before is None:
                    (owner, upper, lower), looked, moved = scan(x, now.at), len(x), np.arange(len(x))
                else:
                    owner, upper, lower, looked = reassign(x, before, upper, lower, now)
                    moved = np.flatnonzero(owner != before)
                change = []
                for j in np.unique(np.concatenate((owner[moved], before[moved] if before is not None else owner[:0]))).tolist():
                    came, left = moved[owner[moved] == j], moved[before[moved] == j] if before is not None else moved[:0]
                    change.append({"cluster": j, "n": len(came) - len(left), "sums": (x[came].sum(0) - x[left].sum(0)).tolist()})
                columns = [pa.array([block]), *[pa.array([v], pa.binary()) for v in (owner.astype("<i4").tobytes(), upper.astype("<f8").tobytes(), lower.astype("<f8").tobytes())], pa.array([looked]), pa.array([change], _CHANGE)]
                yield pa.RecordBatch.from_arrays(columns, ["block", "owner", "upper", "lower", "looked", "change"])

    return run


def _members(dim: int, now: Centres):
    """One row a vector: id, cluster and exact squared distance."""

    def run(batches):
        for batch in batches:
            for i, _, x, owner, _, _ in _rows(batch, dim):
                columns = [batch.column("ids")[i].values, pa.array(owner.astype(np.int32)), pa.array(own_squared(x, now.at, owner))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "cluster", "distance"])

    return run


class _Tables:
    """Tables bucketed by block, in the shared folder; gone() drops one with its files."""

    def __init__(self, spark: SparkSession, buckets: int):
        self.spark, self.buckets, self.open = spark, buckets, {}

    def write(self, df: DataFrame, name: str) -> str:
        path, table = common.new_path(self.spark, name), f"tagloom_{uuid.uuid4().hex}"
        self.open[table] = path
        df.write.format("parquet").bucketBy(self.buckets, "block").option("path", path).saveAsTable(table)
        return table

    def gone(self, *tables: str) -> None:
        for table in tables or tuple(self.open):
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
            common.discard(self.spark, self.open.pop(table))


def kept(df: DataFrame, key: str, vector: str, dim: int, scale: float) -> DataFrame:
    """id and vec (integers) of the vectors that take part."""
    most = float(limit(dim))
    finite = F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform("_v", lambda x: F.floor(F.greatest(F.least(x * F.lit(float(scale)), F.lit(most)), F.lit(-most))).cast("int"))
    chosen = df.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("_v"))
    return chosen.filter((F.size("_v") == dim) & finite).select("id", whole.alias("vec"))


def cluster(df: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: float = 1024.0, key: str = "vec_id", vector: str = "embedding", seed: Column | None = None) -> Clusters:
    """rows: id, cluster, distance of every vector after `rounds` rounds; centroids: integer coordinates; looked: rows held against all centroids, by round.

    seed: an expression on `id`; the k vectors with its smallest values are the first centroids.
    """
    spark = df.sparkSession
    common.on_workers(spark)
    vectors = kept(df, key, vector, dim, scale)
    seed = F.sha2(F.concat(F.lit("3:"), F.col("id").cast("string")).cast("binary"), 256) if seed is None else seed
    at = [list(r["vec"]) for r in vectors.filter("id IS NOT NULL").orderBy(seed, "vec").limit(k).collect()]  # k rows
    if not at:
        return Clusters(spark.createDataFrame([], "id long, cluster int, distance long"), [], [])
    buckets = min(MOST_BUCKETS, max(common.shuffle_partitions(spark), -(-df.count() // BUCKET_ROWS)))
    tables = _Tables(spark, buckets)
    try:
        blocks = vectors.mapInArrow(_blocks(dim), "block long, ids array<long>, vecs binary").repartition(buckets, "block")
        blocks, state, before, looked = tables.write(blocks, "centroid-blocks"), None, None, []
        sums, counts = [[0] * dim for _ in at], [0] * len(at)

        def joined(columns: list[str]) -> DataFrame:
            """Blocks with their bounds, bucket by bucket."""
            found = spark.table(blocks).select(*columns)
            return found if state is None else found.join(spark.table(state).select("block", "owner", "upper", "lower").hint("shuffle_hash"), "block")

        for done in range(rounds + 1):
            now = centres(at, before)
            after = tables.write(joined(["block", "vecs"]).mapInArrow(_round(dim, now), _STATE), "centroid-bounds")
            if state:
                tables.gone(state)
            state = after
            written = spark.table(state)
            looked.append(written.agg(F.sum("looked")).first()[0])
            if done == rounds:
                break
            changes = written.select(F.explode("change").alias("c")).select("c.cluster", F.posexplode(F.concat(F.array("c.n"), F.col("c.sums"))).alias("i", "v"))
            for r in changes.groupBy("cluster", "i").agg(F.sum(F.col("v").cast("decimal(20,0)")).alias("v")).collect():  # k times (dim + 1) numbers
                if r["i"]:
                    sums[r["cluster"]][r["i"] - 1] += int(r["v"])
                else:
                    counts[r["cluster"]] += int(r["v"])
            before, at = at, [[s // n for s in own] if n else old for own, n, old in zip(sums, counts, at)]
        rows = common.stored(joined(["block", "ids", "vecs"]).mapInArrow(_members(dim, now), "id long, cluster int, distance long"), "centroid-members")
    finally:
        tables.gone()
    return Clusters(rows, at, looked)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cluster(common.table(spark, sf_dir, "embeddings"))
    whole = F.least(F.sum(F.col("distance").cast("decimal(20,0)")), F.lit(GREATEST).cast("decimal(38,0)")).cast("long")
    inertia = {r[0]: r[1] for r in found.rows.groupBy("cluster").agg(whole).collect()}  # k rows
    total = min(sum(inertia.values()), GREATEST)
    marks = [(j, inertia.get(j), total, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(found.centroids)]
    marks = spark.createDataFrame(marks, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.rows.withColumnRenamed("id", "vec_id").join(F.broadcast(marks), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows


def _oracle(k: int = 8, rounds: int = 10, dim: int = 64) -> str:
    most = limit(dim)
    parts = [
        f"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: greatest(least(floor(1024 * CAST(x AS DOUBLE)), {most}), -{most})) AS e
  FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY h, e) - 1 AS INTEGER) AS cluster, e AS c
  FROM (SELECT sha256('3:' || CAST(vec_id AS VARCHAR)) AS h, e FROM v WHERE vec_id IS NOT NULL ORDER BY h, e LIMIT {k}))""",
    ]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (
  SELECT r, min(struct_pack(d := CAST(list_inner_product(e, e) - 2 * list_inner_product(e, c) + list_inner_product(c, c) AS BIGINT), k := cluster)) AS m
  FROM v, c{i} GROUP BY r)""")
        if i < rounds:
            parts.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT o.cluster, coalesce(n.c, o.c) AS c FROM c{i} o LEFT JOIN (
    SELECT k, list(s ORDER BY p) AS c FROM (
      SELECT m.k AS k, p, floor(sum(e[p]) / count(*)) AS s FROM a{i} JOIN v USING (r), range(1, {dim + 1}) AS t(p) GROUP BY ALL) GROUP BY k) n
  ON o.cluster = n.k)""")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, m.k AS cluster, m.d AS distance, CAST(sum(m.d) OVER (PARTITION BY m.k) AS BIGINT) AS cluster_inertia,
  CAST(sum(m.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(list_transform(c, lambda x: CAST(x AS BIGINT)), ',')) AS centroid_sha256
FROM v JOIN a{rounds} USING (r) JOIN c{rounds} ON m.k = cluster"""


ORACLE = _oracle()
