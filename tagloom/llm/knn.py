"""Exact top-k inner products by a Voronoi join.

Queries and candidates fall into the cells of a few pivots. One pass sums each cell up: how many
vectors, how far they lie from the pivot, and how long they are. No inner product of a query with a
vector of a cell exceeds its product with the pivot plus its length times the cell's radius, nor the product
of its length with the cell's longest. Each query first meets a few vectors (PROBES of each of the
cells that promise most): the k-th best of these is a score that its results reach, and only cells
whose bound reaches it get the query. So queries, the smaller side, are replicated, and to necessary
cells alone. Both sides are packed into blocks of bounded size, whatever a cell holds (it may be a third of all
rows); blocks of queries are sent to all tasks if all of them together are small, else both sides
are dealt out by pairs of blocks. A task multiplies two blocks at a time and keeps each query's k
best scores that reach its bound.

Vectors that are null, empty, or hold null or non-finite components take no part; neither do null
ids. Vectors of different lengths are never compared. A query never meets rows of its own id. Equal
scores go to the smaller id; repeated rows count as rows of their own. Scores are exact while inner
products stay below 2**53. Empty tables give no rows. Rows that repeat a query's id ask one question together and share its k results.
Other columns aren't carried, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

PIVOTS = 32
#: Vectors of a cell that queries meet first, and cells whose vectors they meet so.
PROBES, PROBED = 256, 2
BLOCK_ROWS = 8192
QUERY_ROWS = 2048
#: Bytes of all blocks of queries up to which they are sent to every task.
BROADCAST_BYTES = 64 << 20
#: Rows of scores that a task holds at a time.
CHUNK = 256


def integer_vectors(df: DataFrame, key: str, vector: str, scale: float = 64.0) -> DataFrame:
    """id, dim and vec (float64 bytes of floor(scale * x)) of the vectors that take part."""

    def run(batches):
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            keep, dims, raws = [], [], []
            if isinstance(lists, pa.ChunkedArray):
                lists = lists.combine_chunks()
            flat = lists.values
            values = np.floor(scale * np.asarray(flat.cast(pa.float64()).to_numpy(zero_copy_only=False), dtype=np.float64))
            good = np.isfinite(values)
            edges = np.asarray(lists.offsets)
            valid = np.asarray(lists.is_valid()) & np.asarray(ids.is_valid())
            for i, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
                if valid[i] and b > a and good[a:b].all():
                    keep.append(i)
                    dims.append(b - a)
                    raws.append(values[a:b].tobytes())
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(keep, pa.int64())), pa.array(dims, pa.int32()), pa.array(raws, pa.binary())], ["id", "dim", "vec"])

    chosen = df.select(F.col(key).cast("long"), F.col(vector).cast("array<double>"))
    return chosen.mapInArrow(run, "id long, dim int, vec binary")


def _assign(pivots: dict[int, np.ndarray]):
    """Adds cell (of the nearest pivot), dist (from it) and norm."""

    def run(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            raws = batch.column("vec").to_pylist()
            cell, dist, norm = np.zeros(len(dims), np.int32), np.zeros(len(dims)), np.zeros(len(dims))
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                x = np.frombuffer(b"".join(raws[i] for i in at), dtype="<f8").reshape(len(at), d)
                p = pivots[int(d)]
                # exact enough to choose by; the distance itself is taken from the difference
                near = np.argmin((p * p).sum(1)[None, :] - 2 * (x @ p.T), axis=1)
                cell[at] = near
                dist[at] = np.sqrt(((x - p[near]) ** 2).sum(1))
                norm[at] = np.sqrt((x * x).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(dist), pa.array(norm)], [*batch.schema.names, "cell", "dist", "norm"])

    return run


def _matrix(raws: list[bytes], dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(raws), dtype="<f8").reshape(len(raws), dim)


def bounds(q: np.ndarray, pivots: np.ndarray, radius: np.ndarray, longest: np.ndarray) -> np.ndarray:
    """For each query (row) and cell a number that no inner product of theirs exceeds."""
    norm = np.sqrt((q * q).sum(1))[:, None]
    found = np.minimum(q @ pivots.T + norm * radius[None, :], norm * longest[None, :])
    return found + 1e-9 * np.abs(found) + 1e-6


def reached(q: np.ndarray, ids: np.ndarray, probes: list[tuple[np.ndarray, np.ndarray]], pivots: np.ndarray, k: int) -> np.ndarray:
    """For each query a score that its k best reach (-inf if it met fewer): the k-th best of the vectors met.

    probes: ids and vectors of each cell. Each query meets those of the PROBED cells with the largest products with their pivots.
    """
    best = np.full((len(q), k), -np.inf)
    promising = np.argsort(-(q @ pivots.T), axis=1)[:, :PROBED]
    for cell, (own, x) in enumerate(probes):
        at = np.flatnonzero((promising == cell).any(axis=1))
        if not len(at) or not len(own):
            continue
        score = q[at] @ x.T
        score[ids[at, None] == own[None, :]] = -np.inf
        best[at] = -np.sort(-np.concatenate((best[at], score), axis=1), axis=1)[:, :k]
    return best[:, -1] - 1e-12 * np.abs(best[:, -1])


def _replicate(pivots: dict, cells: dict, probes: dict, k: int):
    """A row of each query for every cell that may hold one of its results, with the score that these reach."""

    def run(batches):
        for batch in batches:
            dims, ids = batch.column("dim").to_numpy(), batch.column("id").to_numpy()
            raws = batch.column("vec").to_pylist()
            for d in np.unique(dims).tolist():
                mine = np.flatnonzero(dims == d)
                for lo in range(0, len(mine), CHUNK):
                    at = mine[lo : lo + CHUNK]
                    q = _matrix([raws[i] for i in at], d)
                    least = reached(q, ids[at], probes[d], pivots[d], k)
                    i, cell = np.nonzero((bounds(q, pivots[d], *cells[d]) >= least[:, None]) & (cells[d][0] >= 0)[None, :])
                    columns = [batch.column(c).take(pa.array(at[i])) for c in ("id", "dim", "vec", "row")]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(cell.astype(np.int32)), pa.array(least[i])], ["id", "dim", "vec", "row", "cell", "least"])

    return run


def _pack(rows: pd.DataFrame) -> pd.DataFrame:
    """One row for a block: ids in ascending order, the scores that they reach, and the vectors, in the smallest type that holds them."""
    rows = rows.sort_values("id", kind="stable")
    x = np.frombuffer(b"".join(rows["vec"]), dtype="<f8")
    top = np.abs(x).max() if len(x) else 0
    kind = "<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<f8"
    first = rows.iloc[0]
    return pd.DataFrame({"dim": [first["dim"]], "cell": [first["cell"]], "block": [first["block"]], "kind": [kind], "ids": [rows["id"].to_numpy("<i8").tobytes()], "least": [rows["least"].to_numpy("<f8").tobytes()], "vecs": [x.astype(kind).tobytes()]})


def _top(queries: np.ndarray, query_ids: np.ndarray, least: np.ndarray, data: np.ndarray, ids: np.ndarray, k: int):
    """For each query its k best of data that reach its least score, as (query, id, score); ids ascend."""
    k = min(k, len(ids))
    n = len(ids)
    for lo in range(0, len(query_ids), CHUNK):
        score = queries[lo : lo + CHUNK] @ data.T
        score[query_ids[lo : lo + CHUNK, None] == ids[None, :]] = -np.inf
        finite = score[np.isfinite(score)]
        if not len(finite):
            continue
        if np.abs(finite).max() * n < 2.0**52:
            order = score * n - np.arange(n)  # all different, ties in favour of smaller ids
            best = np.argpartition(-order, k - 1, axis=1)[:, :k]
        else:
            best = np.argsort(-score, axis=1, kind="stable")[:, :k]
        found = np.take_along_axis(score, best, axis=1)
        q = np.repeat(query_ids[lo : lo + CHUNK], k)
        keep = (np.isfinite(found) & (found >= least[lo : lo + CHUNK, None])).ravel()
        yield q[keep], ids[best.ravel()][keep], found.ravel()[keep].astype(np.int64)


def _solve(k: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                d = row["dim"]
                q = np.frombuffer(row["q_vecs"], row["q_kind"]).reshape(-1, d).astype(np.float64)
                x = np.frombuffer(row["vecs"], row["kind"]).reshape(-1, d).astype(np.float64)
                for a, b, s in _top(q, np.frombuffer(row["q_ids"], "<i8"), np.frombuffer(row["q_least"], "<f8"), x, np.frombuffer(row["ids"], "<i8"), k):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(s)], ["query_id", "vec_id", "score"])

    return run


def _blocks(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """Rows of each cell as blocks; parts: how many blocks (dim, cell, _parts)."""
    return (
        rows.join(F.broadcast(parts), ["dim", "cell"])  # PIVOTS rows a vector length
        .withColumn("block", F.pmod(F.xxhash64("row"), F.col("_parts")).cast("int"))
        .groupBy("dim", "cell", "block")
        .applyInPandas(_pack, "dim int, cell int, block int, kind string, ids binary, least binary, vecs binary")
    )


def replicated(df: DataFrame, is_query: Column, k: int, key: str, vector: str, scale: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The vectors with their cells; the queries, once for each cell that they need; and per dim and cell how many blocks the two make."""
    spark = df.sparkSession
    common.on_workers(spark)
    vectors = integer_vectors(df, key, vector, scale)
    picked = vectors.withColumn("_h", F.xxhash64("id", "vec")).withColumn("_n", F.row_number().over(Window.partitionBy("dim").orderBy("_h", "id"))).filter(F.col("_n") <= PIVOTS)
    pivots: dict[int, list] = {}
    for r in picked.orderBy("dim", "_n").collect():  # PIVOTS rows a vector length
        pivots.setdefault(r["dim"], []).append(np.frombuffer(bytes(r["vec"]), "<f8"))
    pivots = {d: np.array(p) for d, p in pivots.items()}
    assigned = vectors.mapInArrow(_assign(pivots), "id long, dim int, vec binary, cell int, dist double, norm double")
    rows = common.stored(assigned.withColumn("is_query", F.coalesce(is_query, F.lit(False))).withColumn("row", F.monotonically_increasing_id()), "knn-cells")
    sums = rows.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("dist").alias("r"), F.max("norm").alias("l"), F.count(F.when(F.col("is_query"), 1)).alias("q")).collect()  # PIVOTS rows a length
    cells = {d: (np.full(len(p), -1.0), np.zeros(len(p))) for d, p in pivots.items()}  # radius (-1: no vectors), longest
    queries: dict[int, int] = {}
    for s in sums:
        cells[s["dim"]][0][s["cell"]], cells[s["dim"]][1][s["cell"]] = s["r"], s["l"]
        queries[s["dim"]] = queries.get(s["dim"], 0) + s["q"]
    few = rows.withColumn("_n", F.row_number().over(Window.partitionBy("dim", "cell").orderBy(F.xxhash64("row"), "row"))).filter(F.col("_n") <= PROBES)
    probes = {d: [([], []) for _ in p] for d, p in pivots.items()}
    for r in few.select("dim", "cell", "id", "vec").toLocalIterator():  # PROBES rows a cell
        own = probes[r["dim"]][r["cell"]]
        own[0].append(r["id"])
        own[1].append(bytes(r["vec"]))
    probes = {d: [(np.array(i, np.int64), _matrix(v, d)) for i, v in by_cell] for d, by_cell in probes.items()}
    asked = rows.filter("is_query").select("id", "dim", "vec", "row").mapInArrow(_replicate(pivots, cells, probes, k), "id long, dim int, vec binary, row long, cell int, least double")
    parts = [(s["dim"], s["cell"], -(-s["n"] // BLOCK_ROWS), -(-queries[s["dim"]] // QUERY_ROWS)) for s in sums if queries[s["dim"]]]
    return rows, asked, spark.createDataFrame(parts, "dim int, cell int, _data int, _asked int")


def top_k(df: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", scale: float = 64.0) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best rows. is_query: a condition on the column `id`."""
    rows, asked, parts = replicated(df, is_query, k, key, vector, scale)
    blocks = _blocks(rows.select("id", "dim", "cell", "vec", "row", F.lit(0.0).alias("least")), parts.select("dim", "cell", F.col("_data").alias("_parts")))
    asked = _blocks(asked, parts.select("dim", "cell", F.col("_asked").alias("_parts")))
    asked = common.stored(asked.select("dim", "cell", F.col("block").alias("q_block"), F.col("kind").alias("q_kind"), F.col("ids").alias("q_ids"), F.col("least").alias("q_least"), F.col("vecs").alias("q_vecs")), "knn-queries")
    size = asked.agg(F.sum(F.length("q_vecs") + F.length("q_ids") + F.length("q_least"))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        met = blocks.join(F.broadcast(asked), ["dim", "cell"])
    else:  # both sides once for each pair of blocks that meet
        pairs = asked.select("dim", "cell", "q_block").join(F.broadcast(parts), ["dim", "cell"]).select("dim", "cell", "q_block", F.explode(F.sequence(F.lit(0), F.col("_data") - 1)).alias("block"))
        met = asked.join(pairs, ["dim", "cell", "q_block"]).join(blocks.join(pairs, ["dim", "cell", "block"]), ["dim", "cell", "block", "q_block"])
    met = met.mapInArrow(_solve(k), "query_id long, vec_id long, score long")
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(common.table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, 20)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
  WHERE q.vec_id % 20 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
