"""Centroid clustering against comparing everything with everything, in Python integers."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from tagloom.llm import centroids

SCHEMA = "vec_id long, embedding array<double>, cluster string, distance int"


def plain(rows, k, rounds, dim, scale=1024.0):
    """(vec_id, cluster, distance) by full comparison, and the final centroids."""
    most = centroids.limit(dim)
    kept = [(i, [math.floor(max(-most, min(most, scale * x))) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    seeds = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    at = [v for _, v in seeds]

    def assign():
        out = []
        for _, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in at]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        owners = [j for j, _ in assign()]
        for j in range(len(at)):
            mine = [v for (_, v), o in zip(kept, owners) if o == j]
            if mine:
                at[j] = [sum(c) // len(mine) for c in zip(*mine)]
    return sorted(((i, j, d) for (i, _), (j, d) in zip(kept, assign())), key=repr), at


def same(spark, rows, k, rounds, dim):
    df = spark.createDataFrame([(i, v, "x", 0) for i, v in rows], SCHEMA).repartition(3)
    found = centroids.cluster(df, k, rounds, dim)
    want, at = plain(rows, k, rounds, dim)
    assert sorted(map(tuple, found.rows.collect()), key=repr) == want
    assert found.centroids == at
    return found


def test_clustering_equals_full_comparison(spark):
    rng = random.Random(3)
    spots = [[rng.uniform(-1, 1) for _ in range(6)] for _ in range(9)]
    rows = [(i, [c + rng.gauss(0, 0.2) for c in spots[i % 9]]) for i in range(3000)]
    found = same(spark, rows, 8, 10, 6)
    assert found.looked[0] == 3000 and sum(found.looked[3:]) < 8 * 3000 / 2  # bounds spare full comparisons


def test_ties_go_to_the_smaller_number(spark):
    rows = [(i, [float(x) / 1024, float(y) / 1024]) for i, (x, y) in enumerate((x, y) for x in range(-4, 5) for y in range(-4, 5))]
    same(spark, rows * 2, 4, 6, 2)
    same(spark, [(i, [0.5, 0.5]) for i in range(20)], 3, 2, 2)  # all alike: equal centroids, two of them empty


def test_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.1, 0.2]), (1, [0.1, 0.2]), (None, [0.3, -0.2]), (2, None), (3, []), (4, [0.1]), (5, [nan, 0.0]), (6, [inf, 0.0]), (7, [None, 0.1]), (8, [1e300, -1e300]), (9, [-0.00001, 0.0])]
    found = same(spark, rows, 8, 3, 2)
    assert found.rows.count() == 5 and len(found.centroids) == 4
    empty = spark.createDataFrame([], SCHEMA)
    found = centroids.cluster(empty)
    assert found.rows.count() == 0 and found.centroids == []
    one = same(spark, [(5, [0.25, 0.5])], 1, 2, 2)
    assert one.centroids == [[256, 512]]


def test_large_components_are_exact(spark):
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-3e5, 3e5) for _ in range(64)]) for i in range(60)]
    same(spark, rows, 4, 3, 64)


def test_reassign_never_misses_a_nearer_centroid():
    rng = np.random.default_rng(1)
    x = rng.integers(-50, 50, (400, 3))
    at = [c.tolist() for c in rng.integers(-50, 50, (7, 3))]
    owner, upper, lower = centroids.scan(x, np.array(at))
    for _ in range(20):
        before, at = at, [[v + int(rng.integers(-3, 4)) for v in c] for c in at]
        owner, upper, lower, _ = centroids.reassign(x, owner, upper, lower, centroids.centres(at, before))
        d = ((x[:, None, :] - np.array(at)[None]) ** 2).sum(2)
        assert (owner == d.argmin(1)).all()
        d.sort(axis=1)
        assert (upper**2 >= d[:, 0]).all() and (np.maximum(lower, 0) ** 2 <= d[:, 1]).all()


def test_rounds_join_without_a_shuffle(spark, monkeypatch):
    plans, write = [], centroids._Tables.write

    def watched(self, df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return write(self, df, name)

    monkeypatch.setattr(centroids._Tables, "write", watched)
    rows = [(i, [i / 100, -i / 50], "", 0) for i in range(200)]
    before = {t.name for t in spark.catalog.listTables()}
    centroids.cluster(spark.createDataFrame(rows, SCHEMA), 3, 4, 2)
    rounds = [p for name, p in plans if name == "centroid-bounds"]
    assert len(rounds) == 5 and not any("Exchange" in p for p in rounds)
    assert {t.name for t in spark.catalog.listTables()} == before


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, sf):
    folder = f"/root/testdata/{sf}"
    found = sorted(map(tuple, centroids.query(spark, folder).collect()))
    with duckdb.connect() as con:
        con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
        assert found == sorted(con.sql(centroids.ORACLE).fetchall())
