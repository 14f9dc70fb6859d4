"""Connected components of a link table, by contraction.

Each round, every node points to the neighbour (or itself) that comes first in a hashed order, and
links are redrawn between the nodes that were pointed to. The hashed order makes long chains of
ascending ids shrink by a constant factor, so rounds grow with the logarithm of the longest chain.
The pointers of all rounds, followed in turn, lead every node to its component's last node. Nothing
but counts reaches the driver; each round is written to the shared folder. Most rounds of a contraction have
hardly a link left, but cost the driver as many jobs, stages and tasks as the first ones do: the last FEW links
at most are joined up in one task.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

ROUNDS = 200
#: Links that one task joins up at most.
FEW = 10_000


def _first(node: Column) -> Column:
    return F.struct(F.xxhash64(node).alias("h"), node.alias("n"))


def _joined(batches):
    """node, to of every node of the links (a, b): its component's least node."""
    up: dict[int, int] = {}

    def top(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for batch in batches:
        for a, b in zip(*(c.to_pylist() for c in batch.columns)):
            x, y = top(a), top(b)
            up[max(x, y)] = min(x, y)
    nodes = list(up)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([top(x) for x in nodes], pa.int64())], ["node", "to"])


def components(links: DataFrame) -> DataFrame:
    """links: long columns a, b. Returns node, root of every node with a link to another one; root is one of the component's nodes.

    Links of a node to itself and those with a null end count for nothing; repeated links count once.
    """
    spark = links.sparkSession
    common.on_workers(spark)
    edges = common.stored(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    pointers: list[DataFrame] = []
    for _ in range(ROUNDS):
        left = edges.count()
        if left <= FEW:
            if left:
                pointers.append(common.stored(edges.coalesce(1).mapInArrow(_joined, "node long, to long"), "pointers"))
            break
        # each end meets the other; least hash first, the node itself included
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy("a").agg(F.min(_first(F.col("b"))).alias("f"))
        to = common.stored(first.select(F.col("a").alias("node"), F.least(_first(F.col("a")), F.col("f"))["n"].alias("to")), "pointers")
        pointers.append(to)
        moved = (
            edges.join(to.select(F.col("node").alias("a"), F.col("to").alias("x")), "a")
            .join(to.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
            .filter("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            .distinct()
        )
        edges = common.stored(moved, "links")
    else:
        raise RuntimeError(f"links still left after {ROUNDS} rounds")
    if not pointers:
        return spark.createDataFrame([], "node long, root long")
    # from the last round back: where a round's targets ended up
    found = pointers[-1].withColumnRenamed("to", "root")
    for to in reversed(pointers[:-1]):
        ends = found.select(F.col("node").alias("to"), "root")
        found = common.stored(to.join(ends, "to", "left").select("node", F.coalesce("root", "to").alias("root")), "roots")
    return found
