"""Walks of the concept graph without a limit of depth, against plain walks in Python."""

import random
from collections import deque

import pytest

from tagloom.operators import graph


def table(spark, links):
    return spark.createDataFrame(links, "parent string, child string")


def on_cycles(links):
    """Nodes in strongly connected components of several nodes, or linked to themselves (Tarjan, without recursion)."""
    below = {}
    for a, b in links:
        below.setdefault(a, set()).add(b)
    index, low, stack, on, found = {}, {}, [], set(), {a for a, b in links if a == b}
    for root in list(below):
        if root in index:
            continue
        work = [(root, iter(below.get(root, ())))]
        index[root] = low[root] = len(index)
        stack.append(root)
        on.add(root)
        while work:
            v, children = work[-1]
            for w in children:
                if w not in index:
                    index[w] = low[w] = len(index)
                    stack.append(w)
                    on.add(w)
                    work.append((w, iter(below.get(w, ()))))
                    break
                if w in on:
                    low[v] = min(low[v], index[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    part = []
                    while True:
                        w = stack.pop()
                        on.discard(w)
                        part.append(w)
                        if w == v:
                            break
                    if len(part) > 1:
                        found |= set(part)
    return found


def ways(links, start):
    below = {}
    for a, b in links:
        below.setdefault(a, set()).add(b)
    found, queue = {s: 0 for s in start}, deque(start)
    while queue:
        v = queue.popleft()
        for w in below.get(v, ()):
            if w not in found:
                found[w] = found[v] + 1
                queue.append(w)
    return found


def test_cycles_of_a_large_random_graph(spark):
    rng = random.Random(3)
    links = [(f"n{rng.randrange(80_000)}", f"n{rng.randrange(80_000)}") for _ in range(100_000)]
    assert {r.node for r in graph.cycles(table(spark, links)).collect()} == on_cycles(links)


@pytest.mark.parametrize("seed", range(3))
def test_cycles_of_small_graphs(spark, seed):
    rng = random.Random(seed)
    links = [(f"g{g}n{rng.randrange(12)}", f"g{g}n{rng.randrange(12)}") for g in range(40) for _ in range(rng.randint(0, 16))]
    links += [(None, "x"), ("x", None), *links[:5]]
    assert {r.node for r in graph.cycles(table(spark, links)).collect()} == on_cycles([x for x in links if None not in x])


def test_shortest_ways_equal_breadth_first_search(spark):
    rng = random.Random(5)
    links = [(f"n{rng.randrange(400)}", f"n{rng.randrange(400)}") for _ in range(700)]
    start = ["n1", "n2"]
    found = {r.node: r.path for r in graph.shortest(table(spark, links), spark.createDataFrame([(s,) for s in start], "node string")).collect()}
    want = ways(links, start)
    assert {n: len(p) - 1 for n, p in found.items()} == want
    known = set(links)
    assert all(p[0] in start and p[-1] == n and all(x in known for x in zip(p, p[1:])) for n, p in found.items())
    for n, p in found.items():  # of equal ways the least
        assert len(p) == 1 or p[:-1] == min(found[a] for a, b in known if b == n and want.get(a) == len(p) - 2)


def test_walks_have_no_depth_limit(spark):
    links = [(f"n{i + 1:02}", f"n{i:02}") for i in range(45)]
    chain = table(spark, [*links, ("n10", "n10")])
    assert graph.path_between(chain, "n00", "n45").first().path == [f"n{i:02}" for i in range(46)]
    assert graph.path_between(chain, "n45", "n00").isEmpty()
    assert [r.node for r in graph.cycles(chain).collect()] == ["n10"]
    with pytest.raises(ValueError, match="ancestor"):
        graph.add_relation(chain, "n00", "n45")
    closed = table(spark, [*links, ("n00", "n45")])
    assert graph.cycles(closed).count() == 46


def test_empty_graphs_and_unending_weights(spark):
    none = table(spark, [])
    assert graph.cycles(none).isEmpty() and graph.path_between(none, "a", "b").isEmpty()
    assert graph.shortest(none, spark.createDataFrame([("a",)], "node string")).collect()[0].path == ["a"]
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0)], "parent string, child string, weight double")
    with pytest.raises(ValueError, match="cycle"):
        graph.best_first(edges, spark.createDataFrame([("a",)], "node string"), 0.5)
