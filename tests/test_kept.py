"""Kept results, asserted dictionaries, nested data, bins and crawls."""

import bisect
import json
import random
import threading

import pytest
from pyspark.sql import functions as F

from tagloom.operators import bins, crawl, dictionary, nested, results, search
from tagloom.sources import files


# ------------------------------------------------------------------------------------- kept results


def kept_over(spark, tmp_path, built):
    source = str(tmp_path / "source")

    def build(asked):
        built.append(asked)
        rows = spark.read.parquet(source)
        return rows.filter(F.col("title").contains(asked.tags[0])).select("entity_id", "title", "score")

    return source, results.Kept(spark, str(tmp_path / "kept"), build, search.order_of, [source])


def rows(df):
    return [(r["rank"], r["entity_id"], r["full_size"]) for r in df.orderBy("rank").collect()]


def test_results_are_kept_until_a_source_changes(spark, tmp_path):
    built = []
    source, kept = kept_over(spark, tmp_path, built)
    data = spark.createDataFrame([(i, "red ring" if i % 2 else "blue ring", i % 5) for i in range(40)], "entity_id long, title string, score int")
    data.write.parquet(source)
    red = search.Search(("red",), limit=3)
    order = [i for _, i in sorted((-(i % 5), i) for i in range(40) if i % 2)]
    assert rows(kept.window(red)) == [(n + 1, i, 20) for n, i in enumerate(order[:3])]
    assert rows(kept.window(search.Search(("red",), offset=18, limit=5))) == [(n + 1, order[n], 20) for n in (18, 19)]
    assert len(built) == 1  # another window of the same search isn't built again, nor is it in another session
    again = results.Kept(spark, kept.path, kept.build, kept.order, kept.sources)
    assert rows(again.window(red))[0] == (1, order[0], 20) and len(built) == 1
    assert kept.window(search.Search(("blue",), limit=50)).count() == 20 and len(built) == 2
    assert kept.window(search.Search(("none",))).count() == 0 and results.full_size(kept, search.Search(("none",)), []) == 0
    assert results.full_size(kept, red, []) == 20 and results.full_size(None, red, [data, data.limit(2)]) == 42
    spark.createDataFrame([(99, "red", 9)], data.schema).write.mode("append").parquet(source)
    built.clear()
    assert rows(kept.window(red))[0] == (1, 99, 21) and len(built) == 1
    assert kept.window(search.Search(("blue",), limit=50)).count() == 20 and len(built) == 2  # its sources changed as well
    assert rows(kept.window(red))[0] == (1, 99, 21) and len(built) == 2


def test_writers_of_other_searches_lose_nothing(spark, tmp_path):
    built = []
    source, kept = kept_over(spark, tmp_path, built)
    spark.range(200).select(F.col("id").alias("entity_id"), F.concat(F.lit("w"), F.col("id") % 5).alias("title"), F.lit(1).alias("score")).write.parquet(source)
    kept.ensure(search.Search(("w0",)))
    problems = []

    def write(word):
        try:
            kept.ensure(search.Search((word,)))
        except Exception as problem:  # noqa: BLE001
            problems.append(problem)

    threads = [threading.Thread(target=write, args=(f"w{i}",)) for i in range(1, 5)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not problems and len(built) == 5
    assert all(kept.window(search.Search((f"w{i}",), limit=100)).count() == 40 for i in range(5)) and len(built) == 5


def test_tokens_mean_tags(spark):
    tags = spark.createDataFrame([(3, "Red", "red"), (5, "ring", "ring"), (9, "RED", "red")], "id long, name string, normalized_name string")
    special = spark.createDataFrame([("s", -1, "odd"), ("s", -2, "more"), ("t", -1, "other")], "session string, id long, name string")
    asked = [("s", i, t) for i, t in enumerate(search.split_tokens("5, -2, 'red', odd, 'new one', 77, -9, '12', , newer, new one"))] + [("t", 0, "-1"), ("u", 0, "fresh")]
    found, after = search.query_tags(spark.createDataFrame(asked, "session string, place int, token string"), tags, special)
    assert sorted(map(tuple, found.collect())) == [
        ("s", 0, 5, "ring"), ("s", 1, -2, "more"), ("s", 2, 3, "Red"), ("s", 3, -1, "odd"), ("s", 4, -3, "new one"), ("s", 7, -4, "12"), ("s", 8, -5, "newer"), ("s", 9, -3, "new one"), ("t", 0, -1, "other"), ("u", 0, -1, "fresh"),
    ]
    assert sorted(map(tuple, after.collect())) == [("s", -5, "newer"), ("s", -4, "12"), ("s", -3, "new one"), ("s", -2, "more"), ("s", -1, "odd"), ("t", -1, "other"), ("u", -1, "fresh")]


# ------------------------------------------------------------------------------------- dictionaries


TAGS = "name string, normalized_name string, tagtype int, is_global boolean"
OWNERS = "normalized_name string, tagtype int, user_id long"
ASKED = "name string, tagtype int, user_id long"


def state(found):
    return sorted((r.normalized_name, r.tagtype, r.is_global) for r in found.tags.collect()), sorted(map(tuple, found.owners.select("normalized_name", "tagtype", "user_id").collect()))


def test_dictionaries_are_asserted_once(spark):
    tags = spark.createDataFrame([("Pie", "pie", 0, None), ("cake", "cake", 2, True), ("cup", "cup", 0, False), ("cup", "cup", 5, False), ("sole", "sole", 3, False)], TAGS)
    owners = spark.createDataFrame([("pie", 0, 1), ("cup", 0, 2)], OWNERS)
    asked = spark.createDataFrame([("pie", 4, 9), ("Pie", 6, None), ("cake", 2, 9), ("cup", None, 7), ("cup", None, 7), ("tart", None, 7), ("tart", None, 8), ("flan", None, None), ("sole", None, 7), ("!!", 1, 1), ("cup", 5, 1)], ASKED)
    once = dictionary.assert_tags(tags, owners, asked)
    assert sorted((r.action, r.normalized_name, r.tagtype, r.from_type) for r in once.changes.collect()) == sorted([
        ("retyped", "pie", 4, 0), ("added", "pie", 6, None), ("there", "cake", 2, None), ("there", "cup", 0, None), ("there", "cup", 5, None), ("added", "tart", 0, None), ("added", "flan", 0, None), ("there", "sole", 3, None),
    ], key=lambda x: (x[0], x[1], x[2]))
    want = [("cake", 2, True), ("cup", 0, False), ("cup", 5, True), ("flan", 0, True), ("pie", 4, True), ("pie", 6, True), ("sole", 3, True), ("tart", 0, False)]
    assert state(once) == (want, [("cup", 0, 2), ("cup", 0, 7), ("pie", 4, 1), ("tart", 0, 7), ("tart", 0, 8)])
    twice = dictionary.assert_tags(once.tags, once.owners, asked)
    assert state(twice) == state(once) and {r.action for r in twice.changes.collect()} == {"there"}
    assert twice.tags.filter("normalized_name = 'pie' AND tagtype = 4").first().name == "Pie"


def test_a_dictionary_file_becomes_tables(spark, tmp_path):
    (tmp_path / "d.csv").write_text("salt; sea salt,4,http://x\npepper,4,\nsalt,4,\n")
    read = files.tag_dictionary(spark, str(tmp_path / "d.csv"))
    asked = read.select("name", F.col("tagtype").cast("int").alias("tagtype"), F.lit(None).cast("long").alias("user_id"))
    none = spark.createDataFrame([], TAGS)
    found = dictionary.assert_tags(none, spark.createDataFrame([], OWNERS), asked)
    assert state(found)[0] == [("pepper", 4, True), ("salt", 4, True), ("sea-salt", 4, True)]
    assert dictionary.assert_tags(none, spark.createDataFrame([], OWNERS), asked.limit(0)).tags.isEmpty()


# ------------------------------------------------------------------------------------- nested data


def test_values_under_a_key(spark):
    docs = ['{"k": 1, "a": {"k": [1, {"k": "x"}], "b": null}}', '[{"k": null}, {"j": {"k": {"k": true}}}]', "{broken", None, '"k"', "3", "{}", '{"z": 1, "k": "a\\"b"}']
    found = {r.i: r.vals for r in nested.collect_key(spark.createDataFrame(list(enumerate(docs)), "i int, d string"), "i", "d", "k").collect()}

    def walk(node):
        items = sorted(node.items()) if isinstance(node, dict) else [(None, v) for v in node] if isinstance(node, list) else []
        for name, v in items:
            if name == "k":
                yield v
            yield from walk(v)

    for i, d in enumerate(docs):
        if d is None or d == "{broken":
            assert found[i] is None
        else:
            assert [json.loads(v) for v in found[i]] == list(walk(json.loads(d)))


def test_values_under_a_key_meet_their_documents_without_a_join(spark):
    docs = spark.createDataFrame([(7, "a", '{"k": 1, "b": [{"k": "x"}]}'), (7, "b", "{broken"), (None, "c", "{}")], "i int, more string, d string")
    found = nested.collect_key(docs, "i", "d", "k", also=("more",))
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(((r.more, r.i, r.vals) for r in found.collect())) == [("a", 7, ['"x"', "1"]), ("b", 7, None), ("c", None, [])]


def test_typed_values_and_schemas(spark):
    df = spark.createDataFrame([('{"a": 1, "b": ["x"]}',), ('{"a": "q"}',), ("no",), (None,)], "d string").select(nested.parsed(F.col("d")).alias("v"))
    assert [r[0] for r in df.select(nested.value_at(F.col("v"), "$.a", "int")).collect()] == [1, None, None, None]
    assert [r[0] for r in df.select(nested.value_at(F.col("v"), "$.b[0]", "string")).collect()] == ["x", None, None, None]
    assert "b: ARRAY<STRING>" in nested.schema_of(df, "v").replace("`", "")


# ------------------------------------------------------------------------------------- bins


@pytest.mark.parametrize(("buckets", "most"), [(1, 10**6), (7, 10**6), (16, 40), (64, 5)])
def test_bins_equal_a_search_by_halves(spark, buckets, most):
    rng = random.Random(buckets)
    values = [rng.choice([rng.uniform(-5, 105), 50.0, float(rng.randint(0, 100))]) for _ in range(1500)] + [50.0] * 500 + [None, float("inf"), -1e300]
    edges = [float(rng.randint(0, 100)) for _ in range(70)] + [50.0, None]
    found = bins.bin_of_each(spark.createDataFrame(list(enumerate(values)), "i int, v double"), "v", spark.createDataFrame([(e,) for e in edges], "e double"), "e", buckets, most)
    known = sorted({e for e in edges if e is not None})
    want = [(i, v, None if v is None or v < known[0] else known[bisect.bisect_right(known, v) - 1]) for i, v in enumerate(values)]
    assert sorted(map(tuple, found.collect())) == want


def test_bins_of_other_types_and_empty_tables(spark):
    values = spark.createDataFrame([(1, "2024-01-05"), (2, "2023-01-01"), (3, None)], "i int, d string").withColumn("d", F.to_date("d"))
    edges = spark.createDataFrame([("2024-01-01",), ("2024-02-01",)], "e string").select(F.to_date("e").alias("e"))
    assert sorted((r.i, str(r.bin)) for r in bins.bin_of_each(values.withColumn("n", F.unix_date("d")), "n", edges.select(F.unix_date("e").alias("e")), "e").collect()) == [(1, "19723"), (2, "None"), (3, "None")]
    numbers = spark.createDataFrame([(1, 5)], "i int, v int")
    assert bins.bin_of_each(numbers, "v", spark.createDataFrame([], "e int"), "e").collect()[0].bin is None
    assert bins.bin_of_each(numbers.limit(0), "v", spark.createDataFrame([(1,)], "e int"), "e").isEmpty()


def test_bins_of_a_thousand_buckets(spark):
    values = spark.range(3000).select("id", (F.col("id") * 7 % 3000).cast("double").alias("v"))
    found = bins.bin_of_each(values, "v", spark.range(0, 3000, 11).select(F.col("id").cast("double").alias("e")), "e", buckets=1024)
    assert len(found._jdf.queryExecution().analyzed().toString()) < 1_000_000
    assert sorted((r.v, r.bin) for r in found.collect()) == [(float(v), float(v // 11 * 11)) for v in range(3000)]


def test_bins_without_a_nested_loop(spark):
    found = bins.bin_of_each(spark.range(100).withColumn("v", F.col("id")), "v", spark.range(0, 100, 7), "id")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


# ------------------------------------------------------------------------------------- crawls


def plain_crawl(links, starts, budget):
    out = set()
    for site in {s for s, _ in starts}:
        visited, level, step = [], sorted({u for s, u in starts if s == site})[:budget], 0
        while level:
            visited += level
            out |= {(site, u, visited.index(u) + 1, step) for u in level}
            at = {}
            for u in level:
                for place, target in links.get(u, []):
                    if target not in visited:
                        at[target] = min(at.get(target, (10**9, 0)), (visited.index(u) + 1, place))
            level = [u for _, u in sorted((p, u) for u, p in at.items())][: budget - len(visited)]
            step += 1
    return out


@pytest.mark.parametrize("budget", [1, 4, 10])
def test_crawls_equal_a_queue_for_each_site(spark, budget):
    rng = random.Random(budget)
    links = {f"u{i}": [(p, f"u{rng.randrange(120)}") for p in range(rng.randint(0, 5))] for i in range(100)}
    starts = [(f"s{i}", f"u{rng.randrange(120)}") for i in range(25)] + [("s0", "u1"), ("s0", "u1"), ("s1", None)]
    table = [(u, p, t) for u, each in links.items() for p, t in each] + [("u1", 99, None)]
    found = crawl.crawl(spark.createDataFrame(table, "url string, place int, target string"), spark.createDataFrame(starts, "site string, url string"), budget)
    assert {tuple(r) for r in found.collect()} == plain_crawl(links, [x for x in starts if x[1]], budget)
