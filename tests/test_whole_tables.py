"""Registered queries work on whole tables: known answers beyond what a filter on ids would leave."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tagloom import plans
from tagloom.operators import lists
from tagloom.sources import roles


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("whole"))
    day = dt.date(2024, 1, 1)
    tables = {
        "part": ([(7, "red", "B", "small"), (150, "red ring", "B", "small")], "p_partkey long, p_name string, p_brand string, p_type string"),
        "orders": ([(1, 7, "F", "x", day), (2, 8, "F", "x", day)], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string, o_orderdate date"),
        "lineitem": ([(1, 150, "N", day), (2, 150, "N", day), (2, 7, "N", day)], "l_orderkey long, l_partkey long, l_returnflag string, l_shipdate date"),
        "region": ([(0, "R")], "r_regionkey long, r_name string"),
        "nation": ([(0, "A", 0), (1, "B", 0), (2, "C", 0)], "n_nationkey long, n_name string, n_regionkey long"),
        "supplier": ([(1, "s1", 0), (2, "s2", 1)], "s_suppkey long, s_name string, s_nationkey long"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return path


def test_tag_sets_of_all_parts(spark, folder):
    found = plans.QUERIES["tag_sets"](spark, folder).select("entity_id", "visible", "editable", "locked").collect()
    assert sorted(map(tuple, found)) == [(7, 3, 0, 3), (150, 4, 4, 0)]


def test_parents_of_all_suppliers(spark, folder):
    assert sorted(r["node"] for r in plans.QUERIES["concept_parents"](spark, folder).collect()) == ["nation:A", "nation:B"]


def test_entries_hold_whole_texts(spark, tmp_path):
    text = "x" * 60 + " ti"
    spark.createDataFrame([(1, 0, text)], "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert [r["title"] for r in roles.feed_entries(spark, str(tmp_path)).collect()] == [text]
    assert [r["title"] for r in plans.QUERIES["feed_menu"](spark, str(tmp_path)).collect()] == [text]


def test_tagged_parts_have_no_row_for_each_user(spark, folder):
    found = {(r.entity_id, r.tag): (r.names, r.taggers, r.mine) for r in roles.tagged(spark, folder, mine=F.bool_or(F.col("user_id") == 7)).collect()}
    assert found == {(150, t): (1, 2, True) for t in ("1:b", "2:small", "3:red", "3:ring")} | {(7, t): (1, 1, False) for t in ("1:b", "2:small", "3:red")}
    assert {r.tag: (r.entities, r.taggings) for r in plans.QUERIES["popularity"](spark, folder).collect()}["3:red"] == (2, 3)


def test_sizes_of_lists_are_counts_of_their_contents(spark):
    rng = random.Random(5)
    taggings = spark.createDataFrame([(rng.randint(0, 6), rng.choice("abcdef"), rng.choice(["Part", "Site"]), rng.randint(0, 30)) for _ in range(400)], "user_id int, tag string, entity_type string, entity_id int")
    some = spark.createDataFrame([(i, rng.randint(0, 8), rng.choice("abxyz"), i % 3 > 0) for i in range(40)], "list_id int, owner_id int, name_tag string, pullin boolean")
    pulled = spark.createDataFrame([(i, t) for i in range(40) for t in rng.sample("cdefz", i % 4)], "list_id int, tag string")
    want = lists.list_contents(taggings, some, pulled, 3).groupBy("list_id").agg(F.count("*").alias("entities"))
    sizes = lists.list_sizes(taggings, some, pulled, 3)
    assert sorted(map(tuple, sizes.collect())) == sorted(map(tuple, want.collect()))
