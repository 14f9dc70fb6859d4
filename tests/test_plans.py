"""What the physical plans must show: pruned columns, pushed filters, no product of rows."""

import pytest

from tagloom import plans


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_columns_are_pruned_and_filters_pushed(spark, sf_dir):
    plan = plan_of(plans.QUERIES["collected_by_user"](spark, sf_dir))
    assert "EqualTo(o_custkey,7)" in plan
    assert "o_totalprice" not in plan and "l_comment" not in plan and "l_extendedprice" not in plan


def test_windows_become_top_k(spark, sf_dir):
    assert "TakeOrderedAndProject" in plan_of(plans.QUERIES["feed_menu"](spark, sf_dir))


@pytest.mark.parametrize("name", ["search_parts", "string_scopes", "url_sites", "list_contents", "phrase_matches", "related_entities"])
def test_no_products(spark, sf_dir, name):
    plan = plan_of(plans.QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", ["search_parts", "popularity", "url_parts", "cohort_metrics", "concept_children"])
def test_no_python_where_functions_do(spark, sf_dir, name):
    plan = plan_of(plans.QUERIES[name](spark, sf_dir))
    assert not any(x in plan for x in ("Python", "Pandas", "MapInArrow"))
