"""What the plans of headline queries must have: filters and columns at the scan, broadcasts for small sides, no Python."""

import pytest

from tesserql.queries import QUERIES


def plan(spark, sf_dir, name):
    return QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    p = plan(spark, sf_dir, "scan_filter_project")
    assert "PushedFilters: [IsNotNull(l_shipdate), IsNotNull(l_quantity), LessThan(l_shipdate" in p
    assert "l_tax" not in p and "l_returnflag" not in p
    assert "EqualTo(o_orderkey,4711)" in plan(spark, sf_dir, "point_select")


def test_global_tables_are_broadcast(spark, sf_dir):
    assert "BroadcastHashJoin" in plan(spark, sf_dir, "join_global_broadcast")


def test_top_k_needs_no_full_sort(spark, sf_dir):
    assert "TakeOrderedAndProject" in plan(spark, sf_dir, "top_k")


@pytest.mark.parametrize("name", ["pricing_summary", "join_chain_5", "shard_hash", "shard_string_hash", "fn_str_soundex", "fn_time_date_format", "agg_group_concat", "sub_all_ge"])
def test_no_python_in_the_plan(spark, sf_dir, name):
    p = plan(spark, sf_dir, name)
    assert "Python" not in p and "Arrow" not in p and "Pandas" not in p
