"""Physical plans: no nested-loop or cartesian joins, filters and columns reach the scan, same result twice."""

import pytest

import __spark_entry__ as entry

QUERIES = entry.queries()
BATCH = sorted(n for n in QUERIES if not n.startswith(("str1_", "str2_", "str3_", "str4_", "str5_", "str6_", "str7_", "joi8_", "win2_")))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", BATCH)
def test_no_nested_loops(spark, sf, name):
    p = plan(QUERIES[name](spark, sf))
    assert "CartesianProduct" not in p
    assert "BroadcastNestedLoopJoin" not in p


def test_filters_and_columns_reach_the_scan(spark, sf):
    p = QUERIES["agg22_learning_summary"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,event_type:string>" in p
    p = QUERIES["joi22_replies_applied"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(event_type)" in p or "PushedFilters: [EqualTo(event_type" in p or "In(event_type" in p


def test_board_skips_the_customer_join(spark, sf):
    assert "customer.parquet" not in plan(QUERIES["agg2_kpi_board"](spark, sf))


@pytest.mark.parametrize("name", ["joi6_duplicate_levels", "win2_fused_notices", "agg33_suggestions", "joi9_apply_learning", "win8_band_segments"])
def test_same_result_twice(spark, sf, name):
    one = sorted(map(tuple, QUERIES[name](spark, sf).collect()), key=str)
    two = sorted(map(tuple, QUERIES[name](spark, sf).collect()), key=str)
    assert one == two
