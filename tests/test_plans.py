"""What the optimizer makes of the queries."""

import pytest

import __spark_entry__ as entry


def plan(spark, sf_dir, name):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    df = entry.queries()[name](spark, sf_dir)
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    text = plan(spark, sf_dir, "forecast_revenue")
    assert "PushedFilters: [" in text and "GreaterThanOrEqual(l_shipdate" in text and "LessThan(l_quantity,24.0)" in text
    assert "ReadSchema: struct<l_quantity:double,l_extendedprice:double,l_discount:double,l_shipdate:timestamp_ntz>" in text


def test_ranks_are_limited_before_the_shuffle(spark, sf_dir):
    assert "WindowGroupLimit" in plan(spark, sf_dir, "top_k_per_group")
    assert "WindowGroupLimit" in plan(spark, sf_dir, "cosine_top_k")


def test_limits_take_the_top_without_a_full_sort(spark, sf_dir):
    for name in ("shipping_priority", "returned_items", "large_orders", "top_k"):
        assert "TakeOrderedAndProject" in plan(spark, sf_dir, name)


def test_one_folder_of_a_partitioned_table_is_read(spark, sf_dir):
    assert "PartitionFilters: [isnotnull(o_orderpriority" in plan(spark, sf_dir, "partition_pruning")


def test_as_of_join_is_one_shuffle_and_a_window(spark, sf_dir):
    text = plan(spark, sf_dir, "as_of_join")
    assert "Join" not in text and text.count("Exchange hashpartitioning") <= 2


QUIET = [n for n in entry.oracle_sql() if not n.startswith(("op", "stream")) and n not in ("cross_join", "cartesian_join", "sketches_within_bounds", "cosine_top_k", "null_aware_anti_join", "lateral_join", "top_supplier")]


@pytest.mark.parametrize("name", QUIET)
def test_no_nested_loops(spark, sf_dir, name):
    """But for the join that is one, a stated query set in blocks, NOT IN, and single rows."""
    text = plan(spark, sf_dir, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_no_window_holds_an_event_type(spark, sf_dir):
    text = plan(spark, sf_dir, "range_frame")
    assert "RangeFrame" not in text and "rangepartitioning(_g" in text


def test_not_in_broadcasts_one_row_but_no_members(spark, sf_dir):
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(spark, sf_dir, "null_aware_anti_join")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    assert "SortMergeJoin" in text and "LeftAnti" in text and "HashedRelationBroadcastMode" not in text


@pytest.mark.parametrize(("name", "operator"), [("sort_merge_join", "SortMergeJoin"), ("shuffled_hash_join", "ShuffledHashJoin"), ("cartesian_join", "CartesianProduct"), ("sort_aggregate", "SortAggregate"), ("mode_and_listagg", "ObjectHashAggregate")])
def test_hints_and_buffers_choose_the_operator(spark, sf_dir, name, operator):
    assert operator in plan(spark, sf_dir, name)
