"""Shapes of the physical plans."""

import re

import pytest

import __spark_entry__ as contract

SF_DIR = "/root/testdata/sf0.001"
QUERIES = contract.queries()
# These write or run streams while they are built.
EAGER = re.compile(r"^(r2|r6|w5|w6|w9|w12|s\d)_")
NATIVE = re.compile(r"^(f[2356789]_|f1[1-9]_|v1_|v2_|b\d_|a\d+_|t\d_|k\d_|h1_|p[13]_)")


def plan(spark, name):
    return QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in QUERIES if not EAGER.match(n)])
def test_no_cross_join_and_no_row_udf(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text
    assert " percentile(" not in text
    if NATIVE.match(name):
        assert "Python" not in text and "MapInArrow" not in text


def test_single_shuffle_of_the_source_comparison(spark):
    assert plan(spark, "a7_source_comparison").count("Exchange ") == 1


def test_scan_reads_only_what_is_needed(spark):
    text = plan(spark, "a10_average_price_by_source")
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert {c.split(":")[0] for c in schema.split(",")} == {"l_extendedprice", "l_returnflag"}


def test_filters_reach_the_scan(spark):
    assert "PushedFilters: [IsNotNull(l_shipdate), GreaterThanOrEqual(l_shipdate" in plan(spark, "a14_daily_collection")
    assert re.search(r"PushedFilters: \[[^]]*GreaterThanOrEqual\(ts", plan(spark, "d2_price_by_day"))


def test_group_limit_before_the_shuffle(spark):
    assert plan(spark, "p10_first_n_per_source").count("WindowGroupLimit") == 2
