"""Plan shape: year filters reach the scan, names are joined after the
aggregate, top-n is limited before the shuffle, no query uses a Python UDF,
a cartesian product or a nested-loop join."""

import os
import re
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from plan_report import final_plan, window_partition_keys  # noqa: E402

from cadence.plans.catalog import queries  # noqa: E402

SF = "/root/testdata/sf0.001"


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_year_range_is_pushed_to_parquet(spark):
    plan = physical(queries()["entity_totals"](spark, SF))
    pushed = [l for l in plan.splitlines() if "PushedFilters" in l and "l_shipdate" in l]
    assert pushed and "GreaterThanOrEqual(l_shipdate,1996-01-01" in pushed[0]
    assert "LessThan(l_shipdate,1998" in pushed[0]


def test_scan_reads_only_bound_columns(spark):
    plan = physical(queries()["entity_totals"](spark, SF))
    schema = re.search(r"ReadSchema: (struct<[^>]*l_shipdate[^>]*>)", plan).group(1)
    assert schema == "struct<l_suppkey:bigint,l_quantity:double,l_shipdate:timestamp_ntz>"


def test_names_join_sits_above_the_aggregate(spark):
    plan = optimized(queries()["entity_share"](spark, SF)).splitlines()
    join = next(i for i, l in enumerate(plan) if "Join" in l and "<=>" in l)
    scan = next(i for i, l in enumerate(plan) if "Relation" in l and "l_shipdate" in l)
    assert join < scan
    assert any("Aggregate" in l for l in plan[join:scan])


def test_top_n_is_limited_before_the_shuffle(spark):
    plan = physical(queries()["top15_by_year"](spark, SF))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_calendar_tables_are_broadcast(spark):
    plan = physical(queries()["hour_profile"](spark, SF))
    assert "BroadcastHashJoin" in plan


def test_series_need_no_join(spark):
    plan = physical(queries()["monthly_series"](spark, SF))
    assert "Join" not in plan and "Generate explode" in plan


STREAMS = {"running_hour_state", "append_pages", "report_bundle", "profile_readback"}


@pytest.mark.parametrize("name", sorted(set(queries()) - STREAMS))
def test_no_python_cartesian_or_nested_loop(spark, name):
    plan = physical(queries()[name](spark, SF))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in plan, f"{name}: {bad}"


def test_share_scans_the_facts_once(spark):
    df = queries()["entity_share"](spark, SF)
    df.collect()
    final = final_plan(physical(df))
    assert final.count("lineitem.parquet") == 1
    assert "ReusedExchange" in final


def test_global_window_is_detected(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    df = spark.range(5).withColumn("m", F.max("id").over(Window.partitionBy()))
    df.collect()
    assert window_partition_keys(df) == [0]


@pytest.mark.parametrize("name", sorted(queries()))
def test_no_window_without_partition_keys(spark, name):
    df = queries()[name](spark, SF)
    df.collect()
    assert all(k > 0 for k in window_partition_keys(df)), name


YEAR_FILTERED = {
    "totals_by_year": "l_shipdate", "entity_totals": "l_shipdate", "entity_share": "l_shipdate",
    "entity_share_pct": "o_orderdate", "top15_by_year": "l_shipdate", "top10_rank_aligned": "l_shipdate",
    "top10_entity_aligned": "l_shipdate", "season_matrix": "l_shipdate", "season_compare": "l_shipdate",
    "season_top5": "l_shipdate", "weekday_avg": "o_orderdate", "page_extract": "o_orderdate",
    "entity_range_extract": "o_orderdate",
}


@pytest.mark.parametrize("name", sorted(YEAR_FILTERED))
def test_time_range_reaches_every_fact_scan(spark, name):
    col = YEAR_FILTERED[name]
    plan = physical(queries()[name](spark, SF))
    scans = [l for l in plan.splitlines() if "FileScan parquet" in l and col in l.split("ReadSchema")[-1]]
    assert scans
    for line in scans:
        pushed = line.split("PushedFilters: ")[1].split(", ReadSchema")[0]
        assert f"GreaterThanOrEqual({col}" in pushed or f"GreaterThan({col}" in pushed, pushed
