"""Report bundles: every table of a report from one scan of the facts."""

import datetime as dt
import os
import sys

from cadence.binding import FactSet
from cadence.plans import bundles
from cadence.plans import reports as rpt
from cadence.session import shared_dir
from cadence.sources.tables import lineitem_supplier

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from plan_report import final_plan  # noqa: E402

SF = "/root/testdata/sf0.001"


def _scans(df):
    df.collect()
    plan = final_plan(df._jdf.queryExecution().executedPlan().toString())
    return plan.count("lineitem.parquet")


def test_seasonal_bundle_equals_single_tables(spark):
    fs = lineitem_supplier(spark, SF)
    b = bundles.seasonal_report(spark, fs, [1996, 1997])
    assert set(b) == {"season_matrix", "season_compare", "season_top"}
    for name, single in (("season_matrix", rpt.season_matrix(fs, [1996, 1997])),
                         ("season_top", rpt.season_top(fs, [1996, 1997]))):
        assert sorted(map(tuple, b[name].collect())) == sorted(map(tuple, single.collect()))
    # derived from the checkpoint: no table of the bundle reads the facts again
    assert all(_scans(df) == 0 for df in b.values())


def test_yearly_bundle_written_and_read_back(spark):
    fs = lineitem_supplier(spark, SF)
    b = bundles.yearly_report(spark, fs, [1996, 1997])
    assert {"year_totals", "shares", "top_15", "top_10", "top_10_side_by_side"} <= set(b)
    paths = bundles.write_report(spark, b, shared_dir(spark, "t-yearly"), fmt="parquet")
    back = spark.read.parquet(paths["top_15"])
    assert back.count() == b["top_15"].count()
    assert "run_ts=" in paths["shares"]
    run = paths["shares"].rsplit("/", 1)[0]
    assert bundles.read_manifest(spark, run) == paths


def test_monthly_bundle_is_partitioned_by_year_and_month(spark):
    rows = [(dt.datetime(2023, m, 1, h), "1", "A", float(h)) for m in (1, 2) for h in range(24)]
    fs = FactSet(spark.createDataFrame(rows, "ts timestamp_ntz, id string, entity string, v double"))
    paths = bundles.write_report(spark, bundles.monthly_report(spark, fs), shared_dir(spark, "t-monthly"))
    back = spark.read.parquet(paths["monthly_series"])
    assert back.where("year = 2023 AND month = 2").count() == 24
