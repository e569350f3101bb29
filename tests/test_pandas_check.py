"""pandas cross-checks (expectations written anew with pandas): weekday
averages of daily totals reindexed Monday..Sunday, and the network hour
profile reindexed to hours 1..23, 0."""

import numpy as np
import pandas as pd

from cadence.plans import reports as rpt
from cadence.sources.tables import events_hourly, orders_customer

SF = "/root/testdata/sf0.001"
DAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def test_weekday_average_matches_pandas(spark):
    orders = pd.read_parquet(f"{SF}/orders.parquet", columns=["o_orderdate", "o_totalprice"])
    for year in (1996, 1997):
        o = orders[orders.o_orderdate.dt.year == year].copy()
        o["date"] = o.o_orderdate.dt.date
        o["day"] = o.o_orderdate.dt.day_name()
        daily = o.groupby(["date", "day"])["o_totalprice"].sum().reset_index()
        want = daily.groupby("day")["o_totalprice"].mean().reindex(DAYS)
        got = (
            rpt.weekday_average(spark, orders_customer(spark, SF), [1996, 1997])
            .where(f"year = {year}").orderBy("slot").toPandas()
        )
        assert list(got.day) == DAYS
        np.testing.assert_allclose(got.avg_total.to_numpy(float), want.to_numpy(float), rtol=1e-9, equal_nan=True)


def test_hour_profile_matches_pandas(spark):
    ev = pd.read_parquet(f"{SF}/events.parquet", columns=["ts", "value"])
    ev["hour"] = ev.ts.dt.hour
    sums = ev.groupby("hour")["value"].sum()
    rows = ev.groupby("hour").size()
    want = (sums / rows).reindex(list(range(1, 24)) + [0])
    got = rpt.hour_profile(spark, events_hourly(spark, SF)).orderBy("slot").toPandas()
    assert list(got.hour) == list(range(1, 24)) + [0]
    np.testing.assert_allclose(got.avg_per_row.to_numpy(float), want.to_numpy(float), rtol=1e-9, equal_nan=True)
