"""Coverage filter, hour spine and linear gap fill (checked against pandas)."""

import datetime as dt
import random

import numpy as np
import pandas as pd

from cadence.binding import FactSet
from cadence.operators.series import filled_series, first_seen_name, gap_fill, spine
from cadence.plans import reports as rpt

KEYS = ["entity"]


def per_slot(spark, series):
    rows = [(k, h, v) for k, vals in series.items() for h, v in vals]
    return spark.createDataFrame(rows, "entity string, hour int, v double")


def test_documented_example(spark):
    vals = [None, 1.0, None, 3.0, None, None]
    df = spark.createDataFrame([("e", h, v) for h, v in enumerate(vals)], "entity string, hour int, v double")
    out = gap_fill(df, KEYS).orderBy("hour").collect()
    assert [r.filled for r in out] == [None, 1.0, 2.0, 3.0, 3.0, 3.0]


def test_matches_pandas_interpolate(spark):
    rnd = random.Random(7)
    series = {}
    for k in range(40):
        hours = sorted(rnd.sample(range(24), rnd.randint(12, 24)))
        series[f"s{k}"] = [(h, round(rnd.uniform(0, 100), 2)) for h in hours]
    out = filled_series(per_slot(spark, series), KEYS).toPandas()
    assert len(out) == 40 * 24
    for k, vals in series.items():
        s = pd.Series(np.nan, index=range(24))
        for h, v in vals:
            s[h] = v
        want = s.interpolate(method="linear")
        got = out[out.entity == k].sort_values("hour")
        np.testing.assert_allclose(got.filled.to_numpy(dtype=float), want.to_numpy(), rtol=1e-12, equal_nan=True)
        assert abs(got["mean"].iloc[0] - want.mean()) <= 1e-6


def test_coverage_twelve_kept_eleven_dropped(spark):
    series = {"keep": [(h, 1.0) for h in range(12)], "drop": [(h, 1.0) for h in range(11)]}
    out = spine(per_slot(spark, series), KEYS, min_slots=12).toPandas()
    assert set(out.entity) == {"keep"}
    assert sorted(out.hour) == list(range(24))
    out_all = spine(per_slot(spark, series), KEYS, min_slots=None).toPandas()
    assert set(out_all.entity) == {"keep", "drop"}


def test_full_series_unchanged(spark):
    # any complete day needs no fill
    vals = [(h * 7) % 24 + 0.5 for h in range(24)]
    series = {"full": [(h, float(v)) for h, v in enumerate(vals)]}
    out = filled_series(per_slot(spark, series), KEYS).orderBy("hour").collect()
    assert [r.filled for r in out] == [float(v) for v in vals]
    assert out[0].label == "12 AM" and out[12].label == "12 PM" and out[23].label == "11 PM"


def test_first_seen_name(spark):
    df = spark.createDataFrame(
        [(dt.datetime(2023, 1, 2), "1", "Late"), (dt.datetime(2023, 1, 1), "1", "Early"),
         (dt.datetime(2023, 1, 1), "2", "B"), (dt.datetime(2023, 1, 1), "2", "A")],
        "ts timestamp_ntz, id string, entity string")
    out = {r.id: r.name for r in df.groupBy("id").agg(first_seen_name().alias("name")).collect()}
    assert out == {"1": "Early", "2": "A"}


def test_monthly_series_end_to_end(spark):
    rows = [(dt.datetime(2023, 12, 1, h), "7", "A", float(h)) for h in range(0, 24, 2)]
    fs = FactSet(spark.createDataFrame(rows, "ts timestamp_ntz, id string, entity string, v double"))
    out = rpt.monthly_series(fs).orderBy("hour").collect()
    assert len(out) == 24 and out[0].n_slots == 12
    assert [r.filled for r in out[:4]] == [0.0, 1.0, 2.0, 3.0]
    assert out[23].filled == 22.0  # trailing gap takes the last value


def test_first_seen_name_keys_series_by_id(spark):
    # id 7 is written under two names; the series takes the earliest one
    rows = [(dt.datetime(2023, 5, 1, h), "7", "Old Name" if h < 3 else "New Name", float(h)) for h in range(24)]
    rows.append((dt.datetime(2023, 5, 2, 0), "7", "New Name", 2.0))
    fs = FactSet(spark.createDataFrame(rows, "ts timestamp_ntz, id string, entity string, v double"))
    out = rpt.monthly_series(fs, name_rule="first_seen").orderBy("hour").collect()
    assert len(out) == 24 and {r.entity for r in out} == {"Old Name"}
    assert out[0].v == 1.0  # hour 0 averages both days: (0 + 2) / 2
    grouped = rpt.monthly_series(fs, min_slots=None)
    assert {r.entity for r in grouped.collect()} == {"Old Name", "New Name"}
