"""Calendar labels, seasons, weekdays, the sanitiser and number text."""

import datetime as dt

from pyspark.sql import functions as F

from cadence.functions.calendar import (
    hour_label,
    hours_table,
    in_month,
    in_years,
    season_of,
    seasons_table,
    weekdays_table,
    with_calendar,
)
from cadence.functions.text import clock_hour12, fixed2, percent_text, sanitize_name, stamp_year, thousands


def test_hours_table(spark):
    rows = hours_table(spark).orderBy("hour").collect()
    assert [r.label for r in rows][:3] == ["12 AM", "1 AM", "2 AM"]
    assert rows[12].label == "12 PM" and rows[23].label == "11 PM"
    assert [r.hour for r in sorted(rows, key=lambda r: r.slot)] == list(range(1, 24)) + [0]


def test_weekdays_and_seasons(spark):
    assert [r.day for r in weekdays_table(spark).orderBy("slot").collect()][0] == "Monday"
    assert [r.season for r in seasons_table(spark).orderBy("slot").collect()] == ["Winter", "Spring", "Summer", "Fall"]
    months = spark.range(1, 13).select(F.col("id").cast("int").alias("m"))
    got = {r.m: r.s for r in months.select("m", season_of("m").alias("s")).collect()}
    assert got[12] == got[1] == got[2] == "Winter" and got[9] == "Fall"


def test_calendar_columns(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 12, 1, 13, 5),)], "ts timestamp_ntz")
    r = with_calendar(df).collect()[0]
    assert (r.year, r.month, r.hour, r.dow, r.day, r.season, r.label) == (2024, 12, 13, 6, "Sunday", "Winter", "1 PM")


def test_year_and_month_ranges(spark):
    df = spark.createDataFrame(
        [(dt.datetime(2022, 12, 31, 23),), (dt.datetime(2023, 1, 1),), (dt.datetime(2024, 12, 31, 23),),
         (dt.datetime(2025, 1, 1),)], "ts timestamp_ntz")
    assert df.where(in_years("ts", [2023, 2024])).count() == 2
    assert df.where(in_years("ts", [2022, 2025])).count() == 2
    assert df.where(in_month("ts", 2022, 12)).count() == 1


def test_sanitize(spark):
    df = spark.createDataFrame(
        [("149 St-Grand [2/4,5].",), ("  a\\b*c:d?e'f  ",), (None,), ("x" * 40,), ("\tTab St\n",)], "n string")
    got = [r.c for r in df.select(sanitize_name("n").alias("c")).collect()]
    assert got == ["149 St-Grand (2-4-5)-", "a-b-c-d-e-f", "Unknown_Station", "x" * 31, "Tab St"]


def test_number_text(spark):
    df = spark.createDataFrame([(1234567.5, 0.123456)], "x double, r double")
    r = df.select(thousands("x").alias("t"), fixed2("x").alias("f"), percent_text("r").alias("p")).collect()[0]
    assert (r.t, r.f, r.p) == ("1,234,568", "1234567.50", "12.35%")
    all_digits = df.select(thousands("x", 1).alias("t"), percent_text("r", 1).alias("p")).collect()[0]
    assert (all_digits.t, all_digits.p) == ("1,234,567.5", "12.3%")


def test_stamp_text_extraction(spark):
    df = spark.createDataFrame([("10/18/2022 07:00:00 PM",), ("10/18/2022 07:00:00 AM",), ("junk",)], "t string")
    got = [(r.y, r.h) for r in df.select(stamp_year("t").alias("y"), clock_hour12("t").alias("h")).collect()]
    assert got == [(2022, 7), (2022, 7), (None, None)]


def test_hour_label_expression(spark):
    df = spark.range(24).select(F.col("id").cast("int").alias("h"))
    labels = [r.l for r in df.select(hour_label("h").alias("l")).orderBy("h").collect()]
    assert labels[0] == "12 AM" and labels[11] == "11 AM" and labels[13] == "1 PM"


def test_cluster_profile_settings():
    from cadence.session import CLUSTER_PROFILE

    assert CLUSTER_PROFILE["spark.sql.files.maxPartitionBytes"] == "256m"
    assert "RocksDBStateStoreProvider" in CLUSTER_PROFILE["spark.sql.streaming.stateStore.providerClass"]
