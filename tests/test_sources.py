"""CSV export and JSON pages: strict and lenient parsing, header checks."""

import datetime as dt
import json

import pytest
from pyspark.errors import PySparkException
from py4j.protocol import Py4JJavaError

from cadence.binding import missing_columns
from cadence.sources.files import (
    clean_hourly,
    pages_in_range,
    read_hourly_csv,
    read_json_pages,
    read_raw_csv,
    sample,
)

GOOD = """transit_timestamp,station_complex_id,station_complex,ridership,extra
10/18/2022 07:00:00 PM,444,"Gun Hill Rd (2,5)",57,x
3/12/2023 2:00:00 AM,444,"Gun Hill Rd (2,5)",57.0,x
01/01/2023 12:00:00 AM,7,Main St,3,x
01/01/2023 12:00:00 PM,7,Main St,4,x
"""

DIRTY = GOOD + """not a stamp,7,Main St,5,x
01/02/2023 01:00:00 AM,7,Main St,,x
01/02/2023 02:00:00 AM,7,Main St,text,x
01/02/2023 03:00:00 AM,7,Main St,NaN,x
01/02/2023 04:00:00 AM,,,9,x
"""


def write(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def test_lenient_drops_bad_rows(spark, tmp_path):
    fs = read_hourly_csv(spark, write(tmp_path, "d.csv", DIRTY), mode="lenient")
    rows = fs.facts.orderBy("ts").collect()
    assert len(rows) == 5  # 4 good + the row with a null station
    assert rows[0].ts == dt.datetime(2022, 10, 18, 19, 0)
    assert rows[0].entity == "Gun Hill Rd (2,5)"
    # the daylight-saving gap hour keeps its wall-clock value
    assert dt.datetime(2023, 3, 12, 2, 0) in [r.ts for r in rows]
    hours = sorted(r.ts.hour for r in rows if r.ts.date() == dt.date(2023, 1, 1))
    assert hours == [0, 12]


def test_keep_mode_keeps_null_rows(spark, tmp_path):
    fs = read_hourly_csv(spark, write(tmp_path, "d.csv", DIRTY), mode="keep")
    rows = fs.facts.collect()
    assert len(rows) == 9
    assert sum(r.ts is None for r in rows) == 1
    assert sum(r.v is None for r in rows) == 3  # empty, text and NaN


def test_strict_fails_on_bad_stamp(spark, tmp_path):
    fs = read_hourly_csv(spark, write(tmp_path, "d.csv", DIRTY), mode="strict")
    with pytest.raises((PySparkException, Py4JJavaError)):
        fs.facts.collect()


def test_strict_accepts_clean_file(spark, tmp_path):
    fs = read_hourly_csv(spark, write(tmp_path, "g.csv", GOOD), mode="strict")
    assert fs.facts.count() == 4


def test_blank_column_names_are_stripped(spark, tmp_path):
    text = GOOD.replace("transit_timestamp,station_complex_id", " transit_timestamp , station_complex_id ")
    raw = read_raw_csv(spark, write(tmp_path, "b.csv", text))
    assert raw.columns[:2] == ["transit_timestamp", "station_complex_id"]
    assert clean_hourly(raw).count() == 4


def test_missing_required_column(spark, tmp_path):
    text = "transit_timestamp,station_complex\n01/01/2023 12:00:00 AM,A\n"
    raw = read_raw_csv(spark, write(tmp_path, "m.csv", text))
    assert missing_columns(raw, ["ridership"]) == ["ridership"]
    with pytest.raises(ValueError, match="ridership"):
        clean_hourly(raw)
    empty = clean_hourly(raw, on_missing="empty")
    assert empty.columns == ["ts", "id", "entity", "v"] and empty.isEmpty()


def test_projection_reaches_the_scan(spark, tmp_path):
    fs = read_hourly_csv(spark, write(tmp_path, "g.csv", GOOD))
    plan = fs.facts._jdf.queryExecution().executedPlan().toString()
    assert "extra" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_sample_reads_five(spark, tmp_path):
    assert sample(read_raw_csv(spark, write(tmp_path, "g.csv", GOOD)), 2).count() == 2


def test_json_pages_full_short_empty(spark, tmp_path):
    def rec(ts, v):
        return {"transit_timestamp": ts, "station_complex_id": "7", "station_complex": "Main St", "ridership": v}

    full = [rec("2024-12-01T00:00:00", "1"), rec("2024-12-01T01:00:00", "2"), rec("2024-12-31T23:00:00", "3")]
    short = [rec("2024-12-31T23:59:59", "4"), rec("2025-01-01T00:00:00", "5")]
    d = tmp_path / "pages"
    d.mkdir()
    (d / "p1.json").write_text(json.dumps(full))
    (d / "p2.json").write_text(json.dumps(short))
    (d / "p3.json").write_text("[]")
    pages = read_json_pages(spark, str(d))
    assert pages.count() == 5
    inside = pages_in_range(pages, "2024-12-01 00:00:00", "2024-12-31 23:59:59").orderBy("ts").collect()
    assert [r.v for r in inside] == [1.0, 2.0, 3.0, 4.0]  # both bounds are inside


def test_strict_guess_parses_iso_and_raises_on_junk(spark):
    from cadence.functions.clean import to_stamp_strict_guess

    ok = spark.createDataFrame([("2024-12-01T00:00:00",)], "t string")
    assert ok.select(to_stamp_strict_guess("t").alias("ts")).collect()[0].ts == dt.datetime(2024, 12, 1)
    bad = spark.createDataFrame([("junk",)], "t string")
    with pytest.raises((PySparkException, Py4JJavaError)):
        bad.select(to_stamp_strict_guess("t")).collect()


def test_empty_result_guard(spark, tmp_path):
    fs = read_hourly_csv(spark, write(tmp_path, "g.csv", GOOD))
    assert fs.facts.where("year(ts) = 1999").isEmpty()
    assert not fs.facts.isEmpty()


def test_strict_fails_without_ansi_too(spark, tmp_path):
    prev = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        fs = read_hourly_csv(spark, write(tmp_path, "d.csv", DIRTY), mode="strict")
        with pytest.raises((PySparkException, Py4JJavaError)):
            fs.facts.collect()
        bad_number = GOOD + "01/02/2023 02:00:00 AM,7,Main St,text,x\n"
        fs = read_hourly_csv(spark, write(tmp_path, "n.csv", bad_number), mode="strict")
        with pytest.raises((PySparkException, Py4JJavaError)):
            fs.facts.collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", prev)


def test_keyset_paging_equals_offset_paging(spark):
    from cadence.operators.entity import page, page_after
    from cadence.sources.tables import orders_customer

    facts = orders_customer(spark, "/root/testdata/sf0.001").facts.select("key", "ts", "v")
    order = ["ts", "key"]
    after = None
    for n in range(3):
        keyset = page_after(facts, order, after, 50).collect()
        offset = page(facts, order, 50 * n, 50).collect()
        assert keyset == offset and len(keyset) == 50
        after = (keyset[-1].ts, keyset[-1].key)


def test_dst_gap_hour_kept_even_from_a_new_york_session(spark, tmp_path):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    text = "transit_timestamp,station_complex_id,station_complex,ridership\n3/12/2023 2:00:00 AM,1,A,5\n"
    facts = read_hourly_csv(spark, write(tmp_path, "dst.csv", text)).facts
    assert spark.conf.get("spark.sql.session.timeZone") == "UTC"
    assert facts.collect()[0].ts == dt.datetime(2023, 3, 12, 2, 0)


def test_stored_profile_csv_read_back(spark, tmp_path):
    from cadence.sources.files import read_profile

    d = tmp_path / "profile" / "year=2023"
    d.mkdir(parents=True)
    (d / "p.csv").write_text(
        "station_complex_id,station_complex,hour,ridership\n444,\"Gun Hill Rd (2,5)\",7,57.5\n444,\"Gun Hill Rd (2,5)\",8,60\n"
    )
    rows = read_profile(spark, str(tmp_path / "profile"), year=2023, fmt="csv").orderBy("hour").collect()
    assert [(r.id, r.entity, r.hour, r.avg, r.year) for r in rows] == [
        ("444", "Gun Hill Rd (2,5)", 7, 57.5, 2023), ("444", "Gun Hill Rd (2,5)", 8, 60.0, 2023)]
