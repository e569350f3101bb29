"""Inputs that used to lose rows or digits without a word."""

import datetime as dt
import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from cadence.binding import FactSet
from cadence.cli import main
from cadence.functions.clean import to_number
from cadence.plans import bundles
from cadence.plans import reports as rpt
from cadence.session import shared_dir
from cadence.sources.files import RAW_SCHEMA, land_as_parquet, read_landed, read_raw_csv
from cadence.streaming.running import append_stream

SCHEMA = "ts timestamp_ntz, id string, entity string, v double"


def facts(spark, rows):
    return FactSet(spark.createDataFrame(rows, SCHEMA))


def hours(year, n=24, name="A", sid="1", v=1.0):
    return [(dt.datetime(year, 1, 1, h), sid, name, v) for h in range(n)]


def test_small_values_add_up(spark):
    fs = facts(spark, [(dt.datetime(2023, 1, 1), "1", "A", 0.004)] * 1000)
    assert rpt.entity_year_totals(fs, [2023]).collect()[0].total == pytest.approx(4.0)


def test_a_scale_that_does_not_fit_fails(spark):
    fs = replace(facts(spark, [(dt.datetime(2023, 1, 1), "1", "A", 0.004)]), scale=2)
    with pytest.raises(Exception, match="more than 2 decimals"):
        rpt.entity_year_totals(fs, [2023]).collect()


def test_monthly_report_keeps_to_its_years(spark):
    fs = facts(spark, hours(2019) + hours(2023))
    got = bundles.monthly_report(spark, fs, [2023])["monthly_series"]
    assert {r.year for r in got.select("year").distinct().collect()} == {2023}


def test_a_renamed_station_is_one_series_under_its_first_name(spark):
    rows = [(dt.datetime(2023, 1, 1, h), "1", "Right" if h < 12 else "Later", float(h)) for h in range(1, 23)]
    rows.append((dt.datetime(2023, 1, 1, 0), "1", "Wrong", None))
    got = bundles.monthly_report(spark, facts(spark, rows), [2023])["monthly_series"].collect()
    assert len(got) == 24 and {r.entity for r in got} == {"Right"}


def test_every_two_adjacent_years_stand_side_by_side(spark):
    fs = facts(spark, hours(2019) + hours(2022) + hours(2023))
    names = set(bundles.yearly_report(spark, fs, [2019, 2022, 2023]))
    assert {"top_10_side_by_side_2019_2022", "top_10_side_by_side_2022_2023"} <= names


def test_all_landed_folders_are_read(spark):
    paths = [shared_dir(spark, f"t-many-{k}") for k in range(2)]
    for p in paths:
        land_as_parquet(facts(spark, hours(2023)), p)
    assert read_landed(spark, paths).facts.count() == 48


def test_files_with_another_header_fail(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.csv").write_text("y,x\n3,4\n")
    with pytest.raises(Exception):
        read_raw_csv(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]).collect()


def test_infinite_cells_are_missing_or_fail(spark):
    rows = spark.createDataFrame([("Infinity",), ("-Infinity",), ("1.5",)], "t string")
    assert [r[0] for r in rows.select(to_number("t")).collect()] == [None, None, 1.5]
    with pytest.raises(Exception, match="cannot parse number"):
        rows.select(to_number("t", strict=True)).collect()


def _page(tmp_path, text):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "p.json").write_text(text)
    return str(tmp_path / "in")


def test_array_pages_stream_with_their_option(spark, tmp_path):
    records = [{c: str(k) for c in RAW_SCHEMA.names} for k in range(5)]
    landing = _page(tmp_path, json.dumps(records, indent=1))
    out = append_stream(spark, landing, RAW_SCHEMA, lambda d: d, str(tmp_path / "o"), str(tmp_path / "c"), options={"multiLine": "true"})
    assert out.where(F.col(RAW_SCHEMA.names[0]).isNotNull()).count() == 5


def test_unreadable_pages_fail_instead_of_vanishing(spark, tmp_path):
    landing = _page(tmp_path, json.dumps([{c: "1" for c in RAW_SCHEMA.names}] * 2, indent=1))
    with pytest.raises(Exception):
        append_stream(spark, landing, RAW_SCHEMA, lambda d: d, str(tmp_path / "o"), str(tmp_path / "c")).count()


def test_command_line_years_reach_the_monthly_report(spark):
    landed, out = shared_dir(spark, "t-years"), shared_dir(spark, "t-years-out")
    land_as_parquet(facts(spark, hours(2019) + hours(2023)), landed)
    paths = main(["monthly", "--input", landed, "--source", "landed", "--out", out, "--years", "2023", "--plain-names"])
    got = spark.read.parquet(paths["monthly_series"])
    assert {r.year for r in got.select("year").distinct().collect()} == {2023}
