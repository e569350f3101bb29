"""The report command line on a small hourly export."""

import datetime as dt
import random

import pytest

from cadence.cli import main
from cadence.session import shared_dir


@pytest.fixture(scope="module")
def export(tmp_path_factory):
    rnd = random.Random(3)
    lines = ["transit_timestamp,station_complex_id,station_complex,ridership"]
    start = dt.datetime(2023, 1, 1)
    for h in range(0, 24 * 400, 5):
        t = start + dt.timedelta(hours=h)
        for sid, name in (("1", "Main St"), ("2", '"Gun Hill Rd (2,5)"')):
            lines.append(f"{t.strftime('%m/%d/%Y %I:%M:%S %p')},{sid},{name},{rnd.randint(0, 90)}")
    lines.append("bad stamp,1,Main St,4")
    p = tmp_path_factory.mktemp("export") / "hourly.csv"
    p.write_text("\n".join(lines) + "\n")
    return str(p)


def test_land_then_seasonal_report(spark, export):
    landed = shared_dir(spark, "t-landed")
    main(["land", "--input", export, "--out", landed])
    out = shared_dir(spark, "t-cli")
    paths = main(["seasonal", "--input", landed, "--source", "landed", "--years", "2023", "2024", "--out", out])
    matrix = spark.read.parquet(paths["season_matrix"])
    assert {"Station", "Winter", "Spring", "Summer", "Fall"} <= set(matrix.columns)
    compare = spark.read.parquet(paths["season_compare"])
    assert set(compare.columns) == {"slot", "Season", "2023", "2024"}
    # the year filter prunes the landed year/month folders
    from cadence.sources.files import read_landed

    plan = read_landed(spark, landed).for_years([2023]).facts._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan


@pytest.mark.parametrize(
    "report,table,heading",
    [
        ("yearly", "shares", "percentage"),
        ("hourly", "hour_averages", "Average Ridership"),
        ("weekday", "weekday_averages", "Day of the Week"),
        ("monthly", "monthly_series", "Time (EST)"),
        ("directory", "directory", "station_complex_id"),
        ("profile", "hour_profile", "ridership"),
        ("network", "network_hour_curve", "AM_PM"),
        ("peak-hours", "peak_hours", "peak_hour"),
    ],
)
def test_reports_from_csv(spark, export, report, table, heading):
    out = shared_dir(spark, f"t-cli-{report}")
    paths = main([report, "--input", export, "--years", "2023", "2024", "--out", out, "--format", "csv"])
    df = spark.read.option("header", True).csv(paths[table])
    assert heading in df.columns and df.count() > 0


def test_extract_and_first_month(spark, export):
    out = shared_dir(spark, "t-cli-x")
    p = main(["extract", "--input", export, "--ids", "1", "--start", "2023-02-01 00:00:00",
              "--end", "2023-02-28 23:59:59", "--out", out])
    rows = spark.read.parquet(p["extract"]).collect()
    assert rows and all(r.id == "1" and r.ts.month == 2 for r in rows)
    p = main(["first-month", "--input", export, "--out", out])
    months = {(r.id, r.month) for r in spark.read.parquet(p["first_month_rows"]).collect()}
    assert months == {("1", 1), ("2", 1)}


def test_report_from_json_pages(spark, tmp_path):
    import json

    recs = [
        {"transit_timestamp": f"2023-0{m}-01T0{h}:00:00", "station_complex_id": "9",
         "station_complex": "Pier St", "ridership": str(m * 10 + h)}
        for m in range(1, 4) for h in range(3)
    ]
    d = tmp_path / "pages"
    d.mkdir()
    (d / "p1.json").write_text(json.dumps(recs[:5]))
    (d / "p2.json").write_text(json.dumps(recs[5:]))
    (d / "p3.json").write_text("[]")
    out = shared_dir(spark, "t-cli-json")
    paths = main(["yearly", "--input", str(d), "--source", "json", "--years", "2023", "--out", out, "--plain-names"])
    shares = spark.read.parquet(paths["shares"]).collect()
    assert [(r.entity, r.total, r.share) for r in shares] == [("Pier St", float(sum(int(r["ridership"]) for r in recs)), 1.0)]


def test_histogram_of_named_stations(spark, export):
    out = shared_dir(spark, "t-cli-hist")
    p = main(["histogram", "--input", export, "--names", "Main St", "--out", out])
    rows = spark.read.parquet(p["hour_totals"]).collect()
    assert rows and {r.hour for r in rows} <= set(range(24))
