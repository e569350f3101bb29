"""CSV files of several headers, counters taken on the pass that parses, one-shuffle series."""

import json
import os

import pytest

from cadence.cli import main
from cadence.operators.quality import counters_table, observed
from cadence.plans import reports as rpt
from cadence.session import shared_dir
from cadence.sources.files import header_index, landed_counters, read_hourly_csv, read_landed, read_raw_csv_by_name, stage_facts
from cadence.sources.tables import events_hourly

A = "transit_timestamp,station_complex_id,station_complex,ridership\n01/02/2023 01:00:00 PM,1,Main,5\nnot a time,1,Main,6\n01/02/2024 12:00:00 AM,2,\"Gun Hill, Rd\",x\n"
B = " ridership , borough,station_complex,transit_timestamp,station_complex_id\n7,Q,Main,01/03/2023 02:00:00 AM,1\n,Q,Main,01/03/2024 02:00:00 AM,1\n"


@pytest.fixture()
def folder(tmp_path):
    os.makedirs(f"{tmp_path}/in put")
    for k in range(3):
        (tmp_path / "in put" / f"a{k} é.csv").write_text(A)
    (tmp_path / "in put" / "b.csv").write_text(B)
    (tmp_path / "in put" / "empty.csv").write_text("")
    return f"{tmp_path}/in put"


def test_files_are_joined_by_header(spark, folder):
    index = {os.path.basename(r["file"]): r["header"] for r in header_index(spark, folder).collect()}
    assert len(index) == 4 and len(set(index.values())) == 2
    raw = read_raw_csv_by_name(spark, folder)
    assert set(raw.columns) == {"transit_timestamp", "station_complex_id", "station_complex", "ridership", "borough"}
    assert raw.count() == 11 and raw.where("borough = 'Q'").count() == 2
    facts = read_hourly_csv(spark, folder).facts.collect()
    assert sorted(r["v"] for r in facts) == [5.0, 5.0, 5.0, 7.0]


def test_a_file_is_split_again_after_the_index(spark, folder):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    header_index(spark, folder)
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before


def test_headers_that_cannot_be_joined(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,A\n1,2\n")
    with pytest.raises(ValueError, match="twice"):
        read_raw_csv_by_name(spark, str(tmp_path))
    (tmp_path / "x.csv").write_text("")
    with pytest.raises(ValueError, match="no file"):
        read_raw_csv_by_name(spark, str(tmp_path))


def test_counters_of_a_pass(spark, folder):
    counts = stage_facts(read_raw_csv_by_name(spark, folder), shared_dir(spark, "t-staged"), years=[2023, 2024, 2030])
    assert counts == {"rows_read": 11, "bad_stamp": 3, "bad_measure": 4, "rows_kept": 4, "rows_in_year_2023": 4, "rows_in_year_2024": 0, "rows_in_year_2030": 0}
    rows = {(r["counter"], r["year"]): r["value"] for r in counters_table(spark, counts).collect()}
    assert rows["rows_in_year", 2023] == 4 and rows["rows_kept", None] == 4


def test_observation_costs_no_second_scan(spark):
    df, seen = observed(events_hourly(spark, "/root/testdata/sf0.001").facts, [2024])
    df.groupBy("entity").count().collect()
    assert seen.get["rows_read"] == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()


def test_every_run_writes_its_counters(spark, folder, capsys):
    out = shared_dir(spark, "t-runs")
    paths = main(["yearly", "--input", folder, "--years", "2023", "--out", out])
    assert json.loads(capsys.readouterr().out) == paths
    got = {(r["counter"], r["year"]): r["value"] for r in spark.read.parquet(paths["run_counters"]).collect()}
    assert got["bad_stamp", None] == 3 and got["rows_in_year", 2023] == 4
    landed = shared_dir(spark, "t-landed-runs")
    paths = main(["land", "--input", folder, "--out", landed])
    assert spark.read.parquet(paths["run_counters"]).count() == 6
    assert read_landed(spark, landed).facts.count() == 4  # the counters are no facts
    main(["land", "--input", folder, "--out", landed, "--append"])
    assert landed_counters(spark, landed, [2023, 2024]) == {"rows_in_year_2023": 8, "rows_in_year_2024": 0}
    paths = main(["yearly", "--source", "landed", "--input", landed, "--years", "2023", "--out", out])
    assert {(r["counter"], r["year"], r["value"]) for r in spark.read.parquet(paths["run_counters"]).collect()} == {("rows_in_year", 2023, 8)}


def test_pages_from_the_command_line(spark, tmp_path):
    os.makedirs(f"{tmp_path}/pages")
    page = [{"transit_timestamp": "2024-12-01T00:00:00", "station_complex_id": "1", "station_complex": "S", "ridership": "2"}]
    (tmp_path / "pages" / "1.json").write_text(json.dumps(page))
    (tmp_path / "pages" / "2.json").write_text(json.dumps(page)[:-9])
    paths = main(["yearly", "--source", "json", "--input", f"{tmp_path}/pages", "--years", "2024", "--out", shared_dir(spark, "t-pages")])
    got = {r["counter"]: r["value"] for r in spark.read.parquet(paths["run_counters"]).where("year is null").collect()}
    assert got == {"pages_read": 2, "pages_in_quarantine": 1, "rows_read": 1, "bad_stamp": 0, "bad_measure": 0, "rows_kept": 1}
    assert spark.read.parquet(paths["quarantined_pages"]).first()["body"] == json.dumps(page)[:-9]


@pytest.mark.parametrize("rule", ["group", "first_seen"])
def test_series_take_one_exchange(spark, rule):
    plan = rpt.monthly_series(events_hourly(spark, "/root/testdata/sf0.001"), name_rule=rule)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1
    assert "Window" not in text and "ObjectHashAggregate" not in text


def test_series_mean_cuts_no_digit(spark):
    from cadence.operators.series import filled_series

    rows = [("tiny", h, 1e-7) for h in range(24)] + [("huge", h, 1e13) for h in range(24)] + [("none", h, None) for h in range(24)]
    df = spark.createDataFrame(rows, "entity string, hour int, v double")
    got = {r["entity"]: r["mean"] for r in filled_series(df, ["entity"], min_slots=None).select("entity", "mean").distinct().collect()}
    assert got["huge"] == 1e13 and abs(got["tiny"] - 1e-7) < 1e-20 and got["none"] is None


def test_share_and_stored_profile_reports(spark, folder):
    out = shared_dir(spark, "t-more")
    paths = main(["shares-pct", "--input", folder, "--years", "2023", "--out", out, "--plain-names"])
    assert sum(r["pct"] for r in spark.read.parquet(paths["shares_pct"]).collect()) == pytest.approx(100)
    profile = main(["profile", "--input", folder, "--years", "2023", "--out", out, "--plain-names"])["hour_profile"]
    paths = main(["stored-profile", "--source", "landed", "--input", profile, "--out", out, "--years"])
    rows = spark.read.parquet(paths["stored_profile"]).collect()
    assert {(r["hour"], r["label"], r["avg"]) for r in rows} == {(13, "1 PM", 5.0), (2, "2 AM", 7.0)}
