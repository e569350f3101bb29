"""Stamp formats by vote; landed facts read by their folders."""

import datetime as dt
import os

from pyspark.sql import functions as F

from cadence.operators import entity as ent
from cadence.session import shared_dir
from cadence.sources.files import land_as_parquet, landed_months, read_landed
from cadence.sources.stamps import read_hourly_csv_voted
from cadence.sources.tables import orders_customer

SF = "/root/testdata/sf0.001"
HEADER = "transit_timestamp,station_complex_id,station_complex,ridership"
FILES = {
    "us.csv": ["10/18/2022 07:00:00 PM", "1/2/2022 12:00:00 AM"],
    "us24.csv": ["01/13/2024 13:00", "02/03/2024 04:05:06"],
    "eu.csv": ["13/01/2024 13:00", "02/03/2024 04:05", "junk"],
    "iso.csv": ["2024-12-01T00:00:00", "2024-12-01 07:00:00.250", ""],
    "either.csv": ["02/03/2024 13:00"],
    "none.csv": ["yesterday", ""],
}
STAMPS = {
    "us.csv": [dt.datetime(2022, 10, 18, 19), dt.datetime(2022, 1, 2)],
    "us24.csv": [dt.datetime(2024, 1, 13, 13), dt.datetime(2024, 2, 3, 4, 5, 6)],
    "eu.csv": [dt.datetime(2024, 1, 13, 13), dt.datetime(2024, 3, 2, 4, 5)],
    "iso.csv": [dt.datetime(2024, 12, 1), dt.datetime(2024, 12, 1, 7, 0, 0, 250000)],
    "either.csv": [dt.datetime(2024, 2, 3, 13)],
    "none.csv": [],
}


def test_each_file_is_read_in_its_own_format(spark, tmp_path):
    for name, stamps in FILES.items():
        (tmp_path / name).write_text("\n".join([HEADER, *[f"{s},{name},S,1" for s in stamps]]) + "\n")
    facts, votes = read_hourly_csv_voted(spark, str(tmp_path))
    got = {}
    for r in facts.facts.collect():
        got.setdefault(r["id"], []).append(r["ts"])
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in STAMPS.items() if v}
    told = {os.path.basename(r["_file"]): r for r in votes.collect()}
    assert [n for n, r in told.items() if r["ambiguous"]] == ["either.csv"]
    assert told["none.csv"]["format"] is None and told["eu.csv"]["n"] == 3
    assert told["eu.csv"]["format"] == "d/M/yyyy H:mm[:ss]"


def test_first_months_read_only_their_folders(spark):
    path = shared_dir(spark, "t-first-landed")
    facts = orders_customer(spark, SF).facts
    first = facts.agg(F.min(F.year("ts"))).first()[0]
    # later rows only for ids seen in the first year
    early = facts.where(F.year("ts") == first).select("id").distinct()
    land_as_parquet(orders_customer(spark, SF).with_facts(facts.join(early, "id", "left_semi")), path)
    rows = ent.first_month_rows(read_landed(spark, path), spark)
    assert {r["year"] for r in rows.select("year").distinct().collect()} == {first}
    filters = rows._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]
    assert f"= {first}" in filters and "month" in filters


def test_months_from_folder_names(spark):
    path = shared_dir(spark, "t-months-landed")
    fs = orders_customer(spark, SF)
    land_as_parquet(fs, path)
    got = {(r["year"], r["month"]) for r in landed_months(spark, path).collect()}
    assert got == {(r["year"], r["month"]) for r in ent.distinct_months(fs.facts).collect()}
    assert landed_months(spark, shared_dir(spark, "t-nothing")).count() == 0
