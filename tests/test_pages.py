"""Pages with a quarantine: whole pages go on, broken ones are kept with path and text."""

import json
import os

import pytest
from pyspark.sql import functions as F

from cadence.sources import pages
from cadence.sources.files import clean_hourly, read_json_pages


def record(k):
    return {"transit_timestamp": f"2024-12-01T{k % 24:02d}:00:00", "station_complex_id": str(k), "station_complex": f"S {{{k}}} \"]\"", "ridership": str(k)}


BODIES = {
    "full.json": json.dumps([record(k) for k in range(5)]),
    "lines.json": json.dumps([record(5)], indent=2) + "\n\n",
    "empty.json": "[]",
    "cut.json": json.dumps([record(6), record(7)])[:-20],
    "error.json": '{"error": true, "message": "too many requests"}',
    "html.json": "<html>busy</html>",
    "two.json": json.dumps([record(8)]) + "\n" + json.dumps([record(9)]),
    "number.json": json.dumps([1, record(10)]),
    "blank.json": " \n",
    "zero.json": "",
    "null.json": "null",
    "extra.json": json.dumps([{**record(11), "borough": "Q", "page": "x", "kind": "y"}, {"ridership": 3.5}]),
}
GOOD = {"full.json": 5, "lines.json": 1, "empty.json": 0, "extra.json": 2}
REASONS = {
    "cut.json": pages.NOT_AN_ARRAY, "error.json": pages.NOT_AN_ARRAY, "html.json": pages.NOT_AN_ARRAY, "two.json": pages.NOT_AN_ARRAY,
    "number.json": pages.NOT_RECORDS, "blank.json": pages.EMPTY_FILE, "zero.json": pages.EMPTY_FILE, "null.json": pages.NOT_AN_ARRAY,
}


def land(folder, names):
    os.makedirs(folder, exist_ok=True)
    for n in names:
        with open(f"{folder}/{n}", "w") as f:
            f.write(BODIES[n])


def check(found, names):
    ledger = {os.path.basename(r["page"]): r for r in found.ledger.collect()}
    assert set(ledger) == set(names)
    assert {n: r["n_records"] for n, r in ledger.items() if r["reason"] is None} == {n: GOOD[n] for n in names if n in GOOD}
    assert {n: r["reason"] for n, r in ledger.items() if r["reason"]} == {n: REASONS[n] for n in names if n in REASONS}
    assert {os.path.basename(r["page"]): r["body"] for r in found.quarantine.collect()} == {n: BODIES[n] for n in names if n in REASONS}
    ids = sorted(r["station_complex_id"] or "" for r in found.records.collect())
    assert ids == sorted((r.get("station_complex_id") or "") for n in names if n in GOOD for r in json.loads(BODIES[n]))


def test_read_and_landed_pages(spark, tmp_path):
    land(f"{tmp_path}/in", BODIES)
    check(pages.read_pages(spark, f"{tmp_path}/in"), BODIES)
    found = pages.land_pages(spark, f"{tmp_path}/in", f"{tmp_path}/out")
    check(found, BODIES)
    facts = clean_hourly(found.records)
    assert facts.count() == 7 and facts.agg(F.sum("v")).first()[0] == sum(range(6)) + 11
    # only the folder of one kind is read
    plan = found.records._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(kind" in plan


def test_stream_adds_each_page_once(spark, tmp_path):
    landing, out, ckpt = (f"{tmp_path}/{n}" for n in ("in", "out", "ckpt"))
    first = ["full.json", "cut.json", "zero.json"]
    land(landing, first)
    check(pages.append_pages(spark, landing, out, ckpt, files_per_trigger=1), first)
    check(pages.append_pages(spark, landing, out, ckpt), first)  # nothing new
    land(landing, [n for n in BODIES if n not in first])
    check(pages.append_pages(spark, landing, out, ckpt), BODIES)


def test_no_pages(spark, tmp_path):
    land(f"{tmp_path}/in", ["empty.json"])
    found = pages.land_pages(spark, f"{tmp_path}/in", f"{tmp_path}/out")
    assert found.records.count() == 0 and found.quarantine.count() == 0 and found.ledger.count() == 1


def test_plain_reader_never_loses_a_page(spark, tmp_path):
    land(f"{tmp_path}/in", ["full.json", "cut.json"])
    with pytest.raises(Exception, match="MALFORMED|Malformed|malformed"):
        read_json_pages(spark, f"{tmp_path}/in").collect()


def test_folders_are_added_side_by_side_once(spark, tmp_path):
    names = sorted(BODIES)
    feeds = [f"{tmp_path}/in/feed={k}" for k in range(4)]
    out, ckpt = f"{tmp_path}/out", f"{tmp_path}/ckpt"

    def add(folders):
        return pages.append_pages(spark, folders, out, ckpt, files_per_trigger=2, tasks_per_trigger=1)

    for k, feed in enumerate(feeds):
        land(feed, names[k:6:3] if k < 3 else [])  # the last folder is empty
    check(add(feeds), names[:6])
    check(add(feeds), names[:6])  # nothing new
    for k, feed in enumerate(feeds):
        land(feed, names[6 + k :: 4])
    check(add([f"{f}/" for f in reversed(feeds)]), names)  # a folder's part is its path's, in any order
    # one file of a kind a trigger, not one for every core
    assert len(os.listdir(ckpt)) == 4
    for part in os.listdir(ckpt):
        triggers = len([n for n in os.listdir(f"{ckpt}/{part}/commits") if n.isdigit()])
        assert len([n for n in os.listdir(f"{out}/{part}/kind=page") if n.endswith(".parquet")]) <= triggers
        assert triggers >= 1


def test_a_failed_stream_leaves_the_others_whole(spark, tmp_path):
    land(f"{tmp_path}/in/a", ["full.json", "cut.json"])
    feeds = [f"{tmp_path}/in/b", f"{tmp_path}/in/a"]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        pages.append_pages(spark, feeds, f"{tmp_path}/out", f"{tmp_path}/ckpt")
    land(feeds[0], ["lines.json"])
    check(pages.append_pages(spark, feeds, f"{tmp_path}/out", f"{tmp_path}/ckpt"), ["full.json", "cut.json", "lines.json"])


def test_query_lands_a_file_a_page_in_few_folders(spark, tmp_path):
    from cadence.plans import catalog
    from cadence.sources.tables import read_table

    n = 40 * catalog.PAGE_ROWS - 7
    ids = spark.range(n).select(
        F.col("id").alias("event_id"), F.expr("timestamp_ntz'2024-01-01 00:00:00'").alias("ts"), F.lit(1).cast("long").alias("user_id"),
        F.lit("view").alias("event_type"), F.lit(2.5).alias("value"), F.lit("{}").alias("props"),
    )
    ids.union(ids.limit(3).withColumn("event_id", F.lit(None).cast("long"))).write.parquet(f"{tmp_path}/events.parquet")
    assert read_table(spark, str(tmp_path), "events").count() == n + 3
    landing = catalog._landed_pages(spark, str(tmp_path)).removeprefix("file:")
    folders = [f for f, _, _ in os.walk(landing) if f != landing]
    assert len(folders) <= catalog.PAGE_FEEDS + 1  # and one for pages without a number
    files = [f"{f}/{x}" for f in folders for x in os.listdir(f) if x.startswith("part-")]
    bodies = [open(x).read() for x in files]
    assert len(bodies) == 42 and sum(b == "[]\n" for b in bodies) == 1
    whole = [json.loads(b) for b in bodies if b.endswith("]\n")]
    assert sorted(len(w) for w in whole) == sorted([0, 3, catalog.PAGE_ROWS - 7] + [catalog.PAGE_ROWS] * 33)
    got = {r["name"]: (r["pages"], r["records"]) for r in catalog.queries()["append_pages_quarantine"](spark, str(tmp_path)).collect()}
    kept = 34 * catalog.PAGE_ROWS - 7 + 3
    assert got == {"whole": (36, kept), pages.NOT_AN_ARRAY: (6, 0), "view": (None, kept)}
