"""Streamed running state equals the batch result; sinks write and read back."""

import os

import pytest
from pyspark.sql import functions as F

from cadence.operators import aggregate as agg
from cadence.plans import reports as rpt
from cadence.session import shared_dir
from cadence.sinks.writers import append, run_folder, write_bundle, write_csv, write_partitioned
from cadence.sources.tables import events_hourly, lineitem_supplier
from cadence.streaming.running import running_totals

SF = "/root/testdata/sf0.001"


def test_running_totals_equal_batch_over_several_files(spark):
    facts = events_hourly(spark, SF).facts
    landing = shared_dir(spark, "t-landing")
    # three landed files, arriving in any order
    for cut in (0, 1, 2):
        facts.where(F.col("key") % 3 == cut).write.mode("append").parquet(landing)
    keys = {"entity": F.col("entity"), "hour": F.hour("ts")}
    streamed = running_totals(
        spark, landing, facts.schema, keys, "v",
        out=shared_dir(spark, "t-out"), checkpoint=shared_dir(spark, "t-ckpt"), files_per_trigger=1, scale=2,
    )
    batch = agg.key_sums(events_hourly(spark, SF), keys)
    a = sorted(tuple(r) for r in streamed.select("entity", "hour", "s", "n", "rows").collect())
    b = sorted(tuple(r) for r in batch.select("entity", "hour", "s", "n", "rows").collect())
    assert a == b and len(a) == 120


def test_running_totals_resume_from_checkpoint(spark):
    facts = events_hourly(spark, SF).facts
    landing, out, ckpt = (shared_dir(spark, n) for n in ("r-landing", "r-out", "r-ckpt"))
    keys = {"entity": F.col("entity")}
    facts.where(F.col("key") % 2 == 0).write.parquet(landing)
    running_totals(spark, landing, facts.schema, keys, "v", out=out, checkpoint=ckpt)
    facts.where(F.col("key") % 2 == 1).write.mode("append").parquet(landing)
    resumed = running_totals(spark, landing, facts.schema, keys, "v", out=out, checkpoint=ckpt)
    total = resumed.agg(F.sum("rows")).collect()[0][0]
    assert total == facts.count()


def test_bundle_csv_round_trip(spark):
    fs = lineitem_supplier(spark, SF)
    root = run_folder(shared_dir(spark, "t-bundle"))
    table = rpt.entity_year_totals(fs, [1996, 1997])
    paths = write_bundle({"entity_totals": table}, root, fmt="csv", partition_by={"entity_totals": ["year"]})
    back = spark.read.option("header", True).schema("entity string, total double").csv(paths["entity_totals"])
    a = sorted(tuple(r) for r in back.select("year", "entity", "total").collect())
    b = sorted(tuple(r) for r in table.collect())
    assert a == b
    assert "run_ts=" in root


def test_never_overwrite(spark):
    df = spark.range(3)
    path = shared_dir(spark, "t-once")
    write_csv(df, path)
    with pytest.raises(Exception):
        write_csv(df, path)


def test_append_and_partitioned_layout(spark):
    path = shared_dir(spark, "t-append")
    df = spark.range(4).select(F.col("id"), (F.col("id") % 2).alias("year"))
    append(df, path)
    append(df, path)
    assert spark.read.parquet(path).count() == 8
    out = shared_dir(spark, "t-parts")
    write_partitioned(df, out, ["year"])
    assert spark.read.parquet(out).where("year = 1").count() == 2
    if not out.startswith(("hdfs:", "s3")):
        base = out.replace("file:", "")
        assert sorted(p for p in os.listdir(base) if p.startswith("year=")) == ["year=0", "year=1"]


def test_append_stream_is_exactly_once_across_restarts(spark):
    from cadence.sources.files import RAW_SCHEMA, clean_hourly
    from cadence.streaming.running import append_stream

    e = spark.read.parquet(f"{SF}/events.parquet")
    pages = e.select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("transit_timestamp"),
        F.col("user_id").cast("string").alias("station_complex_id"),
        F.col("event_type").alias("station_complex"),
        F.col("value").cast("string").alias("ridership"),
        (F.col("event_id") % 2).alias("half"),
    )
    landing, out, ckpt = (shared_dir(spark, n) for n in ("p-landing", "p-out", "p-ckpt"))
    pages.where("half = 0").drop("half").write.json(landing)
    clean = lambda df: clean_hourly(df, mode="lenient")
    first = append_stream(spark, landing, RAW_SCHEMA, clean, out=out, checkpoint=ckpt).count()
    pages.where("half = 1").drop("half").write.mode("append").json(landing)
    # a restart over the same checkpoint appends only the newly landed files
    total = append_stream(spark, landing, RAW_SCHEMA, clean, out=out, checkpoint=ckpt).count()
    assert first == e.where("event_id % 2 = 0").count()
    assert total == e.count()
