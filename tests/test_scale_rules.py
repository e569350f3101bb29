"""Written order, streamed results and the bounds that operators check."""

import pytest
from pyspark.sql import functions as F

from cadence.cli import main
from cadence.operators import entity as ent
from cadence.operators.aggregate import with_default
from cadence.operators.rank import rank_within, share_of_total
from cadence.plans import bundles
from cadence.session import shared_dir
from cadence.sources.tables import events_two_years
from cadence.streaming.running import running_totals

SF = "/root/testdata/sf0.001"
SCHEMA = "k STRING, v DOUBLE"


def _files(spark, path):
    """Rows of every file under ``path`` as its writer left them."""
    rows = spark.read.parquet(path).select("*", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at")).collect()
    files = {}
    for r in sorted(rows, key=lambda r: r["at"]):
        files.setdefault(r["file"], []).append(r)
    return files.values()


@pytest.mark.parametrize("name", ["hour_averages", "monthly_series"])
def test_written_report_files_are_sorted(spark, name):
    fs = events_two_years(spark, SF)
    bundle = bundles.hourly_report(spark, fs, [2023, 2024]) if name == "hour_averages" else bundles.monthly_report(spark, fs, [2023, 2024], min_slots=None)
    paths = bundles.write_report(spark, bundle, shared_dir(spark, "t-order"))
    by = [c for c in ("year", "month", "id", "entity", "hour") if c in bundle[name].columns]
    assert "Sort" not in bundle["hour_averages"]._jdf.queryExecution().optimizedPlan().toString() if name == "hour_averages" else True
    files = list(_files(spark, paths[name]))
    assert sum(map(len, files)) == bundle[name].count() > 24
    for rows in files:
        keys = [tuple(r[c] for c in by) for r in rows]
        assert keys == sorted(keys)


def _running(spark, landing, out, checkpoint):
    schema = spark.createDataFrame([], SCHEMA).schema
    got = running_totals(spark, landing, schema, {"k": F.col("k")}, "v", out=out, checkpoint=checkpoint)
    return {r["k"]: (float(r["s"]) if r["s"] is not None else None, r["n"], r["rows"]) for r in got.collect()}


def test_running_totals_empty_then_growing(spark):
    landing, out, ckpt = (shared_dir(spark, n) for n in ("e-landing", "e-out", "e-ckpt"))
    spark.createDataFrame([], SCHEMA).write.parquet(landing)
    assert _running(spark, landing, out, ckpt) == {}
    spark.createDataFrame([("a", 1.0), ("b", 2.5), ("a", None), (None, 4.0)], SCHEMA).write.mode("append").parquet(landing)
    assert _running(spark, landing, out, ckpt) == {"a": (1.0, 1, 2), "b": (2.5, 1, 1)}
    # only ``a`` changes: ``b`` comes from the earlier batch
    spark.createDataFrame([("a", 0.5)], SCHEMA).write.mode("append").parquet(landing)
    assert _running(spark, landing, out, ckpt) == {"a": (1.5, 2, 3), "b": (2.5, 1, 1)}
    # nothing new: the same result
    assert _running(spark, landing, out, ckpt) == {"a": (1.5, 2, 3), "b": (2.5, 1, 1)}


def test_running_totals_skip_an_unfinished_batch(spark):
    landing, out, ckpt = (shared_dir(spark, n) for n in ("u-landing", "u-out", "u-ckpt"))
    spark.createDataFrame([("a", 1.0)], SCHEMA).write.parquet(landing)
    want = _running(spark, landing, out, ckpt)
    # a batch that was cut off before it was noted as whole
    half = spark.read.parquet(f"{out}/*/changed/epoch=0").withColumn("rows", F.lit(99).cast("long"))
    where = spark.read.parquet(f"{out}/*/changed/epoch=0").inputFiles()[0].rsplit("/epoch=0", 1)[0]
    half.write.parquet(f"{where}/epoch=77")
    assert _running(spark, landing, out, ckpt) == want


def test_only_calendar_keys_are_broadcast(spark):
    df = spark.createDataFrame([(1, 2.0)], "id INT, total DOUBLE")
    with pytest.raises(ValueError):
        with_default(df.select("id"), df, ["id"])
    with pytest.raises(ValueError):
        share_of_total(df, df.withColumnRenamed("total", "group_total"), ["id"])


def test_long_rank_lists_are_refused(spark):
    df = spark.createDataFrame([(1, "a", 2.0)], "year INT, entity STRING, total DOUBLE")
    assert rank_within(df, ["year"], n=1000).count() == 1
    with pytest.raises(ValueError):
        rank_within(df, ["year"], n=1001)


def test_deep_pages_are_refused(spark):
    with pytest.raises(ValueError):
        ent.page(spark.range(3), ["id"], ent.MAX_PAGE_END, 1)


def test_land_adds_to_a_folder(spark, tmp_path):
    for month in (1, 2):
        (tmp_path / f"{month}.csv").write_text(f"transit_timestamp,station_complex_id,station_complex,ridership\n0{month}/03/2024 01:00:00 AM,1,Main St,5\n")
    out = shared_dir(spark, "t-land-append")
    main(["land", "--input", str(tmp_path / "1.csv"), "--out", out])
    main(["land", "--input", str(tmp_path / "2.csv"), "--out", out, "--append"])
    assert spark.read.parquet(out).count() == 2


def test_first_month_of_chosen_ids(spark, tmp_path):
    rows = "".join(f"0{m}/03/2024 01:00:00 AM,{i},S{i},5\n" for m in (1, 2) for i in (1, 2))
    (tmp_path / "x.csv").write_text("transit_timestamp,station_complex_id,station_complex,ridership\n" + rows)
    paths = main(["first-month", "--input", str(tmp_path / "x.csv"), "--ids", "2", "--out", shared_dir(spark, "t-first"), "--plain-names"])
    got = spark.read.parquet(paths["first_month_rows"]).collect()
    assert [(r["id"], r["month"]) for r in got] == [("2", 1)]
