"""Distributed positions, the store of partials, and compaction of running state."""

import random

import pytest
from pyspark.sql import functions as F

from cadence.operators import aggregate as agg
from cadence.operators.position import page_at, rank_every, with_position
from cadence.operators.store import PartialStore
from cadence.session import shared_dir
from cadence.sinks.writers import list_folders
from cadence.sources.tables import events_hourly
from cadence.streaming import running
from cadence.streaming.running import RunningState, running_totals

SF = "/root/testdata/sf0.001"


def test_positions_of_rows_with_ties_and_nulls(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice([None, 1, 1, 2, 7]), rnd.random(), k) for k in range(500)]
    df = spark.createDataFrame(rows, "a int, b double, k int").repartition(7)
    placed = with_position(df, ["a", F.col("b").desc()]).collect()
    assert sorted(r["position"] for r in placed) == list(range(1, 501))
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, -r[1]))
    assert [r["k"] for r in sorted(placed, key=lambda r: r["position"])] == [r[2] for r in ordered]
    deep = page_at(df, ["a", F.col("b").desc()], 390, 20).orderBy("position").collect()
    assert [r["k"] for r in deep] == [r[2] for r in ordered[390:410]]
    with pytest.raises(ValueError):
        with_position(df.withColumn("_pos_x", F.lit(1)), ["a"])
    assert with_position(df.limit(0), ["a"]).count() == 0


def test_ranks_of_a_group_that_is_most_of_the_table(spark):
    rows = [("hot", k % 700, f"e{k}") for k in range(3000)] + [("small", 5, "x"), ("small", 9, "y"), (None, 1, "z")]
    df = spark.createDataFrame(rows, "g string, total int, entity string")
    got = {(r["g"], r["entity"]): r["rank"] for r in rank_every(df, ["g"], [F.col("total").desc(), "entity"]).collect()}
    for g in ("hot", "small", None):
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))
        assert [got[g, r[2]] for r in mine] == list(range(1, len(mine) + 1))


def keys():
    return {"entity": F.col("entity"), "hour": F.hour("ts")}


def rows_of(df):
    return sorted(tuple(r) for r in df.select("entity", "hour", "s", "n", "rows").collect())


def test_store_of_partials(spark, monkeypatch):
    fs = events_hourly(spark, SF)
    store = PartialStore(spark, shared_dir(spark, "t-store"), ["entity", "hour"])
    with pytest.raises(ValueError):
        store.merged()
    halves = {"a": fs.where(F.col("key") % 2 == 0), "b": fs.where(F.col("key") % 2 == 1)}
    for name, part in halves.items():
        store.put(name, agg.key_sums(part, keys()))
    whole = rows_of(agg.key_sums(fs, keys()))
    assert rows_of(store.merged()) == whole
    # putting a slice again replaces it
    assert store.put("b", agg.key_sums(halves["b"], keys())) == 2
    assert rows_of(store.merged()) == whole
    assert rows_of(store.merged(["a"])) == rows_of(agg.key_sums(halves["a"], keys()))
    # a run that died before its note does not count, and blocks nothing
    agg.key_sums(halves["a"], keys()).write.parquet(f"{store.path}/data/slice=b/version=3")
    assert rows_of(store.merged()) == whole
    assert store.put("b", agg.key_sums(halves["b"], keys())) == 4
    assert store.vacuum(keep=1) == 3 and rows_of(store.merged()) == whole
    assert list_folders(spark, f"{store.path}/data/slice=b") == ["version=4"]


def test_store_scans_only_the_month_it_adds(spark):
    fs = events_hourly(spark, SF)
    months = sorted((r[0], r[1]) for r in fs.facts.select(F.year("ts"), F.month("ts")).distinct().collect())
    store = PartialStore(spark, shared_dir(spark, "t-months"), ["entity", "hour"])
    assert store.missing_months(months) == months
    for y, m in months:
        store.put_month(fs, y, m, keys())
    assert store.missing_months([*months, (1999, 1)]) == [(1999, 1)]
    assert rows_of(store.merged()) == rows_of(agg.key_sums(fs, keys()))


def stream(spark, at, files, compact_every):
    facts = events_hourly(spark, SF).facts
    for k in files:
        facts.where(F.col("key") % 60 == k).coalesce(1).write.mode("append").parquet(at["landing"])
    return running_totals(
        spark, at["landing"], facts.schema, keys(), "v", out=at["out"], checkpoint=at["checkpoint"],
        files_per_trigger=1, scale=2, compact_every=compact_every,
    )


def expected(spark, upto):
    return rows_of(agg.key_sums(events_hourly(spark, SF).where(F.col("key") % 60 < upto), keys()))


def state_of(spark, at, table):
    (own,) = list_folders(spark, at["out"])
    return RunningState(spark, f"{at['out']}/{own}", ["entity", "hour"], table.schema)


def test_state_stays_small_over_many_triggers(spark):
    at = {n: shared_dir(spark, f"t-state-{n}") for n in ("landing", "out", "checkpoint")}
    for k in range(0, 20, 4):
        table = stream(spark, at, range(k, k + 4), compact_every=4)
        assert rows_of(table) == expected(spark, k + 4)
    state = state_of(spark, at, table)
    assert len(state.bases()) == 2 and len(list_folders(spark, f"{state.path}/changed")) <= 6


def test_crash_between_the_steps_of_a_compaction(spark, monkeypatch):
    at = {n: shared_dir(spark, f"t-crash-{n}") for n in ("landing", "out", "checkpoint")}
    table = stream(spark, at, range(3), compact_every=None)
    want = expected(spark, 3)
    state = state_of(spark, at, table)
    # died after the base, before its note
    state._write_base(state.epochs_since_base()[-1])
    assert state.bases() == [] and rows_of(state.table()) == want
    # died after the note, before anything was removed
    monkeypatch.setattr(RunningState, "_remove_old", lambda self: None)
    state.compact()
    assert state.epochs_since_base() == [] and rows_of(state.table()) == want
    old_reader = state.table()
    monkeypatch.undo()
    table = stream(spark, at, range(3, 6), compact_every=1)
    assert rows_of(table) == expected(spark, 6)
    assert rows_of(old_reader) == want  # a reader of the base before still finds it
    # died half way through removing
    real, calls = running.delete_folder, []

    def dies(spark_, path):
        calls.append(path)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return real(spark_, path)

    monkeypatch.setattr(running, "delete_folder", dies)
    with pytest.raises(RuntimeError):
        stream(spark, at, range(6, 8), compact_every=1)
    monkeypatch.undo()
    assert rows_of(state.table()) == expected(spark, 8)
    assert rows_of(stream(spark, at, range(8, 9), compact_every=1)) == expected(spark, 9)
