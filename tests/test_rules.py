"""Null, NaN and tie rules of the reports, on hand-made rows."""

from dataclasses import replace
import datetime as dt

from pyspark.sql import functions as F

from cadence.binding import FactSet
from cadence.operators import aggregate as agg
from cadence.plans import reports as rpt

SCHEMA = "ts timestamp_ntz, id string, entity string, v double"


def facts(spark, rows):
    return FactSet(spark.createDataFrame(rows, SCHEMA))


def T(y, m=1, d=1, h=0):
    return dt.datetime(y, m, d, h)


def test_null_group_key_is_not_a_group(spark):
    fs = facts(spark, [(T(2023), "1", "A", 1.0), (T(2023), "2", None, 5.0)])
    out = rpt.entity_year_totals(fs, [2023]).collect()
    assert [(r.entity, r.total) for r in out] == [("A", 1.0)]


def test_sum_of_all_null_group_is_zero(spark):
    fs = facts(spark, [(T(2023), "1", "A", None), (T(2023), "1", "A", None)])
    out = rpt.entity_year_totals(fs, [2023]).collect()
    assert out[0].total == 0.0


def test_mean_ignores_nulls_and_all_null_is_null(spark):
    fs = facts(spark, [(T(2023, h=7), "1", "A", 2.0), (T(2023, h=7), "1", "A", None),
                       (T(2023, h=8), "1", "A", None)])
    out = {r.hour: r.avg for r in rpt.hour_average_by_entity(fs).collect()}
    assert out == {7: 2.0, 8: None}


def test_zero_if_empty_average(spark):
    fs = facts(spark, [(T(2023, h=8), "1", "A", None)])
    out = rpt.hour_average_by_entity_year(fs, [2023]).collect()
    assert out[0].avg == 0.0


def test_average_is_per_row_not_per_hour(spark):
    # two rows for one station and hour: the average is over rows
    fs = facts(spark, [(T(2023, h=7), "1", "A", 10.0), (T(2023, h=7), "1", "A", 20.0),
                       (T(2023, 2, 1, 7), "1", "A", 60.0)])
    out = rpt.hour_average_by_entity(fs).collect()
    assert out[0].avg == 30.0


def test_count_against_rows(spark):
    fs = facts(spark, [(T(2023, h=1), "1", "A", None), (T(2023, h=1), "1", "A", 4.0)])
    r = agg.key_sums(fs, {"hour": F.hour("ts")}).collect()[0]
    assert (r.n, r.rows) == (1, 2)
    prof = {p.hour: p.avg_per_row for p in rpt.hour_profile(spark, fs).collect()}
    assert prof[1] == 2.0 and prof[2] is None and len(prof) == 24


def test_year_share_counts_unnamed_rows(spark):
    fs = facts(spark, [(T(2023), "1", "A", 30.0), (T(2023), "2", None, 70.0)])
    out = rpt.entity_shares(fs, [2023]).collect()
    assert [(r.entity, r.share) for r in out] == [("A", 0.3)]


def test_share_zero_when_total_not_positive(spark):
    fs = facts(spark, [(T(2023), "1", "A", 0.0)])
    assert rpt.entity_shares(fs, [2023]).collect()[0].share == 0.0


def test_ties_broken_by_name(spark):
    fs = facts(spark, [(T(2023), "1", "B", 5.0), (T(2023), "2", "A", 5.0), (T(2023), "3", "C", 1.0)])
    out = rpt.top_by_year(fs, [2023], n=2).orderBy("rank").collect()
    assert [r.entity for r in out] == ["A", "B"]


def test_one_name_two_ids_and_one_id_two_names(spark):
    fs = facts(spark, [(T(2023), "1", "A", 1.0), (T(2023), "2", "A", 2.0), (T(2023), "3", "B", 4.0),
                       (T(2023), "3", "C", 8.0)])
    totals = {r.entity: r.total for r in rpt.entity_year_totals(fs, [2023]).collect()}
    assert totals == {"A": 3.0, "B": 4.0, "C": 8.0}
    by_id = rpt.hour_average_by_entity_year(fs, [2023], keep_id=True).collect()
    assert sorted((r.id, r.entity) for r in by_id) == [("1", "A"), ("2", "A"), ("3", "B"), ("3", "C")]


def test_requested_year_without_rows_is_zero(spark):
    fs = facts(spark, [(T(2023), "1", "A", 1.5)])
    out = {r.year: r.total for r in rpt.yearly_totals(spark, fs, [2023, 2024]).collect()}
    assert out == {2023: 1.5, 2024: 0.0}


def test_names_dimension_is_joined_after_aggregation(spark):
    f = spark.createDataFrame([(T(2023), 1, 2.0), (T(2023), 1, 3.0), (T(2023), 9, 5.0)],
                              "ts timestamp_ntz, id long, v double")
    names = spark.createDataFrame([(1, "A")], "id long, entity string")
    fs = FactSet(f, names)
    out = rpt.entity_shares(fs, [2023]).collect()
    # id 9 has no name: not an entity, but part of the year total
    assert [(r.entity, r.total, r.share) for r in out] == [("A", 5.0, 0.5)]


def test_season_of_december_is_its_own_years_winter(spark):
    fs = facts(spark, [(T(2023, 12, 5), "1", "A", 1.0), (T(2023, 1, 5), "1", "A", 2.0),
                       (T(2023, 7, 5), "1", "A", 4.0)])
    r = rpt.season_matrix(fs, [2023]).collect()[0]
    assert (r.Winter, r.Spring, r.Summer, r.Fall) == (3.0, 0.0, 4.0, 0.0)


def test_weekday_average_of_daily_totals(spark):
    # Monday 2023-01-02 total 6 (two rows), Monday 2023-01-09 total 10
    fs = facts(spark, [(T(2023, 1, 2, 1), "1", "A", 2.0), (T(2023, 1, 2, 5), "2", "B", 4.0),
                       (T(2023, 1, 9, 3), "1", "A", 10.0)])
    out = {(r.slot, r.day): r.avg_total for r in rpt.weekday_average(spark, fs, [2023]).collect()}
    assert out[(0, "Monday")] == 8.0
    assert out[(6, "Sunday")] is None and len(out) == 7


def test_nan_measure_is_missing(spark):
    fs = facts(spark, [(T(2023, h=3), "1", "A", float("nan")), (T(2023, h=3), "1", "A", 3.0)])
    r = agg.key_sums(fs, {"hour": F.hour("ts")}).collect()[0]
    assert (float(r.s), r.n, r.rows) == (3.0, 1, 2)


def test_fixed_point_sum_is_exact(spark):
    # 0.1 + 0.2 summed as doubles is not 0.3; with a scale the fixed-point sum is
    fs = replace(facts(spark, [(T(2023), "1", "A", 0.1), (T(2023), "1", "A", 0.2)]), scale=2)
    assert rpt.entity_year_totals(fs, [2023]).collect()[0].total == 0.3


def test_peak_hours_tie_goes_to_earlier_hour(spark):
    fs = facts(spark, [(T(2023, h=8), "1", "A", 5.0), (T(2023, h=17), "1", "A", 5.0),
                       (T(2023, h=3), "1", "A", 1.0), (T(2023, h=4), "1", "A", 1.0)])
    r = rpt.peak_hours(fs, [2023]).collect()[0]
    assert (r.peak_hour, r.peak_avg, r.low_hour, r.low_avg) == (8, 5.0, 3, 1.0)
