"""Properties: shares sum to one, the season table adds up to the year
total, and merging partials of any split equals one pass."""

import math

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cadence.operators import aggregate as agg
from cadence.plans import reports as rpt
from cadence.sources.tables import events_hourly, lineitem_supplier

SF = "/root/testdata/sf0.001"


def test_shares_sum_to_one(spark):
    out = rpt.entity_shares(lineitem_supplier(spark, SF), [1996, 1997])
    for r in out.groupBy("year").agg(F.sum("share").alias("s")).collect():
        assert math.isclose(r.s, 1.0, rel_tol=1e-12)


def test_season_table_adds_up_to_year_total(spark):
    fs = lineitem_supplier(spark, SF)
    m = rpt.season_matrix(fs, [1996, 1997])
    seasons = {r.year: r.t for r in m.groupBy("year").agg(
        F.sum(F.col("Winter") + F.col("Spring") + F.col("Summer") + F.col("Fall")).alias("t")).collect()}
    totals = {r.year: r.total for r in rpt.yearly_totals(spark, fs, [1996, 1997]).collect()}
    for y in (1996, 1997):
        assert math.isclose(seasons[y], totals[y], rel_tol=1e-12)


@settings(max_examples=5, deadline=None)
@given(st.integers(min_value=2, max_value=5), st.integers(min_value=0, max_value=10_000))
def test_merge_of_any_split_equals_one_pass(spark, parts, salt):
    fs = events_hourly(spark, SF)
    keys = {"entity": F.col("entity"), "hour": F.hour("ts")}
    bucket = F.abs(F.hash(F.col("key"), F.lit(salt))) % parts
    slices = [agg.key_sums(fs.where(bucket == i), keys) for i in range(parts)]
    merged = agg.merge_partials(slices, ["entity", "hour"])
    one = agg.key_sums(fs, keys)
    a = sorted(tuple(r) for r in merged.select("entity", "hour", "s", "n", "rows").collect())
    b = sorted(tuple(r) for r in one.select("entity", "hour", "s", "n", "rows").collect())
    assert a == b
