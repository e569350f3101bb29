"""A hot key (one user holds a third of the events) gives the same results
as a plain DuckDB computation over the same derived rows."""

import duckdb
import pytest
from pyspark.sql import functions as F

from cadence.binding import FactSet
from cadence.plans import reports as rpt
from cadence.sources.tables import events_hourly

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def hot(spark):
    fs = events_hourly(spark, SF)
    facts = fs.facts.withColumn("id", F.when(F.col("key") % 3 == 0, F.lit(7)).otherwise(F.col("id")))
    return FactSet(facts)


@pytest.fixture(scope="module")
def con(hot):
    c = duckdb.connect()
    c.register("hot", hot.facts.toPandas())
    return c


def _rows(df):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())


def test_hot_key_hour_averages(spark, hot, con):
    got = _rows(rpt.hour_average_by_entity(hot))
    want = sorted(
        tuple(round(x, 9) if isinstance(x, float) else x for x in r)
        for r in con.execute(
            "SELECT id, entity, CAST(hour(ts) AS INTEGER) h, SUM(v) / COUNT(v) FROM hot GROUP BY 1, 2, 3"
        ).fetchall()
    )
    assert got == want


def test_hot_key_first_month_and_directory(spark, hot, con):
    from cadence.operators import entity as ent

    got = ent.first_month_rows(hot).count()
    want = con.execute(
        """SELECT COUNT(*) FROM hot h JOIN (SELECT id, MIN(date_trunc('month', ts)) fm FROM hot GROUP BY id) f
           ON h.id = f.id AND date_trunc('month', h.ts) = f.fm"""
    ).fetchone()[0]
    assert got == want
    assert ent.directory(hot).count() == con.execute("SELECT COUNT(*) FROM (SELECT DISTINCT id, entity FROM hot)").fetchone()[0]


def test_hot_key_series_keep_their_rows(spark, hot):
    out = rpt.monthly_series(hot, min_slots=None)
    hot_series = out.where("id = 7").groupBy("entity").count().collect()
    assert all(r["count"] == 24 for r in hot_series) and len(hot_series) == 5
