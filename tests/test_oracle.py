"""Every named query equals its DuckDB oracle (row count, columns, values)."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from oracle_check import TABLES, digest, rows_of  # noqa: E402

from __spark_entry__ import entry  # noqa: E402
from cadence.plans.catalog import queries  # noqa: E402
from cadence.plans.oracle import oracle_sql  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


def test_every_query_has_an_oracle():
    assert set(queries()) == set(oracle_sql())


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_matches_oracle(spark, con, name):
    sdf = queries()[name](spark, SF)
    s_cols, s_rows = rows_of(sdf.columns, [tuple(r) for r in sdf.collect()])
    cur = con.execute(oracle_sql()[name])
    d_cols, d_rows = rows_of([c[0] for c in cur.description], cur.fetchall())
    assert s_cols == d_cols
    assert len(s_rows) == len(d_rows)
    assert digest(s_rows) == digest(d_rows)


def test_entry_runs(spark):
    df = entry(spark)
    assert df.columns == ["year", "entity", "total", "share"]
    assert df.count() > 0


@pytest.fixture
def no_auto_broadcast(spark):
    keys = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    before = {k: spark.conf.get(k, None) for k in keys}
    for k in keys:
        spark.conf.set(k, "-1")
    yield
    for k, v in before.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_matches_oracle_without_broadcast(spark, con, no_auto_broadcast, name):
    """As at 100 TB, where a names table is too big to broadcast: every join
    that is not of a bounded calendar-sized side runs as a sort-merge join."""
    sdf = queries()[name](spark, SF)
    s_cols, s_rows = rows_of(sdf.columns, [tuple(r) for r in sdf.collect()])
    cur = con.execute(oracle_sql()[name])
    d_cols, d_rows = rows_of([c[0] for c in cur.description], cur.fetchall())
    assert s_cols == d_cols and digest(s_rows) == digest(d_rows)
