"""Operator paths with a names dimension that the named queries do not use."""

import duckdb
import pytest

from cadence.plans import reports as rpt
from cadence.sources.tables import orders_customer

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("orders", "customer"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_hour_sum_for_names_in_a_dimension(spark, con):
    names = [r[0] for r in con.execute("SELECT c_name FROM customer ORDER BY c_custkey LIMIT 7").fetchall()]
    got = {r.hour: r.total for r in rpt.hour_sum_for(orders_customer(spark, SF), names).collect()}
    staged = {r.hour: r.total for r in rpt.hour_sum_for(orders_customer(spark, SF), names, spark).collect()}
    assert staged == got
    quoted = ", ".join(f"'{n}'" for n in names)
    want = dict(con.execute(
        f"""SELECT CAST(hour(o_orderdate) AS INTEGER), CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE)
            FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_name IN ({quoted}) GROUP BY 1"""
    ).fetchall())
    assert got == want


def test_first_seen_needs_inline_names(spark):
    with pytest.raises(ValueError, match="names on the fact rows"):
        rpt.monthly_series(orders_customer(spark, SF), name_rule="first_seen")


def test_top_entity_aligned_with_dimension(spark, con):
    got = [(r.entity, r.total_a, r.total_b) for r in rpt.top_entity_aligned(orders_customer(spark, SF), 1996, 1997, 5).collect()]
    want = con.execute(
        """WITH t AS (SELECT CAST(year(o_orderdate) AS INTEGER) y, c_name e,
                             CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) s
                      FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
           SELECT a.e, a.s, COALESCE(b.s, 0.0) FROM t a LEFT JOIN t b ON a.e = b.e AND b.y = 1997
           WHERE a.y = 1996 ORDER BY a.s DESC, a.e LIMIT 5"""
    ).fetchall()
    assert sorted(got) == sorted(want)
