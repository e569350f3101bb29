"""Bindings of the driver's Parquet tables to the fact model.

| name | facts                     | ts          | id / entity            | v            |
| ---- | ------------------------- | ----------- | ---------------------- | ------------ |
| Y    | lineitem, names supplier  | l_shipdate  | l_suppkey / s_name     | l_quantity   |
| O    | orders, names customer    | o_orderdate | o_custkey / c_name     | o_totalprice |
| H    | events (names inline)     | ts          | user_id / event_type   | value        |
| H2   | H, even users a year back | ts shifted  | as H                   | value        |
| D    | H as dirty text cells     | text stamp  | as H                   | text         |

Only the columns a binding names are selected, so every scan is pruned to
them; names live in their own dimension and are joined after aggregation.
Renames are ``selectExpr`` strings: one call to the JVM per projection
instead of several per column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.binding import FactSet
from cadence.functions.clean import stamp_text, to_number, to_stamp_guess

# ---------------------------------------------------------------------------
# Fixed values of the dirty-text binding D (every row is kept; these rules only
# decide which cells are written as bad text):
#   event_id divisible by 97 -> the stamp cell reads "not a time"
#   event_id divisible by 89 -> the measure cell is empty
# ---------------------------------------------------------------------------
BAD_STAMP_EVERY = 97
EMPTY_VALUE_EVERY = 89
BAD_STAMP_TEXT = "not a time"


# The columns the bindings use, with their types. Reading with an explicit
# schema skips Spark's schema-inference job over the file footers (one per
# read) and keeps the scans to these columns.
TABLE_SCHEMAS = {
    "lineitem": "l_orderkey BIGINT, l_suppkey BIGINT, l_quantity DOUBLE, l_shipdate TIMESTAMP_NTZ",
    "supplier": "s_suppkey BIGINT, s_name STRING",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_totalprice DOUBLE, o_orderdate TIMESTAMP_NTZ",
    "customer": "c_custkey BIGINT, c_name STRING",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE",
    "pages": "page_id BIGINT, url STRING",
    "part": "p_partkey BIGINT, p_type STRING",
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables; known tables are read with their schema."""
    reader = spark.read
    if name in TABLE_SCHEMAS:
        reader = reader.schema(TABLE_SCHEMAS[name])
    return reader.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def lineitem_supplier(spark: SparkSession, sf_dir: str) -> FactSet:
    """Binding Y: shipped quantity per supplier over ship dates."""
    li = read_table(spark, sf_dir, "lineitem")
    facts = li.selectExpr("l_orderkey AS key", "l_shipdate AS ts", "l_suppkey AS id", "l_quantity AS v")
    names = read_table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS id", "s_name AS entity")
    return FactSet(facts, names, scale=2)


def orders_customer(spark: SparkSession, sf_dir: str) -> FactSet:
    """Binding O: order value per customer over order dates."""
    o = read_table(spark, sf_dir, "orders")
    facts = o.selectExpr("o_orderkey AS key", "o_orderdate AS ts", "o_custkey AS id", "o_totalprice AS v")
    names = read_table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "c_name AS entity")
    return FactSet(facts, names, scale=2)


def events_hourly(spark: SparkSession, sf_dir: str) -> FactSet:
    """Binding H: event value per (user, event type) with hours."""
    e = read_table(spark, sf_dir, "events")
    facts = e.selectExpr("event_id AS key", "ts", "user_id AS id", "event_type AS entity", "value AS v")
    return FactSet(facts, scale=2)


def events_two_years(spark: SparkSession, sf_dir: str) -> FactSet:
    """Binding H2: H with even users moved back one year (two years with
    hours). Every row is kept."""
    h = events_hourly(spark, sf_dir)
    shifted = F.when(F.col("id") % 2 == 0, F.col("ts") - F.expr("INTERVAL 1 YEAR")).otherwise(F.col("ts"))
    return h.with_facts(h.facts.withColumn("ts", shifted))


def events_dirty_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binding D, raw: events written as export text cells.

    Columns: key, id, entity, ts_text (``MM/dd/yyyy hh:mm:ss AM``), v_text."""
    e = read_table(spark, sf_dir, "events")
    ts_text = F.when(F.col("event_id") % BAD_STAMP_EVERY == 0, F.lit(BAD_STAMP_TEXT)).otherwise(
        stamp_text(F.date_trunc("second", F.col("ts")))
    )
    v_text = F.when(F.col("event_id") % EMPTY_VALUE_EVERY == 0, F.lit("")).otherwise(
        F.col("value").cast("string")
    )
    return e.select(
        F.col("event_id").alias("key"),
        F.col("user_id").alias("id"),
        F.col("event_type").alias("entity"),
        ts_text.alias("ts_text"),
        v_text.alias("v_text"),
    )


def events_dirty(spark: SparkSession, sf_dir: str) -> FactSet:
    """Binding D, parsed leniently (bad cells are NULL, rows kept)."""
    raw = events_dirty_text(spark, sf_dir)
    facts = raw.select(
        "key",
        "id",
        "entity",
        to_stamp_guess("ts_text").alias("ts"),
        to_number("v_text").alias("v"),
    )
    return FactSet(facts, scale=2)
