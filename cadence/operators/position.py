"""Positions of rows in an order over the whole table, without a single task.

A range shuffle sorts the rows over the cluster and they are written once, each
with its partition and its place in it. The sizes of the partitions, one row
each, are added up and joined back: the sum before a row's partition plus its
place is its position. Pages of any depth and ranks of any length are then plain
filters and differences.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadence.session import shared_dir
from cadence.sinks.writers import materialize

_LOCAL = (1 << 33) - 1  # the part of monotonically_increasing_id that counts within a partition


def _sort_columns(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def with_position(df: DataFrame, order: Sequence[str | Column], name: str = "position") -> DataFrame:
    """``df`` with the 1-based position of every row in the order of ``order``
    (columns, ascending, or sort expressions).

    The sorted rows are written to the shared folder, so positions outlive a lost
    executor. Rows equal in all of ``order`` take positions next to each other in
    any order. Columns whose names begin with ``_pos_`` are refused."""
    if any(c.startswith("_pos_") for c in df.columns):
        raise ValueError("column names that begin with _pos_ are taken")
    by = _sort_columns(order)
    rows = df.repartitionByRange(*by).sortWithinPartitions(*by)
    rows = rows.withColumn("_pos_part", F.spark_partition_id()).withColumn("_pos_at", F.monotonically_increasing_id().bitwiseAND(F.lit(_LOCAL)))
    spark = df.sparkSession
    rows = materialize(spark, rows, shared_dir(spark, "positions"))
    # one row per shuffle partition comes to the driver, and is broadcast
    sizes = sorted(tuple(r) for r in rows.groupBy("_pos_part").agg(F.count(F.lit(1))).collect())
    before = accumulate((n for _, n in sizes), initial=0)
    starts = spark.createDataFrame([(part, start) for (part, _), start in zip(sizes, before, strict=False)], "_pos_part int, _pos_start long")
    placed = rows.join(F.broadcast(starts), "_pos_part")
    return placed.withColumn(name, F.col("_pos_start") + F.col("_pos_at") + 1).drop("_pos_part", "_pos_at", "_pos_start")


def page_at(df: DataFrame, order: Sequence[str | Column], offset: int, limit: int, name: str = "position") -> DataFrame:
    """Rows offset+1 .. offset+limit of an order, however deep, with their position."""
    placed = with_position(df, order, name)
    return placed.where(F.col(name).between(offset + 1, offset + limit))


def rank_every(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], name: str = "rank") -> DataFrame:
    """``df`` with the row number of every row in its group (1-based), for groups of
    any size: a group may be most of the table, as its rows are sorted over the
    whole cluster and only its first position is looked up."""
    placed = with_position(df, [*by, *_sort_columns(order)], "_rank_at")
    first = placed.groupBy(*by).agg(F.min("_rank_at").alias("_rank_first"))
    left, right = placed.alias("_l"), first.alias("_r")
    same = F.lit(True)
    for c in by:
        same = same & F.col(f"_l.{c}").eqNullSafe(F.col(f"_r.{c}"))
    joined = left.join(right, same)
    return joined.select(*[F.col(f"_l.{c}") for c in df.columns], (F.col("_l._rank_at") - F.col("_r._rank_first") + 1).cast("int").alias(name))
