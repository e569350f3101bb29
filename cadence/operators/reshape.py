"""Pivots with explicit value lists (no extra job to discover the values)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pivot_sum(
    df: DataFrame,
    index: Iterable[str],
    column: str,
    values: Sequence,
    measure: str,
    names: Sequence[str] | None = None,
    fill: float | None = 0.0,
) -> DataFrame:
    """Wide table: one column per value of ``column`` holding ``sum(measure)``.

    Written as conditional aggregation, which is what ``pivot`` plans to, but
    keeps the exact DECIMAL sum per cell; absent cells get ``fill``."""
    return df.groupBy(*list(index)).agg(*pivot_sum_cells(column, values, measure, names, fill))


def pivot_sum_cells(
    column: str,
    values: Sequence,
    measure: str,
    names: Sequence[str] | None = None,
    fill: float | None = 0.0,
) -> list[Column]:
    """The cells of ``pivot_sum`` as aggregate columns, to combine with other
    aggregates of the same ``groupBy``."""
    names = list(names) if names is not None else [str(v) for v in values]
    cells = []
    for val, name in zip(values, names):
        cell = F.sum(F.when(F.col(column) == F.lit(val), F.col(measure))).cast("double")
        if fill is not None:
            cell = F.coalesce(cell, F.lit(fill))
        cells.append(cell.alias(name))
    return cells


def pivot_one(
    df: DataFrame,
    index: Iterable[str],
    column: str,
    values: Sequence,
    measure: str,
    names: Sequence[str] | None = None,
) -> DataFrame:
    """Wide table of a long table with at most one row per (index, column):
    ``groupBy(index).pivot(column, values)`` with the explicit value list, so
    no extra job is run to discover the values. Absent cells are NULL."""
    names = list(names) if names is not None else [str(v) for v in values]
    wide = df.groupBy(*list(index)).pivot(column, list(values)).agg(F.max(measure))
    return wide.select(*list(index), *[F.col(str(v)).alias(n) for v, n in zip(values, names)])


def row_max(cols: Sequence[str]) -> Column:
    """Largest value across columns of one row."""
    return F.greatest(*[F.col(c) for c in cols])
