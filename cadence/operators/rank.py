"""Shares of a total, ranks, top-n lists and year-to-year comparisons.

Ranks are taken per group with ``row_number() <= n``; Spark turns that filter
into a partial ``WindowGroupLimit`` before the shuffle, so each map task sends
at most n rows per group and no task ever sorts a whole year of entities.
Ties are broken on the entity name (ascending), which makes the order total.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadence.functions.calendar import require_calendar_keys


def share_of_total(
    per_entity: DataFrame,
    group_totals: DataFrame,
    on: list[str],
    value: str = "total",
    group_value: str = "group_total",
    out: str = "share",
) -> DataFrame:
    """``value / group_value`` per row, 0 when the group total is not positive.

    ``group_totals`` holds one row per group (e.g. per requested year); its
    size is bounded by the number of groups asked for, so it is broadcast.
    Only calendar keys are taken: other groups may be as many as the rows.
    """
    require_calendar_keys(on)
    joined = per_entity.join(F.broadcast(group_totals), on, "inner")
    ratio = F.when(F.col(group_value) > 0, F.col(value) / F.col(group_value)).otherwise(F.lit(0.0))
    return joined.withColumn(out, ratio)


def rank_within(
    df: DataFrame,
    by: Iterable[str],
    order: str = "total",
    tie: str = "entity",
    n: int = 10,
    out: str = "rank",
) -> DataFrame:
    """Row number per group, largest ``order`` first, ties by ``tie`` ascending.

    Only ranks ``<= n`` are kept (the top-n list). Spark limits each task's rows
    before the shuffle up to ``spark.sql.optimizer.windowGroupLimitThreshold``;
    a larger ``n`` is refused, since it would send a whole group to one task
    (``operators.position.rank_every`` ranks groups of any size)."""
    most = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if n > most:
        raise ValueError(f"n = {n} is over spark.sql.optimizer.windowGroupLimitThreshold = {most}")
    w = Window.partitionBy(*list(by)).orderBy(F.col(order).desc(), F.col(tie).asc())
    ranked = df.withColumn(out, F.row_number().over(w))
    return ranked.where(F.col(out) <= n)


def top_n(df: DataFrame, n: int, order: str = "total", tie: str = "entity") -> DataFrame:
    """Global top-n (``TakeOrderedAndProject``: a bounded heap per task)."""
    return df.orderBy(F.col(order).desc(), F.col(tie).asc()).limit(n)


def rank_aligned(
    top: DataFrame,
    side: str,
    a,
    b,
    cols: Iterable[str] = ("entity", "total"),
    rank: str = "rank",
) -> DataFrame:
    """Pair two ranked lists position by position (rank 1 with rank 1 ...).

    ``top`` holds both lists, told apart by ``side`` = a or b; each side keeps
    its own names, as the reports' bar charts pair them. One conditional
    aggregate by rank (each (side, rank) has one row), no self-join."""
    cells = [
        F.max(F.when(F.col(side) == val, F.col(c))).alias(f"{c}_{tag}")
        for tag, val in (("a", a), ("b", b))
        for c in cols
    ]
    return top.groupBy(rank).agg(*cells)


def entity_aligned(
    long: DataFrame,
    side: str,
    a,
    b,
    n: int,
    s: str = "s",
    on: str = "entity",
) -> DataFrame:
    """The top-n entities of side ``a`` with their totals on both sides.

    ``long`` holds partial sums per (side, entity). One conditional aggregate
    per entity gives both totals (0 where a side has no rows), then a global
    top-n (a bounded heap per task) keeps the entities that have rows on side
    ``a`` -- no join between the two sides."""
    wide = long.groupBy(on).agg(
        F.max(F.when(F.col(side) == a, F.lit(True))).alias("_in_a"),
        F.coalesce(F.sum(F.when(F.col(side) == a, F.col(s))).cast("double"), F.lit(0.0)).alias("total_a"),
        F.coalesce(F.sum(F.when(F.col(side) == b, F.col(s))).cast("double"), F.lit(0.0)).alias("total_b"),
    )
    top = top_n(wide.where(F.col("_in_a")), n, order="total_a", tie=on)
    return top.select(on, "total_a", "total_b")
