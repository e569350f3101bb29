"""Entity tools: directory of (id, name) pairs, first recorded month and its
rows, extracts by id and time range, and ordered paging."""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.binding import FactSet
from cadence.session import shared_dir
from cadence.sinks.writers import materialize

MAX_PAGE_END = 100_000  # rows that one task may hold for a page


def directory(fs: FactSet) -> DataFrame:
    """Distinct (id, entity) pairs of the ids that occur in the facts.

    The distinct ids are found on the facts first (a partial aggregate per
    map task), and only they meet the names dimension."""
    if fs.inline:
        return fs.facts.select("id", "entity").distinct()
    ids = fs.facts.select("id").distinct()
    return ids.join(fs.names, "id", "left").select("id", "entity").distinct()


def month_start(ts: Column | str = "ts") -> Column:
    """First day of the month of ``ts`` as a DATE (no time-zone step)."""
    return F.trunc(F.to_date(F.col(ts) if isinstance(ts, str) else ts), "month")


def first_month(fs: FactSet) -> DataFrame:
    """First recorded month of every id: (id, year, month).

    ``min`` of the month start, an aggregate combined map-side; a hot id is
    one partial row per task, never a whole window partition."""
    firsts = (
        fs.facts.where(F.col("id").isNotNull() & F.col("ts").isNotNull())
        .groupBy("id")
        .agg(F.min(month_start()).alias("first_month"))
    )
    return firsts.select(
        "id",
        F.year("first_month").alias("year"),
        F.month("first_month").alias("month"),
        "first_month",
    )


def first_month_rows(fs: FactSet, spark: SparkSession | None = None) -> DataFrame:
    """The fact rows of every id in its first recorded month, with year and
    month. A semi-join on (id, month start): one row per id on the right.

    With ``spark`` the per-id minima are first written as a table in the
    shared folder, so the planner knows their size: when they are small the
    join is a broadcast and the facts are not shuffled at all; when they are
    large it stays a sort-merge join, with skewed partitions split by AQE.
    (Without it the size is only known at run time, after the facts have
    been shuffled for a sort-merge join.)"""
    firsts = first_month(fs).select("id", "first_month")
    if spark is not None:
        firsts = materialize(spark, firsts, shared_dir(spark, "first-months"))
    facts = fs.facts
    if spark is not None and {"year", "month"} <= set(facts.columns):
        # landed facts: only the folders of months that are someone's first are read
        months = firsts.select(F.year("first_month").alias("y"), F.month("first_month").alias("m")).distinct().collect()  # calendar months
        wanted = F.lit(False)
        for y in sorted({r["y"] for r in months}):
            wanted = wanted | ((F.col("year") == y) & F.col("month").isin(sorted(r["m"] for r in months if r["y"] == y)))
        facts = facts.where(wanted)
    facts = facts.withColumn("first_month", month_start())
    rows = facts.join(firsts, ["id", "first_month"], "left_semi")
    return rows.withColumns({"year": F.year("ts"), "month": F.month("ts")}).drop("first_month")


def distinct_months(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Distinct (year, month) pairs present."""
    return (
        df.where(F.col(ts).isNotNull())
        .select(F.year(ts).alias("year"), F.month(ts).alias("month"))
        .dropDuplicates(["year", "month"])
        .orderBy("year", "month")
    )


def range_extract(
    fs: FactSet,
    ids: Sequence,
    start: str,
    end: str,
    cols: Sequence[str] = ("key", "id", "ts", "v"),
) -> DataFrame:
    """Rows of the given ids with ``start <= ts <= end``, sorted by time
    (range-partitioned sort, so the output is ordered across files)."""
    lo = F.lit(start).cast("timestamp_ntz")
    hi = F.lit(end).cast("timestamp_ntz")
    rows = fs.named_facts() if "entity" in cols else fs.facts
    rows = rows.where(F.col("id").isin(list(ids)) & F.col("ts").between(lo, hi))
    tie = [c for c in ("key", "id") if c in rows.columns]
    return rows.orderBy("ts", *tie).select(*cols)


def page(df: DataFrame, order: Sequence[str], offset: int, limit: int) -> DataFrame:
    """One page of an ordered result: rows offset+1 .. offset+limit.

    ``order`` must be a total order (end it with a unique key). Planned as a
    top-(offset+limit) per task, so it is for shallow pages; page deep with
    ``page_after``, whose cost does not grow with the depth. Pages that end
    beyond row MAX_PAGE_END are refused: ``operators.position.page_at`` has them."""
    if offset + limit > MAX_PAGE_END:
        raise ValueError(f"page ends at row {offset + limit}, over {MAX_PAGE_END}: use page_after, or page_at of operators.position")
    return df.orderBy(*order).offset(offset).limit(limit)


def _literal_like(df: DataFrame, col: str, value) -> Column:
    """``value`` as a literal of ``col``'s type; dates and times go through
    their ISO text, so no session time zone is involved."""
    dtype = df.schema[col].dataType
    if isinstance(value, datetime.datetime):
        return F.lit(value.isoformat(sep=" ")).cast(dtype)
    if isinstance(value, datetime.date):
        return F.lit(value.isoformat()).cast(dtype)
    return F.lit(value).cast(dtype)


def page_after(df: DataFrame, order: Sequence[str], after: Sequence | None, limit: int) -> DataFrame:
    """Keyset paging: the first ``limit`` rows whose ``order`` key comes after
    ``after`` (the key of the last row of the previous page; None for the
    first page). The "after" test is a plain predicate -- (k1 > a1) OR
    (k1 = a1 AND k2 > a2) ... -- that reaches the scan, and each task keeps
    only ``limit`` rows however deep the page is."""
    order = list(order)
    if after is not None:
        cond = None
        for i, col in enumerate(order):
            term = F.col(col) > _literal_like(df, col, after[i])
            for j in range(i):
                term = term & (F.col(order[j]) == _literal_like(df, order[j], after[j]))
            cond = term if cond is None else (cond | term)
        df = df.where(cond)
    return df.orderBy(*order).limit(limit)
