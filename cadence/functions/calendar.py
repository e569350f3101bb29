"""Calendar columns, year predicates that reach the Parquet scan, and the
small calendar dimensions (hours, weekdays, seasons) used as join spines.

All are built-in Column expressions: they stay inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (they must equal the reports' own labels)
#   seasons by month: 12, 1, 2 Winter; 3, 4, 5 Spring; 6, 7, 8 Summer;
#                     9, 10, 11 Fall
#   season order:     Winter, Spring, Summer, Fall
#   weekday order:    Monday, Tuesday, Wednesday, Thursday, Friday, Saturday,
#                     Sunday
#   12-hour label:    "12 AM", "1 AM", ... "11 AM", "12 PM", "1 PM", ... "11 PM"
# ---------------------------------------------------------------------------
SEASONS = ["Winter", "Spring", "Summer", "Fall"]
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def ts_literal(year: int, month: int = 1, day: int = 1) -> Column:
    """A TIMESTAMP_NTZ literal; comparing an NTZ column to it needs no cast,
    so the predicate is pushed into the Parquet scan."""
    return F.expr(f"TIMESTAMP_NTZ'{year:04d}-{month:02d}-{day:02d} 00:00:00'")


def in_year(ts: Column | str, year: int) -> Column:
    """``year(ts) = year`` written as a half-open range.

    ``year(ts) = y`` only reaches Parquet as ``IsNotNull(ts)``; the range
    lands in ``PushedFilters`` and prunes row groups by their statistics.
    """
    ts = _c(ts)
    return (ts >= ts_literal(year)) & (ts < ts_literal(year + 1))


def in_years(ts: Column | str, years: Iterable[int]) -> Column:
    """Year in a list, as an OR of ranges (adjacent years are merged)."""
    ys = sorted(set(int(y) for y in years))
    if not ys:
        return F.lit(False)
    spans: list[list[int]] = [[ys[0], ys[0]]]
    for y in ys[1:]:
        if y == spans[-1][1] + 1:
            spans[-1][1] = y
        else:
            spans.append([y, y])
    ts = _c(ts)
    cond = None
    for lo, hi in spans:
        part = (ts >= ts_literal(lo)) & (ts < ts_literal(hi + 1))
        cond = part if cond is None else (cond | part)
    return cond


def in_month(ts: Column | str, year: int, month: int) -> Column:
    """``year(ts) = year AND month(ts) = month`` as a pushed-down range."""
    ts = _c(ts)
    ny, nm = (year + 1, 1) if month == 12 else (year, month + 1)
    return (ts >= ts_literal(year, month)) & (ts < ts_literal(ny, nm))


def season_of(month: Column | str) -> Column:
    """Season name of a month number (December is winter of its own year)."""
    m = _c(month)
    return (
        F.when(m.isin(12, 1, 2), F.lit(SEASONS[0]))
        .when(m.isin(3, 4, 5), F.lit(SEASONS[1]))
        .when(m.isin(6, 7, 8), F.lit(SEASONS[2]))
        .when(m.isin(9, 10, 11), F.lit(SEASONS[3]))
    )


def hour_label(hour: Column | str) -> Column:
    """12-hour label of an hour number 0-23: ``12 AM`` ... ``11 PM``."""
    h = _c(hour)
    twelve = F.when(h % 12 == 0, F.lit(12)).otherwise(h % 12)
    return F.concat(twelve.cast("string"), F.when(h < 12, F.lit(" AM")).otherwise(F.lit(" PM")))


def weekday_slot(ts: Column | str) -> Column:
    """Weekday number, Monday = 0 ... Sunday = 6."""
    return F.weekday(_c(ts))


def day_name(ts: Column | str) -> Column:
    """Weekday name in English (``Monday`` ...)."""
    return F.date_format(_c(ts), "EEEE")


def slot_from_one(hour: Column | str) -> Column:
    """Position of an hour on the axis 1, 2, ... 23, 0 (the day starting at 1 AM)."""
    return (_c(hour) + 23) % 24


def with_calendar(df: DataFrame, ts: str = "ts", *, include: Iterable[str] | None = None) -> DataFrame:
    """Add calendar columns derived from ``ts`` in one projection.

    Available: year, month, hour, date, dow (Monday = 0), day, season, label.
    """
    t = F.col(ts)
    exprs = {
        "year": F.year(t),
        "month": F.month(t),
        "hour": F.hour(t),
        "date": F.to_date(t),
        "dow": weekday_slot(t),
        "day": day_name(t),
        "season": season_of(F.month(t)),
        "label": hour_label(F.hour(t)),
    }
    wanted = list(include) if include is not None else list(exprs)
    return df.withColumns({k: exprs[k] for k in wanted})


# ---------------------------------------------------------------------------
# Calendar dimensions: a handful of rows each, generated on the executors from
# spark.range (no driver-side data). Their size is fixed, so broadcasting them
# is always safe.
# ---------------------------------------------------------------------------
def hours_table(spark: SparkSession) -> DataFrame:
    """24 rows: hour 0-23, label, slot on the 1 ... 23, 0 axis."""
    h = F.col("id").cast("int")
    return (
        spark.range(24)
        .select(h.alias("hour"))
        .withColumns({"label": hour_label("hour"), "slot": slot_from_one("hour")})
    )


def weekdays_table(spark: SparkSession) -> DataFrame:
    """7 rows: slot 0-6 (Monday first) and the day name."""
    names = F.array(*[F.lit(d) for d in WEEKDAYS])
    return spark.range(7).select(
        F.col("id").cast("int").alias("slot"),
        F.element_at(names, F.col("id").cast("int") + 1).alias("day"),
    )


def seasons_table(spark: SparkSession) -> DataFrame:
    """4 rows: slot 0-3 and the season name (Winter first)."""
    names = F.array(*[F.lit(s) for s in SEASONS])
    return spark.range(4).select(
        F.col("id").cast("int").alias("slot"),
        F.element_at(names, F.col("id").cast("int") + 1).alias("season"),
    )


def years_table(spark: SparkSession, years: Iterable[int]) -> DataFrame:
    """The requested years as a one-column table (for defaults of absent years)."""
    ys = sorted(set(int(y) for y in years))
    arr = F.array(*[F.lit(y) for y in ys])
    return spark.range(1).select(F.explode(arr).alias("year"))


#: Keys whose distinct values a calendar bounds.
CALENDAR_KEYS = frozenset({"year", "month", "date", "season", "slot", "hour", "day"})


def require_calendar_keys(keys) -> None:
    """Stop with ``ValueError`` if a key of a table to broadcast is no calendar key."""
    others = [k for k in keys if k not in CALENDAR_KEYS]
    if others:
        raise ValueError(f"not calendar keys: {others}; a table by them has no size bound to broadcast it")
