"""Grouped sums, counts and averages with the reports' null rules.

Null rules kept from the reports (Spark differs by default):

* rows whose group key is NULL are not a group (``where key IS NOT NULL``);
* the sum of a group whose measures are all NULL is 0 (``total_of``);
* averages are per row: sum / count of non-null measures.

Every aggregate here is decomposable (sum, count), so Spark runs it as a
partial aggregate before the shuffle and a final one after it; a hot key is
combined map-side and never lands in one task as raw rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadence.binding import FactSet
from cadence.functions.calendar import require_calendar_keys

Keys = Mapping[str, Column]


def non_null(cols: Iterable[str]) -> Column:
    """``c1 IS NOT NULL AND c2 IS NOT NULL ...`` (one SQL predicate)."""
    cols = list(cols)
    if not cols:
        return F.lit(True)
    return F.expr(" AND ".join(f"`{c}` IS NOT NULL" for c in cols))


def measure(v: Column | str) -> Column:
    """The measure as DOUBLE with NaN read as missing (as a missing cell)."""
    col = F.col(v) if isinstance(v, str) else v
    return F.nanvl(col.cast("double"), F.lit(None).cast("double"))


def exact_sum(v: Column | str, scale: int | None) -> Column:
    """Sum whose result does not depend on row order.

    With a ``scale`` each value is a whole number of 10^-scale units (a value
    that is not fails the job: nothing is rounded away) and the units are summed as BIGINT: a primitive
    add per row inside whole-stage codegen, about twice as fast as a DECIMAL
    sum (whose buffer is a wide decimal), and exact. The per-group result is
    turned into a DECIMAL once, after the aggregate. An overflow fails the job
    (ANSI) instead of wrapping. ``scale=None`` sums plain doubles."""
    return sum_of_summands(summand(v, scale), scale)


def summand(v: Column | str, scale: int | None) -> Column:
    """What ``exact_sum`` adds up for a row: whole units, or the double."""
    col = F.col(v) if isinstance(v, str) else v
    if scale is None:
        return col.cast("double")
    scaled = col * F.lit(float(10**scale))
    # within the rounding of the double product; NULL measures stay NULL
    whole = scaled.isNull() | (F.abs(scaled - F.rint(scaled)) <= F.lit(1e-6) + F.abs(scaled) * F.lit(4e-16))
    wrong = F.raise_error(F.concat(F.lit(f"measure with more than {scale} decimals: "), col.cast("string")))
    return F.when(whole, F.rint(scaled).cast("bigint")).otherwise(wrong.cast("bigint"))


def sum_of_summands(x: Column, scale: int | None) -> Column:
    return F.sum(x) if scale is None else F.sum(x).cast("decimal(38,0)") / F.lit(10**scale)


def total_of(s: Column | str) -> Column:
    """A partial-sum column as the reports' total: DOUBLE, 0 when empty."""
    col = F.col(s) if isinstance(s, str) else s
    return F.coalesce(col.cast("double"), F.lit(0.0))


def mean_of(s: Column | str = "s", n: Column | str = "n", zero_if_empty: bool = False) -> Column:
    """Per-row mean from partial sums: total / non-null count.

    ``zero_if_empty`` gives 0 instead of NULL for a group with no measure."""
    s = F.col(s) if isinstance(s, str) else s
    n = F.col(n) if isinstance(n, str) else n
    ratio = s.cast("double") / n
    if zero_if_empty:
        return F.when(n > 0, ratio).otherwise(F.lit(0.0))
    return F.when(n > 0, ratio)


def _measures(scale: int | None) -> list[Column]:
    return [
        exact_sum("v", scale).alias("s"),
        F.count("v").alias("n"),
        F.count(F.lit(1)).alias("rows"),
    ]


def _remeasure() -> list[Column]:
    return [F.sum("s").alias("s"), F.sum("n").alias("n"), F.sum("rows").alias("rows")]


def partials(fs: FactSet, keys: Keys, *, with_id: bool = False) -> DataFrame:
    """Partial sums ``s``, non-null counts ``n`` and row counts ``rows`` per
    (keys, entity grain). Rows with a NULL key are dropped; a NULL id or name
    stays a group here so totals over all rows can be taken from it.

    Grain: ``keys + id`` with a names dimension; ``keys + entity`` (+ ``id``
    when ``with_id``) when names are inline.
    """
    key_names = list(keys)
    grain = list(key_names)
    if not fs.inline or with_id:
        grain.append("id")
    if fs.inline:
        grain.append("entity")
    cols = [c.alias(k) for k, c in keys.items()] + [F.col(g) for g in grain if g not in keys]
    cols.append(measure("v").alias("v"))
    return fs.facts.select(*cols).where(non_null(key_names)).groupBy(*grain).agg(*_measures(fs.scale))


def attach_names(part: DataFrame, names: DataFrame) -> DataFrame:
    """Left join of the names dimension to an aggregate on ``id``.

    An id without a name gets a NULL name and leaves the entity grouping, as
    a NULL station name does in the reports. The join is written null-safe so
    the optimizer does not push an ``id IS NOT NULL`` filter into the
    aggregate below it: the aggregate then stays identical to the one the
    all-rows totals are taken from, and Spark plans its shuffle once and
    reuses it (``ReusedExchange``) instead of scanning the facts twice."""
    p, n = part.alias("_p"), names.where(F.col("id").isNotNull()).alias("_n")
    joined = p.join(n, F.col("_p.id").eqNullSafe(F.col("_n.id")), "left")
    return joined.select("_p.*", F.col("_n.entity"))


def by_entity(fs: FactSet, part: DataFrame, keys: Iterable[str], *, with_id: bool = False) -> DataFrame:
    """Re-aggregate partials to (keys, [id], entity), names attached, NULL
    names dropped. With a dimension this joins ``names`` to the aggregate,
    never to the raw facts."""
    keys = list(keys)
    if not fs.inline:
        part = attach_names(part, fs.names)
    grain = keys + (["id"] if with_id else []) + ["entity"]
    nn = non_null(["entity"] + (["id"] if with_id else []))
    if fs.inline and ("id" in part.columns) == with_id:
        return part.where(nn)  # partials are already at this grain
    return part.where(nn).groupBy(*grain).agg(*_remeasure())


def by_keys(part: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Re-aggregate partials to the keys alone (every row, named or not)."""
    return part.groupBy(*list(keys)).agg(*_remeasure())


def entity_sums(fs: FactSet, keys: Keys, *, with_id: bool = False) -> DataFrame:
    """(keys, [id], entity, s, n, rows) in one call."""
    return by_entity(fs, partials(fs, keys, with_id=with_id), keys, with_id=with_id)


def key_sums(fs: FactSet, keys: Keys) -> DataFrame:
    """(keys, s, n, rows) over all rows; no entity involved, no name join."""
    key_names = list(keys)
    cols = [c.alias(k) for k, c in keys.items()] + [measure("v").alias("v")]
    return fs.facts.select(*cols).where(non_null(key_names)).groupBy(*key_names).agg(*_measures(fs.scale))


def with_default(requested: DataFrame, sums: DataFrame, on: list[str], value: str = "total") -> DataFrame:
    """Left join from a requested-keys table; absent groups get 0.

    ``requested`` is a calendar table of fixed size and ``sums`` is grouped
    by the same keys (callers filter the facts to the requested keys first).
    """
    # ``sums`` has one row per requested calendar key at most: broadcast, a bounded size
    require_calendar_keys(on)
    joined = requested.join(F.broadcast(sums), on, "left")
    return joined.withColumn(value, F.coalesce(F.col(value), F.lit(0.0)))


def two_level_mean(
    fs: FactSet, outer: Keys, inner: Keys, *, value: str = "avg_total"
) -> DataFrame:
    """Mean over inner groups of their sums: e.g. the average daily total per
    weekday = mean over dates of the per-date sum. ``inner`` must determine
    ``outer`` (a date determines its weekday)."""
    sums = key_sums(fs, {**outer, **inner})
    # The inner sums stay DECIMAL, so the mean does not depend on row order.
    daily = F.coalesce(F.col("s"), F.lit(0))
    return sums.groupBy(*list(outer)).agg(
        (total_of(F.sum(daily)) / F.count(F.lit(1))).alias(value),
        F.count(F.lit(1)).alias("groups"),
    )


def merge_partials(parts: Iterable[DataFrame], keys: Iterable[str]) -> DataFrame:
    """Union stored partial aggregates (columns keys, s, n, rows) and
    re-aggregate: the result equals one pass over all slices."""
    parts = list(parts)
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.unionByName(p)
    return by_keys(merged, keys)


def outer_add(a: DataFrame, b: DataFrame, on: list[str], value: str) -> DataFrame:
    """Full-outer add of two keyed series, a missing side counting 0.

    The zero is an integer literal, so DECIMAL partial sums stay exact."""
    left = a.select(*on, F.col(value).alias("_a"))
    right = b.select(*on, F.col(value).alias("_b"))
    return left.join(right, on, "full_outer").select(
        *on, (F.coalesce("_a", F.lit(0)) + F.coalesce("_b", F.lit(0))).alias(value)
    )
