"""24-slot series per entity: coverage filter, hour spine, linear gap fill,
series mean.

A series is one row with an array of its slots, made by one aggregate of
conditional sums and counts (``slot_sums``, combined map-side and written from
the facts: one exchange) or of conditional values where per-slot rows exist
already. Everything after it works inside the row with higher-order functions:
no window, no sort, no list of unknown length.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadence.functions.calendar import hour_label
from cadence.operators.aggregate import mean_of, sum_of_summands, summand

SLOTS = 24
MIN_SLOTS = 12  # at least half of the hours must hold a value


def first_seen_name(ts: str = "ts", name: str = "entity") -> Column:
    """The name on the earliest row of a group (ties: smallest name).

    An ordinary aggregate (min of a struct), so it is combined map-side."""
    return F.min(F.struct(F.col(ts), F.col(name)))[name]


def slot_values(
    per_slot: DataFrame, keys: Iterable[str], slot: str = "hour", value: str = "v", slots: int = SLOTS, carry: dict[str, Column] | None = None
) -> DataFrame:
    """(keys, carried, ``values``): rows of (keys, slot, value), at most one for
    each slot, as an array over the slots."""
    cells = [F.max(F.when(F.col(slot) == h, F.col(value))).alias(f"_v{h}") for h in range(slots)]
    carry = carry or {}
    wide = per_slot.groupBy(*keys).agg(*cells, *[c.alias(n) for n, c in carry.items()])
    return wide.select(*keys, *carry, F.array(*[f"_v{h}" for h in range(slots)]).alias("values"))


def slot_means(
    rows: DataFrame, keys: Iterable[str], slot: str = "hour", value: str = "v", slots: int = SLOTS, scale: int | None = None, carry: dict[str, Column] | None = None
) -> DataFrame:
    """(keys, carried, ``values``): the mean of ``value`` in every slot straight from
    the facts, as an array over the slots (NULL where a slot has no value).

    One aggregate holds a sum and a count for each slot, so a series is one row
    from the first shuffle on, however many facts it has."""
    carry = carry or {}
    rows = rows.withColumn("_u", summand(value, scale))
    of_slot = [F.when(F.col(slot) == h, F.col("_u")) for h in range(slots)]
    sums = [sum_of_summands(x, scale).alias(f"_s{h}") for h, x in enumerate(of_slot)]
    counts = [F.count(x).alias(f"_n{h}") for h, x in enumerate(of_slot)]
    wide = rows.groupBy(*keys).agg(*sums, *counts, *[c.alias(n) for n, c in carry.items()])
    return wide.select(*keys, *carry, F.array(*[mean_of(f"_s{h}", f"_n{h}") for h in range(slots)]).alias("values"))


def spine(
    per_slot: DataFrame,
    keys: Iterable[str],
    slot: str = "hour",
    value: str = "v",
    slots: int = SLOTS,
    min_slots: int | None = MIN_SLOTS,
    carry: dict[str, Column] | None = None,
) -> DataFrame:
    """Every series of ``per_slot`` on the full slot axis 0 .. slots-1: keys,
    carried columns, ``n_slots`` (non-null values the series had), slot, ``value``
    (NULL where the slot had none). Series with fewer than ``min_slots`` values
    are dropped when it is set."""
    kept = _covered(slot_values(per_slot, list(keys), slot, value, slots, carry), min_slots)
    return kept.select(*keys, *(carry or {}), "n_slots", F.posexplode("values").alias(slot, value))


def _covered(arrays: DataFrame, min_slots: int | None) -> DataFrame:
    """The series with enough values, with their number ``n_slots``."""
    counted = arrays.withColumn("n_slots", F.size(F.filter("values", lambda x: x.isNotNull())).cast("long"))
    return counted if min_slots is None else counted.where(F.col("n_slots") >= min_slots)


def gap_fill(
    df: DataFrame,
    keys: Iterable[str],
    slot: str = "hour",
    value: str = "v",
    out: str = "filled",
) -> DataFrame:
    """Linear fill of the gaps of series in rows, for any number of slots (the
    reports' 24 slots are filled inside one row, see ``fill_slots``).

    * a value is kept;
    * a leading gap (no earlier value) stays NULL;
    * a trailing gap (no later value) takes the last value;
    * an inner gap is interpolated: pv + (nv - pv) * (h - ph) / (nh - ph).
    """
    keys = list(keys)
    base = Window.partitionBy(*keys).orderBy(slot)
    upto = base.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    from_ = base.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    v = F.col(value)
    h = F.col(slot)
    seen_slot = F.when(v.isNotNull(), h)
    pv = F.last(v, ignorenulls=True).over(upto)
    ph = F.last(seen_slot, ignorenulls=True).over(upto)
    nv = F.first(v, ignorenulls=True).over(from_)
    nh = F.first(seen_slot, ignorenulls=True).over(from_)
    filled = (
        F.when(v.isNotNull(), v)
        .when(pv.isNull(), F.lit(None).cast("double"))
        .when(nv.isNull(), pv)
        .otherwise(pv + (nv - pv) * (h - ph) / (nh - ph))
    )
    return df.withColumn(out, filled)


def fill_slots(values: Column) -> Column:
    """Linear fill of the gaps of an array of slots.

    * a value is kept;
    * a leading gap (no earlier value) stays NULL;
    * a trailing gap (no later value) takes the last value;
    * an inner gap is interpolated: pv + (nv - pv) * (h - ph) / (nh - ph).
    """
    places = F.sequence(F.lit(0), F.size(values) - 1)
    seen = F.filter(places, lambda h: F.get(values, h).isNotNull())

    def at(h: Column) -> Column:
        ph, nh = F.array_max(F.filter(seen, lambda x: x <= h)), F.array_min(F.filter(seen, lambda x: x >= h))
        pv, nv = F.get(values, ph), F.get(values, nh)
        inner = pv + (nv - pv) * (h - ph) / (nh - ph)
        return F.when(ph == h, pv).when(ph.isNull(), F.lit(None).cast("double")).when(nh.isNull(), pv).otherwise(inner)

    return F.transform(places, at)


def mean_in_order(values: Column) -> Column:
    """Mean of the values of an array (NULLs skipped; NULL if there are none),
    added in the order of the array: one result on any cluster layout, and no
    digit is cut."""
    known = F.filter(values, lambda x: x.isNotNull())
    total = F.aggregate(known, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(known) > 0, total / F.size(known))


def series_rows(
    arrays: DataFrame,
    keys: Iterable[str],
    *,
    min_slots: int | None = MIN_SLOTS,
    slot: str = "hour",
    value: str = "v",
    carry: Iterable[str] = (),
) -> DataFrame:
    """Series as arrays (``values``) -> one row per slot: coverage filter (series
    with fewer than ``min_slots`` values go), gap fill, mean and 12-hour label."""
    kept = _covered(arrays, min_slots).withColumn("_filled", fill_slots(F.col("values"))).withColumn("mean", mean_in_order(F.col("_filled")))
    places = F.sequence(F.lit(0), F.size("values") - 1)
    cells = F.arrays_zip(places.alias("h"), F.col("values").alias("v"), F.col("_filled").alias("f"))
    rows = kept.select(*keys, *carry, "n_slots", "mean", F.explode(cells).alias("_cell"))
    rows = rows.select(*keys, *carry, "n_slots", F.col("_cell.h").alias(slot), F.col("_cell.v").alias(value), F.col("_cell.f").alias("filled"), "mean")
    return rows.withColumn("label", hour_label(slot))


def filled_series(
    per_slot: DataFrame,
    keys: Iterable[str],
    *,
    min_slots: int | None = MIN_SLOTS,
    slot: str = "hour",
    value: str = "v",
    carry: dict[str, Column] | None = None,
) -> DataFrame:
    """``series_rows`` of rows of (keys, slot, value)."""
    keys = list(keys)
    arrays = slot_values(per_slot, keys, slot=slot, value=value, carry=carry)
    return series_rows(arrays, keys, min_slots=min_slots, slot=slot, value=value, carry=list(carry or {}))
