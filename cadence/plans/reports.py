"""The report tables, composed from the operators. Each takes a FactSet and
parameters and returns a lazy DataFrame; nothing is collected.

| report                         | columns                                            |
| ------------------------------ | -------------------------------------------------- |
| yearly_totals                  | year, total                                        |
| entity_year_totals             | year, entity, total                                |
| entity_shares                  | year, entity, total, share (or pct 0-100)          |
| top_by_year                    | year, rank, entity, total                          |
| top_rank_aligned               | rank, entity_a, total_a, entity_b, total_b         |
| top_entity_aligned             | entity, total_a, total_b                           |
| season_matrix                  | year, entity, Winter, Spring, Summer, Fall         |
| season_compare                 | slot, season, y<a>, y<b>                           |
| season_top                     | year, rank, entity, seasons, total, peak           |
| weekday_average                | year, slot, day, avg_total                         |
| hour_average_by_entity_year    | year, [id], entity, hour, avg                      |
| hour_average_by_entity         | id, entity, hour, avg                              |
| hour_profile                   | slot, hour, avg_per_row                            |
| hour_sum_for                   | hour, total                                        |
| network_hour_curve             | hour, label, y<a>, y<b>                            |
| stored_profile                 | id, entity, clean_name, hour, label, avg           |
| peak_hours                     | year, id, entity, peak_hour, peak_avg, low_hour,   |
|                                | low_avg                                            |
| monthly_series                 | year, month, id, entity, hour, label, v, filled,   |
|                                | mean, n_slots (per id with ``first_seen`` names)   |
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.binding import FactSet
from cadence.functions.calendar import (
    SEASONS,
    WEEKDAYS,
    hour_label,
    hours_table,
    season_of,
    seasons_table,
    weekday_slot,
    years_table,
)
from cadence.operators.aggregate import (
    by_entity,
    by_keys,
    entity_sums,
    key_sums,
    mean_of,
    measure,
    non_null,
    partials,
    total_of,
    two_level_mean,
    with_default,
)
from cadence.operators.rank import entity_aligned, rank_aligned, rank_within, share_of_total
from cadence.functions.text import ratio_to_pct, sanitize_name
from cadence.operators.reshape import pivot_one, pivot_sum, pivot_sum_cells, row_max
from cadence.operators.series import filled_series, series_rows, slot_means
from cadence.session import shared_dir
from cadence.sinks.writers import materialize as write_and_read
from cadence.sources.files import read_profile


def _year_key() -> dict:
    return {"year": F.year("ts")}


def _years(fs: FactSet, years: Sequence[int] | None) -> FactSet:
    return fs.for_years(years) if years else fs


# --------------------------------------------------------------------------- totals
def yearly_totals(spark: SparkSession, fs: FactSet, years: Sequence[int] | None = None) -> DataFrame:
    """Sum per year; with ``years`` every requested year is present (0 when
    it has no rows)."""
    f = _years(fs, years)
    sums = key_sums(f, _year_key()).select("year", total_of("s").alias("total"))
    if not years:
        return sums
    return with_default(years_table(spark, years), sums, ["year"])


def entity_year_totals(fs: FactSet, years: Sequence[int] | None = None) -> DataFrame:
    f = _years(fs, years)
    return entity_sums(f, _year_key()).select("year", "entity", total_of("s").alias("total"))


def shares_from(fs: FactSet, part: DataFrame, pct: bool = False) -> DataFrame:
    """Entity totals and shares of the year total from yearly partials."""
    ent = by_entity(fs, part, ["year"]).select("year", "entity", total_of("s").alias("total"))
    year_totals = by_keys(part, ["year"]).select("year", total_of("s").alias("group_total"))
    out = share_of_total(ent, year_totals, ["year"], out="share")
    if pct:
        return out.select("year", "entity", "total", ratio_to_pct("share").alias("pct"))
    return out.select("year", "entity", "total", "share")


def entity_shares(fs: FactSet, years: Sequence[int] | None = None, pct: bool = False) -> DataFrame:
    """Entity totals and their share of the year total. The year total
    counts every row of the year, unnamed entities included; both come from
    the same partial aggregate (the shuffle is planned once and reused)."""
    f = _years(fs, years)
    return shares_from(f, partials(f, _year_key()), pct=pct)


def top_by_year(fs: FactSet, years: Sequence[int], n: int = 15) -> DataFrame:
    return top_from(entity_year_totals(fs, years), n)


def top_from(totals: DataFrame, n: int) -> DataFrame:
    """Top-n per year of a (year, entity, total) table."""
    return rank_within(totals, ["year"], n=n).select("year", "rank", "entity", "total")


def top_rank_aligned(fs: FactSet, year_a: int, year_b: int, n: int = 10) -> DataFrame:
    """Two years' top-n lists side by side by position (each keeps its own
    entity names), as the reports' bar charts pair them."""
    top = top_by_year(fs, [year_a, year_b], n)
    return rank_aligned(top, "year", year_a, year_b).select(
        "rank", "entity_a", "total_a", "entity_b", "total_b"
    )


def top_entity_aligned(fs: FactSet, year_a: int, year_b: int, n: int = 10) -> DataFrame:
    """The first year's top-n entities with their totals in both years."""
    f = _years(fs, [year_a, year_b])
    return entity_aligned(entity_sums(f, _year_key()), "year", year_a, year_b, n)


# --------------------------------------------------------------------------- seasons
def season_sums(fs: FactSet, years: Sequence[int]) -> DataFrame:
    """Partial sums per (year, season, entity): the one aggregate the season
    tables are all derived from."""
    f = _years(fs, years)
    return entity_sums(f, {"year": F.year("ts"), "season": season_of(F.month("ts"))})


def _season_cells(s: str = "s") -> list:
    return pivot_sum_cells("season", SEASONS, s)


def season_matrix_from(sums: DataFrame) -> DataFrame:
    """Entity x season (PIV-1); absent cells are 0."""
    return pivot_sum(sums, ["year", "entity"], "season", SEASONS, "s").select("year", "entity", *SEASONS)


def season_compare_from(spark: SparkSession, sums: DataFrame, years: Sequence[int]) -> DataFrame:
    """Season x year (PIV-3) on the four-season axis."""
    per_season = pivot_sum(sums, ["season"], "year", list(years), "s", names=[f"y{y}" for y in years])
    # one row per season (at most 4): broadcast, a bounded size
    out = seasons_table(spark).join(F.broadcast(per_season), "season", "left")
    return out.select(
        "slot", "season", *[F.coalesce(F.col(f"y{y}"), F.lit(0.0)).alias(f"y{y}") for y in years]
    )


def season_top_from(sums: DataFrame, n: int = 5) -> DataFrame:
    wide = sums.groupBy("year", "entity").agg(*_season_cells(), total_of(F.sum("s")).alias("total"))
    top = rank_within(wide, ["year"], n=n)
    # the peak cell over all years' top tables: a scalar subquery (a global
    # max, partial per task then final), its one value set into every row
    peak = top.select(F.max(row_max(SEASONS))).scalar()
    return top.withColumn("peak", peak).select("year", "rank", "entity", *SEASONS, "total", "peak")


def season_matrix(fs: FactSet, years: Sequence[int]) -> DataFrame:
    """Entity x season sums per year; a season without rows is 0."""
    return season_matrix_from(season_sums(fs, years))


def season_compare(spark: SparkSession, fs: FactSet, years: Sequence[int]) -> DataFrame:
    """Season totals (of the named entities) with one column per year."""
    return season_compare_from(spark, season_sums(fs, years), years)


def season_top(fs: FactSet, years: Sequence[int], n: int = 5) -> DataFrame:
    """Top-n entities per year by their total over the four seasons, with the
    season cells and the peak cell over all years' top tables."""
    return season_top_from(season_sums(fs, years), n)


# --------------------------------------------------------------------------- weekdays
def weekday_average(spark: SparkSession, fs: FactSet, years: Sequence[int]) -> DataFrame:
    """Average daily total per weekday: daily sums first, then their mean.
    Every (year, weekday) is listed; a weekday without days is NULL."""
    f = _years(fs, years)
    means = two_level_mean(
        f, {"year": F.year("ts"), "slot": weekday_slot("ts")}, {"date": F.to_date("ts")}
    )
    names = F.array(*[F.lit(d) for d in WEEKDAYS])
    calendar = (
        years_table(spark, years)
        .select("year", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("slot"))
        .withColumn("day", F.element_at(names, F.col("slot") + 1))
    )
    # one row per (requested year, weekday): broadcast, a bounded size
    return calendar.join(F.broadcast(means), ["year", "slot"], "left").select(
        "year", "slot", "day", "avg_total"
    )


# --------------------------------------------------------------------------- hours
def hour_average_by_entity_year(
    fs: FactSet, years: Sequence[int], keep_id: bool = False
) -> DataFrame:
    """Per-row average per (year, id, entity, hour); 0 where a group has no
    measure. ``keep_id=False`` leaves the id out, as the report does, so a
    name with two ids has two rows for an hour. Sorted by name and hour when
    it is written (``bundles.ORDERS``): a sort here would not survive that."""
    f = _years(fs, years)
    sums = entity_sums(f, {"year": F.year("ts"), "hour": F.hour("ts")}, with_id=True)
    cols = ["year"] + (["id"] if keep_id else []) + ["entity", "hour"]
    return sums.select(*cols, mean_of(zero_if_empty=True).alias("avg"))


def peak_hours(fs: FactSet, years: Sequence[int]) -> DataFrame:
    """Busiest and quietest hour per (year, id, entity), by per-row average;
    ties go to the earlier hour. One aggregate of (average, hour) structs --
    combined map-side, no window over an entity's rows."""
    f = _years(fs, years)
    sums = entity_sums(f, {"year": F.year("ts"), "hour": F.hour("ts")}, with_id=True)
    avgs = sums.select("year", "id", "entity", "hour", mean_of().alias("avg")).where(F.col("avg").isNotNull())
    g = avgs.groupBy("year", "id", "entity").agg(
        F.max(F.struct(F.col("avg"), (-F.col("hour")).alias("neg_hour"))).alias("hi"),
        F.min(F.struct(F.col("avg"), F.col("hour"))).alias("lo"),
    )
    return g.select(
        "year",
        "id",
        "entity",
        (-F.col("hi.neg_hour")).alias("peak_hour"),
        F.col("hi.avg").alias("peak_avg"),
        F.col("lo.hour").alias("low_hour"),
        F.col("lo.avg").alias("low_avg"),
    )


def hour_average_by_entity(fs: FactSet) -> DataFrame:
    """Per-row average per (id, entity, hour) over all years."""
    sums = entity_sums(fs, {"hour": F.hour("ts")}, with_id=True)
    return sums.select("id", "entity", "hour", mean_of().alias("avg"))


def hour_profile(spark: SparkSession, fs: FactSet) -> DataFrame:
    """Network hour profile: sum over **all rows** of the hour (rows with a
    missing measure included), on the 1 ... 23, 0 axis; NULL for an hour
    without rows."""
    sums = key_sums(fs, {"hour": F.hour("ts")})
    prof = sums.select("hour", (total_of("s") / F.col("rows")).alias("avg_per_row"))
    # one row per hour of the day (at most 24): broadcast, a bounded size
    return hours_table(spark).select("slot", "hour").join(F.broadcast(prof), "hour", "left").select(
        "slot", "hour", "avg_per_row"
    )


def hour_sum_for(fs: FactSet, names: Sequence[str], spark: SparkSession | None = None) -> DataFrame:
    """Sum per hour over the entities with the given names.

    With a names dimension the facts are semi-joined with the ids of those
    names. Given ``spark``, that id list is first written as a table in the
    shared folder, so the planner sees its real (small) size and broadcasts
    it instead of shuffling the facts for a sort-merge join."""
    if fs.inline:
        rows = fs.facts.where(F.col("entity").isin(list(names)))
    else:
        ids = fs.names.where(F.col("entity").isin(list(names))).select("id").distinct()
        if spark is not None:
            ids = write_and_read(spark, ids, shared_dir(spark, "selected-ids"))
        rows = fs.facts.join(ids, "id", "left_semi")
    return key_sums(fs.with_facts(rows), {"hour": F.hour("ts")}).select(
        "hour", total_of("s").alias("total")
    )


def network_hour_curve(spark: SparkSession, fs: FactSet, years: Sequence[int]) -> DataFrame:
    """Per-row average per hour of the whole network, one column per year,
    on the full 24-hour axis in hour order (not label order)."""
    f = _years(fs, years)
    sums = key_sums(f, {"year": F.year("ts"), "hour": F.hour("ts")})
    means = sums.withColumn("avg", mean_of())
    wide = pivot_one(means, ["hour"], "year", list(years), "avg", names=[f"y{y}" for y in years])
    wide = F.broadcast(wide)  # one row per hour of the day: at most 24 rows
    return hours_table(spark).select("hour", "label").join(wide, "hour", "left").select(
        "hour", "label", *[f"y{y}" for y in years]
    )


def stored_profile(spark: SparkSession, path: str, year: int | None = None, fmt: str = "parquet") -> DataFrame:
    """A stored hourly profile with file-safe names and the 12-hour label: id,
    entity, clean_name, hour, label, avg."""
    back = read_profile(spark, path, year, fmt)
    return back.select("id", "entity", sanitize_name("entity").alias("clean_name"), "hour", hour_label("hour").alias("label"), "avg")


# --------------------------------------------------------------------------- series
SERIES_KEYS = ["year", "month", "id", "entity"]


def monthly_series(
    fs: FactSet,
    *,
    min_slots: int | None = 12,
    year: int | None = None,
    month: int | None = None,
    name_rule: str = "group",
) -> DataFrame:
    """24-hour average series per (year, month, id, entity): coverage filter
    (``min_slots``), full hour axis, linear gap fill, series mean.

    ``name_rule="first_seen"`` keys a series by (year, month, id) alone and
    names it by the name on its earliest row with a measure (ties: smallest name), as a
    series per station id with the first name seen; the earliest
    (ts, name) pair rides along in the same aggregates, so it costs no
    extra scan. Names must be inline for it."""
    f = fs
    if year is not None and month is not None:
        f = fs.for_month(year, month)
    elif year is not None:
        f = fs.for_years([year])
    cols = [*SERIES_KEYS, "hour", "label", "v", "filled", "mean", "n_slots"]
    id_keys = ["year", "month", "id"]
    if name_rule not in ("group", "first_seen"):
        raise ValueError("name_rule must be 'group' or 'first_seen'")
    if not fs.inline:
        if name_rule == "first_seen":
            raise ValueError("first_seen needs names on the fact rows")
        keys = {"year": F.year("ts"), "month": F.month("ts"), "hour": F.hour("ts")}
        sums = entity_sums(f, keys, with_id=True)
        out = filled_series(sums.select(*SERIES_KEYS, "hour", mean_of().alias("v")), SERIES_KEYS, min_slots=min_slots)
    else:
        rows = f.facts.select(
            F.year("ts").alias("year"), F.month("ts").alias("month"), F.hour("ts").alias("hour"),
            "id", "ts", "entity", measure("v").alias("v"),
        )
        if name_rule == "group":
            arrays = slot_means(rows.where(non_null([*SERIES_KEYS, "hour"])), SERIES_KEYS, scale=fs.scale)
            out = series_rows(arrays, SERIES_KEYS, min_slots=min_slots)
        else:
            named = F.min(F.when(F.col("v").isNotNull(), F.struct("ts", "entity")))["entity"]
            arrays = slot_means(rows.where(non_null([*id_keys, "hour"])), id_keys, scale=fs.scale, carry={"entity": named})
            out = series_rows(arrays, id_keys, min_slots=min_slots, carry=["entity"])
    # hours in slot order (not label order) within each series
    return out.select(*cols).sortWithinPartitions(*SERIES_KEYS, "hour")
