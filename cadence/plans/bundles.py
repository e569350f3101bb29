"""Report bundles: the set of tables one report script produces, computed
from **one** scan of the facts.

The aggregate the tables share (e.g. sums per year, season and entity) is
computed once and written as a table in the shared checkpoint folder; every
table of the bundle is derived from that small, reliable copy, so the facts
are not read again and a lost executor does not send Spark back to the raw
input.

    bundle = seasonal_report(spark, facts, [2023, 2024])
    write_report(spark, bundle, "reports/seasonal", fmt="csv")
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.binding import FactSet
from cadence.functions.calendar import years_table
from cadence.operators.aggregate import by_keys, partials, total_of, with_default
from cadence.operators.rank import rank_aligned
from cadence.plans import reports as rpt
from cadence.plans.labels import HEADINGS
from cadence.session import shared_dir
from cadence.sinks.writers import materialize as write_and_read
from cadence.sinks.writers import run_folder, write_bundle


def materialize(spark: SparkSession, df: DataFrame, name: str = "shared-aggregate") -> DataFrame:
    """Compute ``df`` once as a Parquet table in the shared checkpoint folder
    and read it back (see ``sinks.writers.materialize``). An RDD
    ``checkpoint()`` of an unpersisted plan would compute it twice; a
    machine-local copy would not survive a lost executor."""
    return write_and_read(spark, df, shared_dir(spark, name))


def seasonal_report(
    spark: SparkSession, fs: FactSet, years: Sequence[int], n: int = 5
) -> dict[str, DataFrame]:
    """Season matrix, season comparison and top-n season table."""
    sums = materialize(spark, rpt.season_sums(fs, years))
    return {
        "season_matrix": rpt.season_matrix_from(sums),
        "season_compare": rpt.season_compare_from(spark, sums, years),
        "season_top": rpt.season_top_from(sums, n),
    }


def yearly_report(
    spark: SparkSession,
    fs: FactSet,
    years: Sequence[int],
    top_long: int = 15,
    top_short: int = 10,
) -> dict[str, DataFrame]:
    """Year totals (every requested year), entity shares, the top lists and
    the top lists of every two adjacent years side by side (one table; with more
    than two years one per pair, named by its years)."""
    f = fs.for_years(years)
    part = materialize(spark, partials(f, {"year": F.year("ts")}))
    totals = by_keys(part, ["year"]).select("year", total_of("s").alias("total"))
    shares = rpt.shares_from(f, part)
    entity_totals = shares.select("year", "entity", "total")
    out = {
        "year_totals": with_default(years_table(spark, years), totals, ["year"]),
        "shares": shares,
        f"top_{top_long}": rpt.top_from(entity_totals, top_long),
        f"top_{top_short}": rpt.top_from(entity_totals, top_short),
    }
    ordered = sorted(set(years))
    for a, b in zip(ordered, ordered[1:], strict=False):
        pair = "" if len(ordered) == 2 else f"_{a}_{b}"
        out[f"top_{top_short}_side_by_side{pair}"] = rank_aligned(
            rpt.top_from(entity_totals.where(F.col("year").isin(a, b)), top_short), "year", a, b
        ).select("rank", "entity_a", "total_a", "entity_b", "total_b")
    return out


def hourly_report(spark: SparkSession, fs: FactSet, years: Sequence[int]) -> dict[str, DataFrame]:
    """Average per station and hour for every year (one table, with year)."""
    return {"hour_averages": rpt.hour_average_by_entity_year(fs, years)}


def weekday_report(spark: SparkSession, fs: FactSet, years: Sequence[int]) -> dict[str, DataFrame]:
    return {"weekday_averages": rpt.weekday_average(spark, fs, years)}


def monthly_report(
    spark: SparkSession, fs: FactSet, years: Sequence[int] | None = None, min_slots: int | None = 12
) -> dict[str, DataFrame]:
    """The 24-hour series of the chosen years (None: all), one per month and id,
    named by the id's first name where names stand on the fact rows; written
    partitioned by (year, month)."""
    chosen = fs if years is None else fs.for_years(years)
    rule = "first_seen" if fs.inline else "group"
    return {"monthly_series": rpt.monthly_series(chosen, min_slots=min_slots, name_rule=rule)}


PARTITIONS = {
    "hour_averages": ["year"],
    "monthly_series": ["year", "month"],
    "shares": ["year"],
}

#: Columns that the files of a partitioned table are sorted by.
ORDERS = {
    "hour_averages": ["id", "entity", "hour"],
    "monthly_series": ["id", "entity", "hour"],
}


def _order_of(name: str, table: DataFrame) -> list[str]:
    """The sort columns of a table, under the report's headings if it has those."""
    headings = HEADINGS.get(name, {})
    called = [c if c in table.columns else headings.get(c, c) for c in ORDERS.get(name, ())]
    return [c for c in called if c in table.columns]


def write_report(
    spark: SparkSession,
    bundle: Mapping[str, DataFrame],
    root: str,
    fmt: str = "parquet",
    partition_by: Mapping[str, Sequence[str]] | None = None,
) -> dict[str, str]:
    """Write every table of a bundle under a new ``run_ts=`` folder of
    ``root`` (an earlier run is never overwritten). Returns name -> path."""
    parts = dict(PARTITIONS)
    parts.update(partition_by or {})
    folder = run_folder(root)
    paths = write_bundle(
        bundle,
        folder,
        fmt=fmt,
        partition_by={k: v for k, v in parts.items() if k in bundle},
        order={k: _order_of(k, table) for k, table in bundle.items()},
    )
    # written last: a run folder without a manifest is an unfinished run
    manifest = spark.createDataFrame(sorted(paths.items()), "table STRING, path STRING")
    manifest.coalesce(1).write.mode("errorifexists").json(f"{folder}/_manifest")
    return paths


def read_manifest(spark: SparkSession, run: str) -> dict[str, str]:
    """Table -> path of a finished run folder (fails on an unfinished one)."""
    rows = spark.read.schema("table STRING, path STRING").json(f"{run.rstrip('/')}/_manifest").collect()
    return {r.table: r.path for r in rows}
