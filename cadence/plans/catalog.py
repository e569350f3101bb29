"""Named queries over the driver's tables: ``name -> fn(spark, sf_dir)``.

Each query reads whole tables (bindings in ``cadence.sources.tables``) and
returns a lazy DataFrame; the matching DuckDB SQL is in ``plans/oracle.py``
under the same name, with the same column names.

Parameters below are the reports' own (top 15, top 10, top 5, 12 of 24
hours, ...); the years 1996 and 1997 stand for the reports' 2023 and 2024 on
the TPC-H-like dates, and H2 gives the events two real years 2023 and 2024.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadence.binding import FactSet
from cadence.functions.calendar import day_name, hour_label, weekday_slot
from cadence.functions.text import (
    clock_hour12,
    fixed2,
    percent_text,
    sanitize_name,
    stamp_year,
    thousands,
)
from cadence.functions.clean import to_number, to_stamp_strict_guess
from cadence.operators import aggregate as agg
from cadence.operators import entity as ent
from cadence.operators.position import page_at, rank_every, with_position
from cadence.operators.quality import counters_table, quality_counts, rows_per_year
from cadence.operators.series import filled_series
from cadence.operators.store import PartialStore
from cadence.plans import reports as rpt
from cadence.session import ensure_defaults, shared_dir
from cadence.plans.bundles import monthly_report, seasonal_report, write_report, yearly_report
from cadence.sinks.writers import list_folders, write_partitioned
from cadence.sources.files import (
    clean_hourly,
    land_as_parquet,
    landed_months,
    read_hourly_csv,
    read_landed,
    read_raw_csv_by_name,
    stage_facts,
)
from cadence.sources.pages import Pages, land_pages
from cadence.sources.pages import append_pages as append_array_pages
from cadence.sources.stamps import read_hourly_csv_voted
from cadence.sources.tables import (
    events_dirty,
    events_dirty_text,
    events_hourly,
    events_two_years,
    lineitem_supplier,
    orders_customer,
    read_table,
)
from cadence.streaming.running import append_stream, running_totals

Query = Callable[[SparkSession, str], DataFrame]

# Parameters of the reports ---------------------------------------------------
YEAR_A, YEAR_B = 1996, 1997          # stand-ins for the reports' 2023, 2024
TOTAL_YEARS = list(range(1994, 2003))  # requested years; 1994 and 2002 have no rows
HOUR_YEARS = [2023, 2024]            # the two real years of binding H2
SUBSET_NAMES = ["click", "view"]     # entity names of the hour histogram
EXTRACT_IDS = [10, 20]               # entity ids of the range extract
RANGE_START, RANGE_END = "1996-01-01 00:00:00", "1997-12-31 23:59:59"
PAGE_OFFSET, PAGE_SIZE = 200, 100
SLICE_AT = "2024-01-16 00:00:00"     # split of the events into two slices
OUTER_ADD_CUT = "2024-01-01 12:00:00"  # slices with different hours
SERIES_YEAR, SERIES_MONTH = 2024, 1
PAGE_ROWS = 500  # records of an API page
PAGE_FEEDS = 12  # folders that API pages land in
DEEP_OFFSET = 50_000
PROFILE_YEAR = 2024

_REGISTRY: dict[str, Query] = {}


def query(name: str):
    def deco(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ensure_defaults(spark)
            return fn(spark, sf_dir)

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        _REGISTRY[name] = run
        return run

    return deco


def queries() -> dict[str, Query]:
    return dict(_REGISTRY)


# ------------------------------------------------------------------ totals, shares
@query("totals_by_year")
def totals_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum per requested year; absent years 0 (AGG-2, AGG-24, FLT-1)."""
    return rpt.yearly_totals(spark, lineitem_supplier(spark, sf_dir), TOTAL_YEARS)


@query("entity_totals")
def entity_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum per entity in each of two years (AGG-3)."""
    return rpt.entity_year_totals(lineitem_supplier(spark, sf_dir), [YEAR_A, YEAR_B])


@query("entity_share")
def entity_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity totals with their share of the year total (RPT-2, WIN-1)."""
    return rpt.entity_shares(lineitem_supplier(spark, sf_dir), [YEAR_A, YEAR_B])


@query("entity_share_pct")
def entity_share_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share table on the 0-100 scale (RPT-14)."""
    return rpt.entity_shares(orders_customer(spark, sf_dir), [YEAR_A, YEAR_B], pct=True)


@query("top15_by_year")
def top_15_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rpt.top_by_year(lineitem_supplier(spark, sf_dir), [YEAR_A, YEAR_B], n=15)


@query("top10_rank_aligned")
def top_10_rank_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rpt.top_rank_aligned(lineitem_supplier(spark, sf_dir), YEAR_A, YEAR_B, n=10)


@query("top10_entity_aligned")
def top_10_entity_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rpt.top_entity_aligned(lineitem_supplier(spark, sf_dir), YEAR_A, YEAR_B, n=10)


@query("entity_totals_fine")
def entity_totals_fine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of a measure with many decimals and no declared scale: sums of
    doubles as they are (quantities in 1024ths, which doubles hold exactly)."""
    fs = lineitem_supplier(spark, sf_dir)
    fine = fs.facts.withColumn("v", F.col("v") / 1024)
    return rpt.entity_year_totals(FactSet(fine, fs.names), [YEAR_A, YEAR_B])


# ------------------------------------------------------------------ seasons
@query("season_matrix")
def season_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rpt.season_matrix(lineitem_supplier(spark, sf_dir), [YEAR_A, YEAR_B])


@query("season_compare")
def season_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rpt.season_compare(spark, lineitem_supplier(spark, sf_dir), [YEAR_A, YEAR_B])


@query("season_top5")
def season_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rpt.season_top(lineitem_supplier(spark, sf_dir), [YEAR_A, YEAR_B], n=5)


# ------------------------------------------------------------------ weekdays, hours
@query("weekday_avg")
def weekday_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rpt.weekday_average(spark, orders_customer(spark, sf_dir), [YEAR_A, YEAR_B])


@query("hour_avg_by_entity_year")
def hour_avg_by_entity_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rpt.hour_average_by_entity_year(events_two_years(spark, sf_dir), HOUR_YEARS)


@query("peak_hours")
def peak_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peak and off-peak hour per entity and year."""
    return rpt.peak_hours(events_two_years(spark, sf_dir), HOUR_YEARS)


@query("hour_avg_by_entity")
def hour_avg_by_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rpt.hour_average_by_entity(events_hourly(spark, sf_dir))


@query("hour_profile")
def hour_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rpt.hour_profile(spark, events_hourly(spark, sf_dir))


@query("hour_sum_subset")
def hour_sum_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rpt.hour_sum_for(events_hourly(spark, sf_dir), SUBSET_NAMES)


@query("network_hour_curve")
def network_hour_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rpt.network_hour_curve(spark, events_two_years(spark, sf_dir), HOUR_YEARS)


# ------------------------------------------------------------------ series
@query("monthly_series")
def monthly_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """24-hour series per (year, month, id, entity) with >= 12 hours (RPT-5)."""
    return rpt.monthly_series(events_hourly(spark, sf_dir), min_slots=12)


@query("monthly_series_by_id")
def monthly_series_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """24-hour series per (year, month, id), named by the first name seen
    for the id (AGG-10 as the report keys it)."""
    return rpt.monthly_series(events_hourly(spark, sf_dir), min_slots=12, name_rule="first_seen")


@query("monthly_series_all")
def monthly_series_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series of every month, no coverage filter (RPT-7)."""
    return rpt.monthly_series(events_hourly(spark, sf_dir), min_slots=None)


@query("monthly_series_one_month")
def monthly_series_one_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series of a chosen month, no coverage filter; the month reaches the scan
    (FLT-6: choosing the month is the feature)."""
    return rpt.monthly_series(
        events_hourly(spark, sf_dir), min_slots=None, year=SERIES_YEAR, month=SERIES_MONTH
    )


@query("profile_readback")
def profile_readback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hour profile of a year written partitioned by year and read back (RPT-13)."""
    fs = events_hourly(spark, sf_dir).for_years([PROFILE_YEAR])
    sums = agg.entity_sums(fs, {"year": F.year("ts"), "hour": F.hour("ts")}, with_id=True)
    profile = sums.select("year", "id", "entity", "hour", agg.mean_of().alias("avg"))
    path = write_partitioned(profile, shared_dir(spark, "profile"), ["year"])
    return rpt.stored_profile(spark, path, PROFILE_YEAR)


# ------------------------------------------------------------------ dirty input
@query("clean_facts")
def clean_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lenient parse of text cells, rows with a bad stamp or measure dropped."""
    facts = events_dirty(spark, sf_dir).facts.dropna(subset=["ts", "v"])
    return facts.select(F.col("key").alias("event_id"), "ts", F.col("v").alias("value"))


@query("quality_counts")
def quality_counts_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_counts(events_dirty(spark, sf_dir).facts)
    return out.select(
        "rows", "bad_ts", "bad_value", "kept", "valid_ratio", "min_ts", "max_ts", "min_kept_ts", "max_kept_ts"
    )


@query("rows_per_weekday")
def rows_per_weekday(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of every weekday by its name (SCL-3)."""
    facts = orders_customer(spark, sf_dir).facts.where(F.col("ts").isNotNull())
    return facts.groupBy(weekday_slot("ts").alias("slot"), day_name("ts").alias("day")).agg(F.count(F.lit(1)).alias("rows"))


@query("strict_stamps")
def strict_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per hour of stamps in ISO text, parsed so that junk would fail the job (PRJ-6)."""
    text = read_table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("t"))
    hours = text.select(F.hour(to_stamp_strict_guess("t")).alias("hour")).where(F.col("hour").isNotNull())
    return hours.groupBy("hour").agg(F.count(F.lit(1)).alias("rows"))


@query("rows_per_year")
def rows_per_year_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows_per_year(lineitem_supplier(spark, sf_dir).facts)


@query("regex_year_hour12")
def regex_year_hour12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Year and 12-hour clock hour read from the raw stamp text."""
    raw = events_dirty_text(spark, sf_dir)
    parsed = raw.select(
        stamp_year("ts_text").alias("year"),
        clock_hour12("ts_text").alias("clock_hour12"),
        to_number("v_text").alias("v"),
    )
    sums = agg.key_sums(FactSet(parsed, scale=2), {"year": F.col("year"), "clock_hour12": F.col("clock_hour12")})
    return sums.select("year", "clock_hour12", agg.total_of("s").alias("total"))


# ------------------------------------------------------------------ text files
def _export_files(spark: SparkSession, sf_dir: str) -> list[str]:
    """Binding D as the hourly export's CSV files in two folders with different
    headers: blanks around names in one, another order and a further column in
    the other."""
    raw = events_dirty_text(spark, sf_dir)
    cells = {"transit_timestamp": "ts_text", "station_complex_id": "id", "station_complex": "entity", "ridership": "v_text"}
    first = raw.where("key % 2 = 0").select(*[F.col(c).cast("string").alias(f" {n} ") for n, c in cells.items()])
    second = raw.where("key % 2 = 1").select(F.lit("Q").alias("borough"), *[F.col(c).cast("string").alias(n) for n, c in reversed(cells.items())])
    folders = [shared_dir(spark, "export-a"), shared_dir(spark, "export-b")]
    for df, folder in zip((first, second), folders, strict=True):
        df.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(folder)
    return folders


@query("csv_facts")
def csv_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of CSV files whose columns stand in different orders (SRC-1..5, PRJ-1..4)."""
    return read_hourly_csv(spark, _export_files(spark, sf_dir)).facts.select("ts", "id", "entity", "v")


@query("voted_stamps")
def voted_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of CSV files that write their stamps in three forms, each file read
    in the form most of its cells fit (PRJ-5)."""
    e = read_table(spark, sf_dir, "events")
    folders = []
    for k, form in enumerate(("MM/dd/yyyy hh:mm:ss a", "dd/MM/yyyy HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss")):
        cells = e.where(F.col("event_id") % 3 == k).select(
            F.date_format("ts", form).alias("transit_timestamp"),
            F.col("user_id").cast("string").alias("station_complex_id"),
            F.col("event_type").alias("station_complex"),
            F.col("value").cast("string").alias("ridership"),
        )
        folders.append(shared_dir(spark, f"stamps-{k}"))
        cells.write.option("header", True).csv(folders[-1])
    facts, _ = read_hourly_csv_voted(spark, folders)
    return facts.facts.select("ts", "id", "entity", "v")


@query("first_month_landed")
def first_month_landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First-month rows per id from facts landed by month: folders of months that
    are nobody's first are not read (JON-9, WIN-2, RPT-9)."""
    path = shared_dir(spark, "landed-orders")
    fs = orders_customer(spark, sf_dir)
    land_as_parquet(FactSet(fs.facts), path)
    rows = ent.first_month_rows(read_landed(spark, path), spark)
    return rows.select("key", "id", "year", "month", "v")


@query("months_landed")
def months_landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months of landed facts, from the names of their folders (AGG-14)."""
    path = shared_dir(spark, "landed-months")
    land_as_parquet(FactSet(orders_customer(spark, sf_dir).facts), path)
    return landed_months(spark, path)


@query("run_counters")
def run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run writes beside its report: counters observed while the CSV cells
    are parsed into landed facts (AGG-17)."""
    raw = read_raw_csv_by_name(spark, _export_files(spark, sf_dir))
    counts = stage_facts(raw, shared_dir(spark, "staged-facts"), mode="lenient", years=HOUR_YEARS)
    return counters_table(spark, counts)


def _landed_pages(spark: SparkSession, sf_dir: str) -> str:
    """Events as API pages, one JSON array a file: PAGE_ROWS records each, every
    seventh page cut off, and one empty page; dealt over a few folders, since a
    folder for every page makes each listing as slow as a read."""
    record = F.to_json(
        F.struct(
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("transit_timestamp"),
            F.col("user_id").cast("string").alias("station_complex_id"),
            F.col("event_type").alias("station_complex"),
            F.col("value").cast("string").alias("ridership"),
        )
    )
    numbered = read_table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / PAGE_ROWS).alias("p"), record.alias("r"))
    # a given count, which is not coalesced by size: the time goes into files, not bytes
    numbered = numbered.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p")
    body = F.concat(F.lit("["), F.array_join(F.collect_list("r"), ",\n"), F.lit("]"))
    bodies = numbered.groupBy("p").agg(body.alias("body"))
    cut = F.when(F.col("p") % 7 == 3, F.expr("left(body, length(body) - 20)")).otherwise(F.col("body"))
    every = bodies.select("p", cut.alias("value")).union(spark.sql("SELECT -1L AS p, '[]' AS value"))
    folder = shared_dir(spark, "landing-pages")
    feeds = every.select(F.pmod("p", F.lit(PAGE_FEEDS)).alias("feed"), "value")
    feeds.write.partitionBy("feed").option("maxRecordsPerFile", 1).text(folder)
    return folder


def _page_report(pages: Pages) -> DataFrame:
    """Pages and records by state, and the cleaned records by entity."""
    state = F.coalesce("reason", F.lit("whole")).alias("name")
    states = pages.ledger.groupBy(state).agg(F.count(F.lit(1)).alias("pages"), F.sum("n_records").alias("records"))
    entities = clean_hourly(pages.records).groupBy(F.col("entity").alias("name")).agg(F.count(F.lit(1)).alias("records"))
    return states.select("name", "pages", "records").union(entities.select("name", F.lit(None).cast("long"), "records"))


@query("pages_quarantine")
def pages_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Array pages read once; broken ones go to quarantine, the others on (SRC-8)."""
    return _page_report(land_pages(spark, _landed_pages(spark, sf_dir), shared_dir(spark, "pages")))


@query("append_pages_quarantine")
def append_pages_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pages added by a stream for every folder they land in, some files a
    trigger (STM-2, SNK-4)."""
    out, checkpoint = shared_dir(spark, "pages-table"), shared_dir(spark, "pages-ckpt")
    landing = _landed_pages(spark, sf_dir)
    feeds = [f"{landing}/{n}" for n in list_folders(spark, landing)]
    return _page_report(append_array_pages(spark, feeds, out, checkpoint, files_per_trigger=16, tasks_per_trigger=1))


# ------------------------------------------------------------------ entity tools
@query("entity_directory")
def entity_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ent.directory(orders_customer(spark, sf_dir))


@query("first_month_rows")
def first_month_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ent.first_month_rows(orders_customer(spark, sf_dir), spark)
    return rows.select("key", "id", "year", "month", "v")


@query("entity_range_extract")
def entity_range_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of given entities in a closed time range, in time order
    (RPT-10). Picking entities is what an extract is for; the whole table is
    scanned, with the id and range predicates pushed into the scan."""
    fs = orders_customer(spark, sf_dir)
    return ent.range_extract(fs, EXTRACT_IDS, RANGE_START, RANGE_END, cols=("key", "id", "ts", "v"))


@query("page_extract")
def page_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page 3 (rows 201-300) of the time-ordered rows of a closed range
    (SRC-8, SRT-9): the limit is the page size, the feature itself."""
    facts = orders_customer(spark, sf_dir).facts
    lo = F.lit(RANGE_START).cast("timestamp_ntz")
    hi = F.lit(RANGE_END).cast("timestamp_ntz")
    in_range = facts.where(F.col("ts").between(lo, hi)).select("key", "ts", "v")
    return ent.page(in_range, ["ts", "key"], PAGE_OFFSET, PAGE_SIZE)


@query("entity_range_positions")
def entity_range_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The range extract with the position of every row in time order (SRT-5, SRT-10)."""
    rows = ent.range_extract(orders_customer(spark, sf_dir), EXTRACT_IDS, RANGE_START, RANGE_END, cols=("key", "id", "ts", "v"))
    return with_position(rows, ["ts", "key", "id"])


@query("deep_page")
def deep_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page far into the time order of all shipped items, by position (SRT-9)."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    rows = li.select("l_shipdate", "l_orderkey", "l_linenumber", "l_quantity")
    return page_at(rows, ["l_shipdate", "l_orderkey", "l_linenumber", "l_quantity"], DEEP_OFFSET, PAGE_SIZE)


@query("entity_ranks")
def entity_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rank of every entity in its year, however many there are (WIN-5)."""
    totals = rpt.entity_year_totals(orders_customer(spark, sf_dir), [YEAR_A, YEAR_B])
    return rank_every(totals, ["year"], [F.col("total").desc(), F.col("entity")])


@query("sanitized_names")
def sanitized_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = read_table(spark, sf_dir, "pages").select(F.col("url").alias("raw"))
    types = read_table(spark, sf_dir, "part").select(F.col("p_type").alias("raw"))
    return urls.unionByName(types).select("raw", sanitize_name("raw").alias("clean"))


@query("label_text")
def label_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-year totals as report text: thousands, two decimals, percent of all
    years, and a title."""
    fs = lineitem_supplier(spark, sf_dir)
    sums = agg.key_sums(fs, {"year": F.year("ts")})
    # the all-years total as a scalar subquery (partial sums per task, then
    # one final value) set into every year's row
    grand = agg.total_of(sums.select(F.sum("s")).scalar())
    t = sums.select("year", agg.total_of("s").alias("total"), grand.alias("grand"))
    share = F.when(F.col("grand") > 0, F.col("total") / F.col("grand")).otherwise(F.lit(0.0))
    total_text = thousands("total", 0)
    return t.select(
        "year",
        total_text.alias("total_text"),
        fixed2("total").alias("total_2dp"),
        percent_text(share, 2).alias("pct_text"),
        F.concat_ws(": ", F.col("year").cast("string"), total_text).alias("title"),
    )


@query("merge_partials")
def merge_partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial sums of two slices merged = one pass (AGG-23, SET-1)."""
    fs = events_hourly(spark, sf_dir)
    cut = F.lit(SLICE_AT).cast("timestamp_ntz")
    keys = {"entity": F.col("entity"), "hour": F.hour("ts")}
    early = agg.key_sums(fs.where(F.col("ts") < cut), keys)
    late = agg.key_sums(fs.where(~(F.col("ts") < cut)), keys)
    merged = agg.merge_partials([early, late], ["entity", "hour"])
    return merged.select("entity", "hour", agg.total_of("s").alias("total"), "n")


@query("stored_partials")
def stored_partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hour sums from a store of monthly partials: every month put once from its own
    facts, one of them again, then merged (AGG-23, SET-1)."""
    fs = events_hourly(spark, sf_dir)
    store = PartialStore(spark, shared_dir(spark, "partials"), ["entity", "hour"])
    keys = {"entity": F.col("entity"), "hour": F.hour("ts")}
    months = [(r["year"], r["month"]) for r in ent.distinct_months(fs.facts).collect()]  # calendar months
    for year, month in months:
        store.put_month(fs, year, month, keys)
    store.put_month(fs, *months[0], keys)
    return store.merged().select("entity", "hour", agg.total_of("s").alias("total"), "n")


@query("outer_add")
def outer_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hour sums of two slices with different hours, full-outer added."""
    fs = events_hourly(spark, sf_dir)
    # slice a: the first half day (hours 0-11 only), slice b: everything later
    cut = F.lit(OUTER_ADD_CUT).cast("timestamp_ntz")
    keys = {"hour": F.hour("ts")}
    a = agg.key_sums(fs.where(F.col("ts") < cut), keys)
    b = agg.key_sums(fs.where(F.col("ts") >= cut), keys)
    added = agg.outer_add(a, b, ["hour"], "s")
    return added.select("hour", agg.total_of("s").alias("total"))


@query("months_seen")
def months_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = lineitem_supplier(spark, sf_dir).facts
    o = orders_customer(spark, sf_dir).facts
    return ent.distinct_months(y.select("ts").unionByName(o.select("ts")))


# ------------------------------------------------------------------ streams, sinks
def _landed(spark: SparkSession, sf_dir: str, name: str) -> tuple[str, T.StructType]:
    """The files of a table as a stream's landing place, and their schema. A
    stream wants a folder or a glob, a table may be one file: the glob matches
    its name alone, and no copy is made."""
    return f"{sf_dir}/{name}.parque[t]", read_table(spark, sf_dir, name).schema


@query("running_hour_state")
def running_hour_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running sums per (entity, hour) over landed event files (STM-1)."""
    out = running_totals(
        spark,
        *_landed(spark, sf_dir, "events"),
        {"entity": F.col("event_type"), "hour": F.hour("ts")},
        "value",
        out=shared_dir(spark, "running-out"),
        checkpoint=shared_dir(spark, "running-ckpt"),
        scale=2,
    )
    return out.select("entity", "hour", agg.total_of("s").alias("total"), "n")


@query("monthly_series_streamed")
def monthly_series_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The monthly series from streamed running state: sums and counts per
    (year, month, id, entity, hour) kept by a stream over landed event files
    (STM-1), then coverage filter, spine and gap fill over the state table."""
    keys = {
        "year": F.year("ts"),
        "month": F.month("ts"),
        "id": F.col("user_id"),
        "entity": F.col("event_type"),
        "hour": F.hour("ts"),
    }
    state = running_totals(
        spark,
        *_landed(spark, sf_dir, "events"),
        keys,
        "value",
        out=shared_dir(spark, "series-state"),
        checkpoint=shared_dir(spark, "series-ckpt"),
        scale=2,
    )
    per_slot = state.select(*rpt.SERIES_KEYS, "hour", agg.mean_of().alias("v"))
    out = filled_series(per_slot, rpt.SERIES_KEYS, min_slots=12)
    return out.select(*rpt.SERIES_KEYS, "hour", "label", "v", "filled", "mean", "n_slots")


@query("append_pages")
def append_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed JSON pages appended to a table by a stream (STM-2, SNK-4)."""
    from cadence.sources.files import RAW_SCHEMA

    e = read_table(spark, sf_dir, "events")
    pages = e.select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("transit_timestamp"),
        F.col("user_id").cast("string").alias("station_complex_id"),
        F.col("event_type").alias("station_complex"),
        F.col("value").cast("string").alias("ridership"),
    )
    landing = shared_dir(spark, "landing-pages")
    pages.write.json(landing)
    table = append_stream(
        spark,
        landing,
        RAW_SCHEMA,
        lambda df: clean_hourly(df, mode="lenient"),
        out=shared_dir(spark, "pages-table"),
        checkpoint=shared_dir(spark, "pages-ckpt"),
    )
    return table.groupBy("entity").agg(F.count(F.lit(1)).alias("rows"))


@query("report_bundle")
def report_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the yearly report bundle (one scan, CSV, shares partitioned by
    year, in a new run folder) and read the entity totals back from the CSV
    files."""
    fs = lineitem_supplier(spark, sf_dir)
    bundle = yearly_report(spark, fs, [YEAR_A, YEAR_B])
    paths = write_report(spark, bundle, shared_dir(spark, "reports"), fmt="csv")
    schema = T.StructType(
        [
            T.StructField("entity", T.StringType()),
            T.StructField("total", T.DoubleType()),
            T.StructField("share", T.DoubleType()),
        ]
    )
    back = spark.read.option("header", True).schema(schema).csv(paths["shares"])
    return back.select(F.col("year").cast("int").alias("year"), "entity", "total")


@query("season_bundle_top5")
def season_bundle_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seasonal report bundle (three tables from one scan) written as
    CSV in a new run folder; its top-5 table read back (RPT-1, SNK-3)."""
    fs = lineitem_supplier(spark, sf_dir)
    paths = write_report(
        spark, seasonal_report(spark, fs, [YEAR_A, YEAR_B], n=5), shared_dir(spark, "seasonal"), fmt="csv"
    )
    schema = "year INT, rank INT, entity STRING, Winter DOUBLE, Spring DOUBLE, Summer DOUBLE, Fall DOUBLE, total DOUBLE, peak DOUBLE"
    return spark.read.option("header", True).schema(schema).csv(paths["season_top"])


@query("monthly_series_written")
def monthly_series_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The monthly series written partitioned by (year, month) -- one folder
    per month -- and read back whole (RPT-5, SNK-6)."""
    fs = events_hourly(spark, sf_dir)
    paths = write_report(spark, monthly_report(spark, fs, min_slots=12), shared_dir(spark, "monthly"))
    back = spark.read.parquet(paths["monthly_series"])
    return back.select(
        F.col("year").cast("int").alias("year"),
        F.col("month").cast("int").alias("month"),
        "id", "entity", "hour", "label", "v", "filled", "mean", "n_slots",
    )
