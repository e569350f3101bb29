"""File sources: the hourly export as CSV, landed API pages as JSON, and a
stored hourly profile as Parquet.

Raw cells are read as STRING and converted by Column expressions, so a bad
cell is a query matter (strict: the job fails; lenient: the cell is NULL).
"""

from __future__ import annotations

import csv
from collections.abc import Sequence
from functools import reduce
from itertools import islice
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadence.binding import FactSet, missing_columns, require_columns, strip_column_names
from cadence.functions.clean import US_STAMP, to_number, to_stamp, to_stamp_guess
from cadence.operators.quality import IN_YEAR, observed
from cadence.session import ensure_defaults
from cadence.sinks.writers import list_folders

# ---------------------------------------------------------------------------
# Column names of the hourly ridership export
# ---------------------------------------------------------------------------
TS = "transit_timestamp"
ENTITY_ID = "station_complex_id"
ENTITY = "station_complex"
MEASURE = "ridership"
REQUIRED = [TS, ENTITY_ID, ENTITY, MEASURE]

RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType(), True) for c in REQUIRED])

MODES = ("strict", "lenient", "keep")


def read_raw_csv(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Headered CSV, every column as STRING (no inference pass over the
    data), column names stripped of outer blanks. All files must have the same
    header: a file whose columns differ or stand in another order fails the read
    instead of being taken by position. For files of several headers, see
    ``read_raw_csv_by_name``."""
    df = (
        spark.read.option("header", True)
        .option("inferSchema", False)
        .option("multiLine", False)
        .option("enforceSchema", False)
        .csv(path if isinstance(path, str) else list(path))
    )
    return strip_column_names(df)


#: Different headers that one input may have.
MAX_HEADERS = 64


def header_index(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(file, header): the first line of every file. One task a file, which stops
    after its first line, so no file is read through; empty files have no row."""
    # a file alone in its partition, and in one piece, while this listing is planned
    alone = {"spark.sql.files.maxPartitionBytes": str(1 << 50), "spark.sql.files.openCostInBytes": str(1 << 50)}
    before = {k: spark.conf.get(k) for k in alone}
    for k, v in alone.items():
        spark.conf.set(k, v)
    try:
        lines = spark.read.text(path if isinstance(path, str) else list(path)).select(F.input_file_name().alias("file"), F.col("value").alias("header"))
        first = lines.rdd.mapPartitions(lambda rows: islice(rows, 1)).collect()  # a row for each file, as Spark's own listing
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.createDataFrame(first, "file string, header string")


def read_raw_csv_by_name(spark: SparkSession, path: str | Sequence[str], with_file: str | None = None) -> DataFrame:
    """Headered CSV files whose headers differ, joined by column name: every column
    as STRING under its name without outer blanks, NULL in files that lack it.

    Files are grouped by their header line, each group is read as one table, and
    the tables are united by name. More than MAX_HEADERS headers, or a header that
    names a column twice, is refused. ``with_file`` adds the path of a row's file
    under that name."""
    by_header = header_index(spark, path).groupBy("header").agg(F.collect_list("file").alias("files")).orderBy("header").limit(MAX_HEADERS + 1).collect()
    if len(by_header) > MAX_HEADERS:
        raise ValueError(f"more than {MAX_HEADERS} different headers")
    if not by_header:
        raise ValueError("no file has a header")
    for r in by_header:  # Spark would number the names that stand twice
        names = [c.strip().lower() for c in next(csv.reader([r["header"]]))]
        if len(set(names)) < len(names):
            raise ValueError(f"a header names a column twice: {names}")
    tables = [read_raw_csv(spark, [unquote(f) for f in r["files"]]) for r in by_header]
    if with_file is not None:
        tables = [t.withColumn(with_file, F.input_file_name()) for t in tables]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def sample(df: DataFrame, n: int = 5) -> DataFrame:
    """A head-n preview (reads only the first split)."""
    return df.limit(n)


FACT_SCHEMA = "ts timestamp_ntz, id string, entity string, v double"


def clean_hourly(
    raw: DataFrame,
    mode: str = "lenient",
    fmt: str = US_STAMP,
    guess: bool = True,
    on_missing: str = "raise",
) -> DataFrame:
    """Raw export cells -> ts, id, entity, v (+ every other column dropped).

    * ``strict``: stamps in ``fmt`` and measures must parse, or the job fails;
    * ``lenient``: bad stamps and measures become NULL and the row is dropped;
    * ``keep``: as lenient, but rows with NULLs are kept (a later year filter
      removes them).
    With ``guess`` a stamp that does not fit ``fmt`` is tried in ISO form.
    A source without a required column stops with ``ValueError``, or with
    ``on_missing="empty"`` gives an empty fact table (its rows are skipped).
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    # stamps are naive wall-clock times: parse them under UTC, so an hour in
    # a daylight-saving gap of the session's zone keeps its value
    ensure_defaults(raw.sparkSession)
    if on_missing == "empty" and missing_columns(raw, REQUIRED):
        return raw.sparkSession.createDataFrame([], FACT_SCHEMA)
    require_columns(raw, REQUIRED)
    strict = mode == "strict"
    if strict:
        ts = to_stamp(TS, fmt, strict=True)
    elif guess:
        ts = to_stamp_guess(TS, fmt)
    else:
        ts = to_stamp(TS, fmt)
    facts = raw.select(
        ts.alias("ts"),
        F.col(ENTITY_ID).alias("id"),
        F.col(ENTITY).alias("entity"),
        to_number(MEASURE, strict=strict).alias("v"),
    )
    if mode == "lenient":
        facts = facts.dropna(subset=["ts", "v"])
    return facts


def read_hourly_csv(
    spark: SparkSession, path: str | Sequence[str], mode: str = "lenient", fmt: str = US_STAMP
) -> FactSet:
    """The hourly export as a FactSet with names inline; files may differ in the
    order and number of their columns."""
    return FactSet(clean_hourly(read_raw_csv_by_name(spark, path), mode=mode, fmt=fmt))


def read_json_pages(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Landed API pages (JSON arrays of records, values as text) with the
    export's fields; an empty page adds no rows, and a page that cannot be read
    fails the job. To go on without such pages, see ``sources.pages``."""
    return (
        spark.read.schema(RAW_SCHEMA)
        .option("multiLine", True)
        .option("mode", "FAILFAST")
        .json(path if isinstance(path, str) else list(path))
    )


def pages_in_range(pages: DataFrame, start: str, end: str) -> DataFrame:
    """Cleaned page records with ``start <= ts <= end`` (closed range)."""
    facts = clean_hourly(pages, mode="lenient")
    lo = F.lit(start).cast("timestamp_ntz")
    hi = F.lit(end).cast("timestamp_ntz")
    return facts.where(F.col("ts").between(lo, hi))


# The stored hourly profile's CSV columns
PROFILE_CSV_SCHEMA = "station_complex_id STRING, station_complex STRING, hour INT, ridership DOUBLE"


def read_profile(spark: SparkSession, path: str, year: int | None = None, fmt: str = "parquet") -> DataFrame:
    """A stored hourly profile -> (id, entity, hour, avg [, year]).

    ``parquet``: as written by the library, partitioned by ``year``; the year
    filter prunes partitions, so only that year's files are listed and read.
    ``csv``: the export form with a header (station_complex_id,
    station_complex, hour, ridership); a ``year=`` folder layout is read as a
    partition column as well."""
    if fmt == "csv":
        df = spark.read.option("header", True).schema(PROFILE_CSV_SCHEMA).csv(path)
        df = df.withColumnsRenamed(
            {"station_complex_id": "id", "station_complex": "entity", "ridership": "avg"}
        )
    else:
        df = spark.read.parquet(path)
    if year is not None:
        df = df.where(F.col("year") == year)
    return df


def land_as_parquet(fs: FactSet, path: str, mode: str = "errorifexists") -> str:
    """Write cleaned facts once as Parquet partitioned by year and month, so
    later reports prune whole folders by their year/month filters and read
    only the columns they use (CSV is re-parsed on every scan).

    The partition columns are added to the stored rows; ``read_landed`` gives
    the FactSet back. Clustering uses a ``rebalance`` hint, so a month that
    holds much of the data is written by several tasks."""
    facts = fs.facts.where(F.col("ts").isNotNull()).withColumns(
        {"year": F.year("ts"), "month": F.month("ts")}
    )
    facts.hint("rebalance", "year", "month").write.mode(mode).partitionBy("year", "month").parquet(path)
    return path


def stage_facts(
    raw: DataFrame, path: str, mode: str = "lenient", years: Sequence[int] = (), fmt: str = US_STAMP, write_mode: str = "errorifexists"
) -> dict[str, int]:
    """Parse raw cells once into landed Parquet facts at ``path`` and return the
    run's counters, taken on the same pass. Reports then read typed, pruned columns
    instead of parsing the text again for every table."""
    parsed, counters = observed(clean_hourly(raw, mode="strict" if mode == "strict" else "keep", fmt=fmt), years)
    kept = parsed.dropna(subset=["ts", "v"]) if mode == "lenient" else parsed
    land_as_parquet(FactSet(kept), path, mode=write_mode)
    return counters.get


def landed_months(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(year, month) of landed folders, from their names alone: no file is opened."""
    found = set()
    for root in [path] if isinstance(path, str) else path:
        for y in list_folders(spark, root):
            if y.startswith("year="):
                found |= {(int(y[5:]), int(m[6:])) for m in list_folders(spark, f"{root}/{y}") if m.startswith("month=")}
    return spark.createDataFrame(sorted(found), "year int, month int")


def landed_counters(spark: SparkSession, path: str | Sequence[str], years: Sequence[int]) -> dict[str, int]:
    """Rows of each target year in landed folders: only the folders' year is used,
    so the row counts come from file footers and no column is read."""
    facts = read_landed(spark, path).facts
    found = {r["year"]: r["n"] for r in facts.where(F.col("year").isin(list(years))).groupBy("year").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {f"{IN_YEAR}_{y}": found.get(y, 0) for y in years}


def read_landed(spark: SparkSession, path: str | Sequence[str]) -> FactSet:
    """Facts of all given folders landed by ``land_as_parquet`` (names inline). The ``year`` and
    ``month`` partition columns stay, so year and month filters of the
    reports skip whole folders."""
    paths = [path] if isinstance(path, str) else list(path)
    folders = [spark.read.parquet(p) for p in paths]
    return FactSet(reduce(lambda a, b: a.unionByName(b), folders))
