"""Data-quality counters: as an aggregate of their own (one scan), or taken on
the pass that a run makes anyway (observed metrics)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def quality_counts(parsed: DataFrame, ts: str = "ts", v: str = "v") -> DataFrame:
    """rows, bad_ts, bad_value, kept, valid_ratio, min_ts, max_ts.

    ``parsed`` holds the leniently parsed cells (NULL where the text was bad).
    A row is kept when both its stamp and its measure parsed. The stamp bounds
    are taken before (``*_ts``) and after (``*_kept_ts``) dropping bad rows."""
    ok_ts = F.col(ts).isNotNull()
    ok_v = F.col(v).isNotNull()
    kept = ok_ts & ok_v
    out = parsed.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(~ok_ts).alias("bad_ts"),
        F.count_if(~ok_v).alias("bad_value"),
        F.count_if(kept).alias("kept"),
        F.min(ts).alias("min_ts"),
        F.max(ts).alias("max_ts"),
        F.min(F.when(kept, F.col(ts))).alias("min_kept_ts"),
        F.max(F.when(kept, F.col(ts))).alias("max_kept_ts"),
    )
    ratio = F.when(F.col("rows") > 0, F.col("kept") / F.col("rows")).otherwise(F.lit(0.0))
    return out.withColumn("valid_ratio", ratio)


def rows_per_year(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Row count per year of the stamp (rows without a stamp are not counted)."""
    return (
        df.where(F.col(ts).isNotNull())
        .groupBy(F.year(ts).alias("year"))
        .agg(F.count(F.lit(1)).alias("rows"))
    )


#: Counters of a run that stand for a whole input, in the order they are written.
RUN_COUNTERS = ("rows_read", "bad_stamp", "bad_measure", "rows_kept")
#: Kept rows of a target year.
IN_YEAR = "rows_in_year"
COUNTERS_SCHEMA = "counter string, year int, value long"


def observed(parsed: DataFrame, years: Sequence[int] = (), ts: str = "ts", v: str = "v") -> tuple[DataFrame, Observation]:
    """``parsed`` (NULL where a cell was bad) with counters that Spark takes while
    the rows go by, in whatever action runs first: no second scan. The observation
    has RUN_COUNTERS and, for each of ``years``, the kept rows in it."""
    observation = Observation()
    ok_ts, ok_v = F.col(ts).isNotNull(), F.col(v).isNotNull() & ~F.isnan(v)
    counted = {
        "rows_read": F.count(F.lit(1)),
        "bad_stamp": F.count_if(~ok_ts),
        "bad_measure": F.count_if(~ok_v),
        "rows_kept": F.count_if(ok_ts & ok_v),
        **{f"{IN_YEAR}_{y}": F.count_if(ok_ts & ok_v & (F.year(ts) == y)) for y in years},
    }
    return parsed.observe(observation, *[c.alias(n) for n, c in counted.items()]), observation


def counters_table(spark: SparkSession, values: Mapping[str, int]) -> DataFrame:
    """(counter, year, value): counters of a run as a table; the year of a counter
    for a target year stands in a column of its own."""
    rows = []
    for name, value in values.items():
        head, _, year = name.rpartition("_")
        rows.append((IN_YEAR, int(year), int(value)) if head == IN_YEAR else (name, None, int(value)))
    return spark.createDataFrame(rows, COUNTERS_SCHEMA)
