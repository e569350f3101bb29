"""Command line: run one report on hourly facts and write its tables.

    spark-submit -m cadence seasonal --input 'raw/*.csv' --years 2023 2024 --out reports/
    python -m cadence yearly  --input landed/ --source landed --years 2023 2024 --out reports/
    python -m cadence land    --input 'raw/*.csv' --out landed/

Each report writes its tables under ``<out>/<report>/run_ts=<time>/<table>/``
(never over an earlier run) and prints the table paths as JSON. Beside them stands
``run_counters``: rows read, kept, with a bad stamp, with a bad measure and in each
target year, counted on the pass that parses the input; for JSON pages also
``quarantined_pages``.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence

from pyspark.sql import functions as F

from cadence.binding import FactSet
from cadence.operators import entity as ent
from cadence.plans import bundles
from cadence.plans import reports as rpt
from cadence.plans.labels import as_report_columns
from cadence.operators.quality import counters_table
from cadence.session import build_session, shared_dir
from cadence.sources.files import (
    land_as_parquet,
    landed_counters,
    read_landed,
    read_raw_csv_by_name,
    stage_facts,
)
from cadence.sources.pages import land_pages

REPORTS = (
    "seasonal", "yearly", "hourly", "weekday", "monthly", "profile", "network", "histogram", "peak-hours",
    "directory", "first-month", "extract", "shares-pct", "stored-profile", "land",
)


def _raw(spark, args):
    """Raw cells of the text sources, and what else the run has to write."""
    if args.source == "csv":
        return read_raw_csv_by_name(spark, args.input), {}, {}
    landed = land_pages(spark, args.input, shared_dir(spark, "pages"))
    quarantine = landed.quarantine
    counts = {"pages_read": landed.ledger.count(), "pages_in_quarantine": quarantine.count()}
    return landed.records, counts, {"quarantined_pages": quarantine}


def _facts(spark, args) -> tuple[FactSet, dict[str, int], dict]:
    """The facts, the run's counters and further tables. Text is parsed once, into
    typed facts in the shared folder, and counted on that pass."""
    if args.source == "landed":
        return read_landed(spark, args.input), landed_counters(spark, args.input, args.years), {}
    raw, counts, tables = _raw(spark, args)
    path = shared_dir(spark, "staged-facts")
    counts |= stage_facts(raw, path, mode=args.mode, years=args.years)
    return read_landed(spark, path), counts, tables


def _bundle(spark, args, fs: FactSet) -> dict:
    years = args.years
    if args.report == "seasonal":
        return bundles.seasonal_report(spark, fs, years, n=args.top)
    if args.report == "yearly":
        return bundles.yearly_report(spark, fs, years)
    if args.report == "hourly":
        return bundles.hourly_report(spark, fs, years)
    if args.report == "weekday":
        return bundles.weekday_report(spark, fs, years)
    if args.report == "monthly":
        return bundles.monthly_report(spark, fs, years, min_slots=args.min_slots or None)
    if args.report == "profile":
        return {"hour_profile": rpt.hour_average_by_entity(fs)}
    if args.report == "network":
        return {"network_hour_curve": rpt.network_hour_curve(spark, fs, years)}
    if args.report == "histogram":
        return {"hour_totals": rpt.hour_sum_for(fs, args.names, spark)}
    if args.report == "peak-hours":
        return {"peak_hours": rpt.peak_hours(fs, years)}
    if args.report == "directory":
        return {"directory": ent.directory(fs)}
    if args.report == "first-month":
        chosen = fs.where(F.col("id").isin(args.ids)) if args.ids else fs
        return {"first_month_rows": ent.first_month_rows(chosen, spark)}
    if args.report == "shares-pct":
        return {"shares_pct": rpt.entity_shares(fs, years, pct=True)}
    if args.report == "extract":
        return {"extract": ent.range_extract(fs, args.ids, args.start, args.end, cols=("id", "entity", "ts", "v"))}
    raise ValueError(args.report)


def parse(argv: Sequence[str]) -> argparse.Namespace:
    ap = argparse.ArgumentParser(prog="cadence", description=__doc__.split("\n")[0])
    ap.add_argument("report", choices=REPORTS)
    ap.add_argument("--input", nargs="+", required=True, help="CSV files/globs, JSON page folder or landed folder")
    ap.add_argument("--source", choices=("csv", "json", "landed"), default="csv")
    ap.add_argument("--mode", choices=("strict", "lenient", "keep"), default="lenient")
    ap.add_argument("--out", required=True)
    ap.add_argument("--format", choices=("parquet", "csv"), default="parquet")
    ap.add_argument("--years", nargs="*", type=int, default=[2023, 2024])
    ap.add_argument("--top", type=int, default=5)
    ap.add_argument("--min-slots", type=int, default=12, help="0 keeps every series")
    ap.add_argument("--ids", nargs="*", default=[])
    ap.add_argument("--names", nargs="*", default=[], help="entity names of the histogram")
    ap.add_argument("--start", default="1900-01-01 00:00:00")
    ap.add_argument("--end", default="9999-12-31 23:59:59")
    ap.add_argument("--append", action="store_true", help="land: add to a folder landed before")
    ap.add_argument("--plain-names", action="store_true", help="keep the library's column names")
    ap.add_argument("--master", default=None, help="only for runs outside spark-submit")
    ap.add_argument("--profile", choices=("local", "cluster"), default=None, help="session settings profile")
    return ap.parse_args(argv)


def main(argv: Sequence[str] | None = None) -> dict[str, str]:
    args = parse(sys.argv[1:] if argv is None else argv)
    spark = build_session(args.master, profile=args.profile)
    if args.report == "stored-profile":
        fmt = "csv" if args.source == "csv" else "parquet"
        # without years: a profile that is not kept by year
        found = {f"stored_profile_{y}" if y else "stored_profile": rpt.stored_profile(spark, args.input[0], y, fmt) for y in args.years or [None]}
        paths = bundles.write_report(spark, found, f"{args.out.rstrip('/')}/stored-profile", fmt=args.format)
    elif args.report == "land" and args.source != "landed":
        raw, counts, tables = _raw(spark, args)
        counts |= stage_facts(raw, args.out, mode=args.mode, years=args.years, write_mode="append" if args.append else "errorifexists")
        # beside the facts: readers pass over folders that begin with an underscore
        root = f"{args.out.rstrip('/')}/_runs"
        paths = {"facts": args.out, **bundles.write_report(spark, {"run_counters": counters_table(spark, counts), **tables}, root)}
    else:
        fs, counts, tables = _facts(spark, args)
        if args.report == "land":
            bundle = {}
            paths = {"facts": land_as_parquet(fs, args.out, mode="append" if args.append else "errorifexists")}
        else:
            bundle, paths = _bundle(spark, args, fs), {}
        if not args.plain_names:
            bundle = as_report_columns(bundle)
        bundle = {**bundle, "run_counters": counters_table(spark, counts), **tables}
        root = f"{args.out.rstrip('/')}/{'_runs' if args.report == 'land' else args.report}"
        paths |= bundles.write_report(spark, bundle, root, fmt="parquet" if args.report == "land" else args.format)
    print(json.dumps(paths))
    return paths
