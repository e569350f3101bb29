"""Column names of the report tables as the reports print them.

The library's tables use neutral names (``entity``, ``total``, ``avg`` ...);
``as_report_columns`` renames a bundle's tables to the reports' own headings
when a report is written for people rather than for further queries.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

# ---------------------------------------------------------------------------
# Headings of the report tables
#   season matrix:      Station, Winter, Spring, Summer, Fall
#   season comparison:  Season, <year>, <year>
#   yearly totals:      station_complex, ridership, percentage
#   hourly averages:    Station Name, Hour, Average Ridership
#   weekday averages:   Day of the Week, Average Ridership
#   monthly series:     Time (EST), Average Ridership
#   station directory:  station_complex, station_complex_id
#   hour profile:       station_complex_id, station_complex, hour, ridership
#   network hour curve: AM_PM, <year>, <year>
#   hour histogram:     hour, ridership
# ---------------------------------------------------------------------------
HEADINGS: dict[str, dict[str, str]] = {
    "season_matrix": {"entity": "Station"},
    "season_top": {"entity": "Station"},
    "season_compare": {"season": "Season"},
    "shares": {"entity": "station_complex", "total": "ridership", "share": "percentage"},
    "top_15": {"entity": "station_complex", "total": "ridership"},
    "top_10": {"entity": "station_complex", "total": "ridership"},
    "hour_averages": {"entity": "Station Name", "hour": "Hour", "avg": "Average Ridership"},
    "weekday_averages": {"day": "Day of the Week", "avg_total": "Average Ridership"},
    "monthly_series": {"label": "Time (EST)", "filled": "Average Ridership"},
    "directory": {"entity": "station_complex", "id": "station_complex_id"},
    "hour_profile": {"id": "station_complex_id", "entity": "station_complex", "hour": "hour", "avg": "ridership"},
    "network_hour_curve": {"label": "AM_PM"},
    "hour_totals": {"total": "ridership"},
}


def _year_columns(df: DataFrame) -> dict[str, str]:
    """``y2023`` -> ``2023`` (the comparison tables head years plainly)."""
    return {c: c[1:] for c in df.columns if c.startswith("y") and c[1:].isdigit()}


def as_report_columns(bundle: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    out = {}
    for name, df in bundle.items():
        mapping = {**HEADINGS.get(name, {}), **_year_columns(df)}
        mapping = {k: v for k, v in mapping.items() if k in df.columns}
        out[name] = df.withColumnsRenamed(mapping) if mapping else df
    return out
