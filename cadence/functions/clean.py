"""Coercion of raw text cells under the two bad-data regimes.

* strict  -- a bad cell fails the job (ANSI casts and ``to_timestamp``);
* lenient -- a bad cell becomes NULL (``try_cast`` / ``try_to_timestamp``),
  and the caller decides whether to drop the row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values
#   stamp form of the ridership export:  10/18/2022 07:00:00 PM
#   (Spark pattern M/d/yyyy h:mm:ss a takes one- and two-digit fields)
# ---------------------------------------------------------------------------
US_STAMP = "M/d/yyyy h:mm:ss a"
US_STAMP_OUT = "MM/dd/yyyy hh:mm:ss a"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _nan_to_null(x: Column) -> Column:
    return F.nanvl(x, F.lit(None).cast("double"))


def _fail_on(what: str, text: Column) -> Column:
    return F.raise_error(F.concat(F.lit(f"cannot parse {what}: '"), text, F.lit("'")))


def to_number(text: Column | str, strict: bool = False) -> Column:
    """Text to DOUBLE. Empty text, ``NaN``, infinities and junk become NULL when
    lenient; junk and infinities fail the job when strict (empty and ``NaN`` are missing either
    way). Strict does not depend on the session's ANSI setting."""
    t = F.trim(_c(text).cast("string"))
    blank = t.isNull() | (t == "")
    num = t.try_cast("double")
    num = F.when(F.abs(num) != F.lit(float("inf")), num)
    out = F.when(blank, F.lit(None).cast("double"))
    if strict:
        out = out.when(num.isNull(), _fail_on("number", t))
    return out.otherwise(_nan_to_null(num))


def to_stamp(text: Column | str, fmt: str = US_STAMP, strict: bool = False) -> Column:
    """Text in an explicit format to TIMESTAMP_NTZ.

    Parsed under the session time zone (pinned to UTC) and cast to NTZ, so an
    hour inside a daylight-saving gap keeps its wall-clock value.
    """
    t = _c(text)
    parsed = F.try_to_timestamp(t, F.lit(fmt)).cast("timestamp_ntz")
    if strict:
        return F.when(t.isNotNull() & parsed.isNull(), _fail_on("timestamp", t)).otherwise(parsed)
    return parsed


def to_stamp_guess(text: Column | str, fmt: str = US_STAMP) -> Column:
    """Lenient parse with the given format first, then the ISO form
    (``2024-12-01T00:00:00``) as the fallback guess."""
    t = _c(text)
    return F.coalesce(
        F.try_to_timestamp(t, F.lit(fmt)),
        t.try_cast("timestamp"),
    ).cast("timestamp_ntz")


def to_stamp_strict_guess(text: Column | str) -> Column:
    """Strict parse of ISO-like text: junk fails the job (with or without
    ANSI mode)."""
    t = _c(text)
    parsed = t.try_cast("timestamp_ntz")
    return F.when(t.isNotNull() & parsed.isNull(), _fail_on("timestamp", t)).otherwise(parsed)


def stamp_text(ts: Column | str) -> Column:
    """A timestamp written in the export's ``MM/dd/yyyy hh:mm:ss AM`` form."""
    return F.date_format(_c(ts), US_STAMP_OUT)
