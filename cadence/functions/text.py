"""Text functions: the name sanitiser, number formats, and text extraction
from raw time stamps. All are native Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (they must equal the reports' own rules)
#   sanitiser: characters replaced, in this order:
#              /  ->  -      \  ->  -      *  ->  -      [  ->  (      ]  ->  )
#              :  ->  -      ?  ->  -      '  ->  -      ,  ->  -      .  ->  -
#              then outer blanks are removed and the first 31 characters kept;
#              a missing name becomes "Unknown_Station"
#   year in a stamp:           first run of four digits, pattern (\d{4})
#   clock hour in a stamp:     pattern \d+/\d+/\d+\s+(\d+):\d+:\d+
# ---------------------------------------------------------------------------
SANITISE_FROM = "/\\*[]:?',."
SANITISE_TO = "---()-----"
SANITISE_MAX = 31
UNKNOWN_NAME = "Unknown_Station"
YEAR_PATTERN = r"(\d{4})"
CLOCK_HOUR_PATTERN = r"\d+/\d+/\d+\s+(\d+):\d+:\d+"
BLANKS = " \t\n\r\f\u000b"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def sanitize_name(name: Column | str) -> Column:
    """Make an entity name safe as a file or sheet name (see fixed values)."""
    mapped = F.translate(_c(name), SANITISE_FROM, SANITISE_TO)
    stripped = F.btrim(mapped, F.lit(BLANKS))
    return F.coalesce(F.substring(stripped, 1, SANITISE_MAX), F.lit(UNKNOWN_NAME))


def thousands(x: Column | str, decimals: int = 0) -> Column:
    """``1,234,568`` style text (``decimals`` digits after the point)."""
    return F.format_number(_c(x), decimals)


def fixed2(x: Column | str) -> Column:
    """Two decimals, no grouping: ``1234.57``."""
    return F.format_string("%.2f", _c(x))


def percent_text(ratio: Column | str, decimals: int = 2) -> Column:
    """A 0-1 ratio as percent text: ``12.34%``.

    The percent is rounded half up first (``floor(x * 10^d + 0.5) / 10^d``),
    so the text does not depend on how a formatter breaks a tie."""
    unit = float(10**decimals)
    pct = F.floor(_c(ratio) * F.lit(100.0 * unit) + F.lit(0.5)) / F.lit(unit)
    return F.format_string(f"%.{decimals}f%%", pct)


def ratio_to_pct(ratio: Column | str) -> Column:
    """A 0-1 ratio on the 0-100 scale."""
    return _c(ratio) * 100


def stamp_year(text: Column | str) -> Column:
    """The first four-digit run of a raw stamp, as INT (NULL if none)."""
    return F.regexp_extract(_c(text), YEAR_PATTERN, 1).try_cast("int")


def clock_hour12(text: Column | str) -> Column:
    """The clock hour (1-12) written before the first colon of a
    ``M/D/YYYY H:MM:SS`` stamp, **without** its AM/PM: 7 AM and 7 PM both
    give 7. Not a 24-hour ``hour``."""
    return F.regexp_extract(_c(text), CLOCK_HOUR_PATTERN, 1).try_cast("int")
