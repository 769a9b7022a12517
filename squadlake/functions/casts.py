"""Lenient casts and timestamp parsing: bad input becomes NULL, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FACILITY_TZ = "America/New_York"

ISO_Z = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"
ISO_OFFSET = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}[+-]\d{2}:\d{2}$"
NAIVE_PREFIX = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}"
DATE_ONLY = r"^\d{4}-\d{2}-\d{2}$"
DATE_PREFIX = r"^\d{4}-\d{2}-\d{2}"
US_DATE = r"^\d{2}/\d{2}/\d{4}$"


def num(c: Column) -> Column:
    return c.try_cast("double")


def whole(c: Column) -> Column:
    """Integer through double, so '40011.0' and 40011 both count."""
    return num(c).try_cast("bigint")


def iso_utc(c: Column) -> Column:
    """ISO text with Z or an offset -> instant."""
    return F.try_to_timestamp(c)


def guarded_iso(c: Column, pattern: str) -> Column:
    return F.when(c.rlike(pattern), F.try_to_timestamp(c))


def epoch_utc(c: Column) -> Column:
    return F.timestamp_seconds(whole(c))


def us_date(c: Column) -> Column:
    return F.when(c.rlike(US_DATE), F.try_to_timestamp(c, F.lit("MM/dd/yyyy")).cast("date"))


def iso_date(c: Column) -> Column:
    return F.left(c, F.lit(10)).try_cast("date")


def wall_time(c: Column, tz: Column | str) -> Column:
    """Naive local text + zone -> instant."""
    return F.to_utc_timestamp(F.try_to_timestamp(F.left(c, F.lit(19))), tz)


def facility_local(c: Column, tz: str = FACILITY_TZ) -> tuple[Column, Column]:
    """(instant, corrected) for text that is local time whatever it claims.

    A '+00:00' suffix is known to be wrong: dropped and flagged.  Any other
    offset is trusted; no offset means local.
    """
    bogus = c.endswith("+00:00")
    other = c.rlike(r"(Z|[+-]\d{2}:\d{2})$") & ~bogus
    instant = F.when(other, F.try_to_timestamp(c)).otherwise(wall_time(c, tz))
    return instant, F.coalesce(bogus, F.lit(False))


def local_date(ts: Column, tz: str = FACILITY_TZ) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, tz))


def pct(n: Column, d: Column) -> Column:
    return F.round(F.try_divide(F.lit(100.0) * n, d), 2)


def surrogate_key(*cols: Column) -> Column:
    """md5 of the dash-joined text of the key columns; NULL has a fixed placeholder."""
    text = [F.coalesce(c.cast("string"), F.lit("_dbt_utils_surrogate_key_null_")) for c in cols]
    return F.md5(F.concat_ws("-", *text))


def general_number(c: Column) -> Column:
    """Six significant digits without trailing zeros, as C's %g prints."""
    x = c.cast("double")
    mag = F.abs(x)
    outside = (mag >= 999_999.5) | (mag < 1e-4)
    text = F.when(outside, F.format_string("%.5e", x))
    for power in range(5, -5, -1):  # digits left of the point decide the digits right of it
        text = text.when(mag >= 10.0 ** power, F.format_string(f"%.{5 - power}f", x))
    trimmed = F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+(e|$)", "$1$2"), r"\.(e|$)", "$1")
    return F.when(mag == 0, F.lit("0")).otherwise(trimmed)
